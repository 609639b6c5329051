"""Segments, coverage, overlaps and scan windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.functions.numbers import int_div
from actiongrid.operators import segments as S

from .bindings import EVENTS_SQL, HOUR, events
from .registry import query

DAY = 24 * HOUR
WEEK = 7 * DAY


def segments(spark, folder):
    """Per user and week one segment on alternating sides; weeks with an odd event count
    get a second, overlapping one."""
    week = int_div("start_us", WEEK)
    e = events(spark, folder).groupBy("user_id", week.alias("week")).agg(F.count(F.lit(1)).alias("n"))
    copy = F.explode(F.when(F.col("n") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    side = F.when(F.col("week") % 2 == 0, "near").otherwise("far")
    return e.withColumn("copy", copy).select(
        F.col("user_id").cast("string").alias("video_id"), side.alias("side"),
        (F.col("user_id") * 1000 + F.col("week") * 10 + F.col("copy")).alias("segment_id"),
        (F.col("week") * 10 + F.col("copy")).alias("position"),
        (F.col("week") * WEEK + F.col("copy") * DAY).alias("start_us"), ((F.col("week") + 1) * WEEK).alias("end_us"),
    )


SEGMENTS_SQL = EVENTS_SQL + f""",
wk as (select user_id, start_us // {WEEK} as week, count(*) as n from ev group by 1, 2),
cp as (select user_id, week, unnest(case when n % 2 = 1 then [0, 1] else [0] end) as copy from wk),
sg as (select cast(user_id as varchar) as video_id, case when week % 2 = 0 then 'near' else 'far' end as side,
              user_id * 1000 + week * 10 + copy as segment_id, week * 10 + copy as position,
              week * {WEEK} + copy * {DAY} as start_us, (week + 1) * {WEEK} as end_us from cp),
an as (select cast(user_id as varchar) as video_id, case when (start_us // {WEEK}) % 2 = 0 and k < 90 then 'near' else 'far' end as side,
              event_id as annotation_id, start_us, end_us from ev)"""


def annotations(spark, folder):
    near = (int_div("start_us", WEEK) % 2 == 0) & (F.col("k") < 90)
    return events(spark, folder).select(
        F.col("user_id").cast("string").alias("video_id"), F.when(near, "near").otherwise("far").alias("side"),
        F.col("event_id").alias("annotation_id"), "start_us", "end_us")


COVER = f"""with {SEGMENTS_SQL},
n as (select annotation_id, (select count(*) from sg where sg.video_id = an.video_id and sg.side = an.side and sg.start_us <= an.start_us and an.end_us <= sg.end_us) as c,
        (select max(segment_id) from sg where sg.video_id = an.video_id and sg.side = an.side and sg.start_us <= an.start_us and an.end_us <= sg.end_us) as one from an)
select annotation_id, cast(least(c, 2) as integer) as covered, case when c = 1 then one end as cover_id from n"""


@query("segment_cover", COVER)
def segment_cover(spark, folder):
    return S.segment_cover(annotations(spark, folder), segments(spark, folder)).select("annotation_id", "covered", "cover_id")


@query("segment_cover_hot_videos", COVER)
def segment_cover_hot_videos(spark, folder):
    return S.segment_cover(annotations(spark, folder), segments(spark, folder), max_rows=45).select("annotation_id", "covered", "cover_id")


# new intervals of six hours at every user's odd hours against the existing windows
CANDIDATES = f"""with {EVENTS_SQL},
nw as (select event_id as interval_id, user_id, end_us + {HOUR} as start_us, end_us + {2 * HOUR} as end_us from ev),
ov as (select interval_id, user_id, start_us, end_us,
        (select max((e.end_us, e.event_id)) from ev e where e.user_id = nw.user_id and e.start_us < nw.end_us) as best from nw)"""


def _candidates(spark, folder):
    e = events(spark, folder)
    new = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("interval_id"),
                   (F.col("end_us") + HOUR).alias("start_us"), (F.col("end_us") + 2 * HOUR).alias("end_us"))
    return new, e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("window_id"), "start_us", "end_us")


@query("overlap_witness", CANDIDATES + " select interval_id, case when best[1] > start_us then best[2] end as witness from ov")
def overlap_witness(spark, folder):
    return S.overlapping_candidates(*_candidates(spark, folder)).select("interval_id", "witness")


@query("free_candidates", f"""with {EVENTS_SQL},
nw as (select event_id as interval_id, user_id, end_us + {HOUR} as start_us, end_us + {2 * HOUR} as end_us from ev)
select interval_id, start_us, end_us from nw where not exists
  (select 1 from ev e where e.user_id = nw.user_id and e.start_us < nw.end_us and nw.start_us < e.end_us)""")
def free_candidates(spark, folder):
    return S.free_candidates(*_candidates(spark, folder)).select("interval_id", "start_us", "end_us")


@query("consecutive_faults", f"""with {SEGMENTS_SQL},
l as (select *, lag(start_us) over o as ps, start_us - lag(end_us) over o as gap_us from sg window o as (partition by video_id order by position))
select segment_id, gap_us, case when end_us <= start_us then 'empty' when start_us < ps then 'unsorted' when gap_us < 0 then 'overlap' end as fault from l""")
def consecutive_faults(spark, folder):
    return S.consecutive_faults(segments(spark, folder)).select("segment_id", "gap_us", "fault")


@query("inside_named_segment", f"""with {SEGMENTS_SQL}
select annotation_id as interval_id, coalesce(sg.start_us <= an.start_us and an.end_us <= sg.end_us and an.side = sg.side, false) as inside
from an left join sg on sg.segment_id = cast(an.video_id as bigint) * 1000 + (an.start_us // {WEEK}) * 10""")
def inside_named_segment(spark, folder):
    named = annotations(spark, folder).select(
        F.col("annotation_id").alias("interval_id"), "side", "start_us", "end_us",
        (F.col("video_id").cast("long") * 1000 + int_div("start_us", WEEK) * 10).alias("source_segment_id"))
    return S.inside_named_segment(named, segments(spark, folder)).select("interval_id", "inside")


@query("scan_windows", f"""with {SEGMENTS_SQL},
b as (select video_id, segment_id, side, greatest(start_us - {HOUR}, 0) as base, end_us + {HOUR} - greatest(start_us - {HOUR}, 0) as d from sg),
n as (select *, (d - {6 * HOUR}) // {4 * HOUR} + 1 as nr, case when (d - {6 * HOUR}) % {4 * HOUR} <> 0 then 1 else 0 end as tail from b),
g as (select *, unnest(range(0, nr + tail)) as ordinal from n)
select video_id, segment_id, side, ordinal, base + case when ordinal < nr then ordinal * {4 * HOUR} else d - {6 * HOUR} end as start_us,
       base + case when ordinal < nr then ordinal * {4 * HOUR} + {6 * HOUR} else d end as end_us from g""")
def scan_windows(spark, folder):
    return S.scan_windows(segments(spark, folder), window_seconds=6 * 3600.0, stride_seconds=4 * 3600.0, tolerance_us=HOUR)


DUPLICATES = f"""with {EVENTS_SQL},
d as (select event_id, user_id, k % 2 as side, action, start_us, end_us from ev),
p as (select event_id, end_us, start_us, max((end_us, event_id)) over (partition by user_id, side, action order by start_us, end_us, event_id
      rows between unbounded preceding and 1 preceding) as best from d)
select event_id as window_id, best[2] as witness from p where end_us > start_us and best[1] > start_us"""


def _duplicates(spark, folder, **kw):
    rows = events(spark, folder).select(
        F.col("user_id").alias("video_id"), (F.col("k") % 2).alias("side"), F.col("action").alias("label"),
        F.col("event_id").alias("window_id"), "start_us", "end_us")
    return S.duplicate_candidates(rows, **kw).select("window_id", "witness")


@query("duplicate_windows", DUPLICATES)
def duplicate_windows(spark, folder):
    return _duplicates(spark, folder)


@query("duplicate_windows_hot_groups", DUPLICATES)
def duplicate_windows_hot_groups(spark, folder):
    return _duplicates(spark, folder, max_rows=12)


@query("boundary_vicinity", f"""with {SEGMENTS_SQL}
select event_id, exists (select 1 from (select video_id, start_us as edge from sg union all select video_id, end_us from sg) b
  where b.video_id = cast(ev.user_id as varchar) and b.edge - {3 * HOUR} < ev.end_us and ev.start_us < b.edge + {3 * HOUR} + 1) as near_boundary
from ev""")
def boundary_vicinity(spark, folder):
    points = events(spark, folder).select(F.col("user_id").cast("string").alias("video_id"), "event_id", "start_us", "end_us")
    return S.boundary_vicinity(points, segments(spark, folder), tolerance_us=3 * HOUR).select("event_id", "near_boundary")


@query("refinement_faults", f"""with {EVENTS_SQL},
a as (select user_id as interval_id, action as label, start_us, end_us from ev),
r as (select user_id as interval_id, action as label, start_us, case when k % 9 = 0 then end_us + 1 else end_us end as end_us from ev where end_us + 1 <= {20 * DAY}),
i as (select * from a where end_us <= {20 * DAY} and interval_id in (select interval_id from r)),
u as (select *, 1 as x, 0 as y from r union all select *, 0, 1 from i)
select interval_id, label, start_us, end_us, cast(sum(x) as bigint) as in_refined, cast(sum(y) as bigint) as in_actions
from u group by all having sum(x) <> sum(y)""")
def refinement_faults(spark, folder):
    e = events(spark, folder).select(F.col("user_id").alias("interval_id"), F.col("action").alias("label"), "start_us", "end_us", "k")
    refined = e.where(F.col("end_us") + 1 <= 20 * DAY).withColumn(
        "end_us", F.when(F.col("k") % 9 == 0, F.col("end_us") + 1).otherwise(F.col("end_us"))
    ).withColumn("range_start_us", F.lit(0).cast("long")).withColumn("range_end_us", F.lit(20 * DAY))
    return S.refinement_faults(refined, e)
