"""Players, tracks and assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.operators import identity as I
from actiongrid.plans.intervals import overlap_pairs

from .bindings import EVENTS_SQL, HOUR, events
from .registry import query, table

VOTES = """
rd as (select l_orderkey as track_id, case when l_linestatus = 'O' and l_returnflag = 'N' then null else cast(l_suppkey % 20 as varchar) end as number,
        cast(round(l_discount * 100) as bigint) * 100000 as conf_micro from lineitem),
vt as (select track_id, number, cast(sum(conf_micro) as bigint) as score, count(*) as frames from rd where number is not null group by 1, 2),
rk as (select *, row_number() over o as rank, score - coalesce(lead(score) over o, 0) as lead_over_next from vt
       window o as (partition by track_id order by score desc, number))"""


def votes(spark, folder):
    number = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), F.lit(None)).otherwise((F.col("l_suppkey") % 20).cast("string"))
    return I.number_votes(table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("track_id"), number.alias("number"), (F.round(F.col("l_discount") * 100).cast("long") * 100_000).alias("conf_micro")))


@query("ocr_vote", f"with {VOTES} select track_id, number, score, frames, cast(rank as integer) as rank, lead_over_next from rk")
def ocr_vote(spark, folder):
    return votes(spark, folder)


@query("roster_restrict", f"""with {VOTES}, b as (select rk.*, o_custkey % 25 as team from rk join orders on o_orderkey = track_id where rank = 1)
select track_id, team, number, exists (select 1 from customer c where c.c_nationkey = b.team and cast(c.c_custkey % 97 as varchar) = b.number) as in_roster from b""")
def roster_restrict(spark, folder):
    best = votes(spark, folder).where("rank = 1").join(
        table(spark, folder, "orders").select(F.col("o_orderkey").alias("track_id"), (F.col("o_custkey") % 25).cast("int").alias("team")), "track_id")
    roster = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("team"), (F.col("c_custkey") % 97).cast("string").alias("number"))
    return I.restrict_to_roster(best, roster).select("track_id", "team", "number", "in_roster")


ROSTER_SQL = """
ro as (select c_nationkey as team, c_custkey % 20 as number, c_custkey as entry_id, min(epoch_us(o_orderdate)) as start_us,
       min(epoch_us(o_orderdate)) + 86400000000 * (1 + c_custkey % 300) as end_us from customer join orders on o_custkey = c_custkey group by 1, 2, 3),
p as (select *, max((end_us, entry_id)) over (partition by team, number order by start_us, end_us, entry_id rows between unbounded preceding and 1 preceding) as best from ro)"""


@query("roster_conflicts", f"with {ROSTER_SQL} select entry_id, best[2] as witness from p where end_us > start_us and best[1] > start_us")
def roster_conflicts(spark, folder):
    first = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("d"))
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', d)")
    roster = table(spark, folder, "customer").join(first, "c_custkey").select(
        F.col("c_nationkey").alias("team"), (F.col("c_custkey") % 20).alias("number"), F.col("c_custkey").alias("entry_id"),
        start.alias("start_us"), (start + 86_400_000_000 * (1 + F.col("c_custkey") % 300)).alias("end_us"))
    return I.roster_conflicts(roster).select("entry_id", "witness")


CONFLICTS = f"""with {EVENTS_SQL},
p as (select event_id, start_us, end_us, max((end_us, event_id)) over (partition by user_id % 10, k % 2, k % 20 order by start_us, end_us, event_id
      rows between unbounded preceding and 1 preceding) as best from ev where k % 5 <> 0)
select event_id as track_id, best[2] as witness from p where end_us > start_us and best[1] > start_us"""


def _tracks(spark, folder):
    k = F.col("k")
    return events(spark, folder).select(
        (F.col("user_id") % 10).alias("video_id"), (k % 2).alias("team"), F.when(k % 5 != 0, k % 20).alias("number"),
        F.col("event_id").alias("track_id"), "start_us", "end_us")


@query("number_conflicts", CONFLICTS)
def number_conflicts(spark, folder):
    return I.number_conflicts(_tracks(spark, folder)).select("track_id", "witness")


@query("number_conflicts_hot_videos", CONFLICTS)
def number_conflicts_hot_videos(spark, folder):
    return I.number_conflicts(_tracks(spark, folder), max_rows=3).select("track_id", "witness")


ASSIGNED = f"""with {EVENTS_SQL},
e as (select user_id as video_id, event_id, start_us, end_us from ev),
t as (select user_id as video_id, event_id as track_id, start_us + {HOUR} as start_us, end_us + {3 * HOUR} as end_us from ev where k % 3 <> 0),
a as (select e.video_id, e.event_id, t.track_id, case when t.track_id is not null then least(e.end_us, t.end_us) - greatest(e.start_us, t.start_us) end as overlap_us
      from e left join t on e.video_id = t.video_id and e.start_us < t.end_us and t.start_us < e.end_us)"""


def _sides(spark, folder):
    e = events(spark, folder).withColumnRenamed("user_id", "video_id")
    return e, e.where("k % 3 <> 0").select("video_id", F.col("event_id").alias("track_id"), (F.col("start_us") + HOUR).alias("start_us"), (F.col("end_us") + 3 * HOUR).alias("end_us"))


def _assigned(spark, folder, **kw):
    e, tracks = _sides(spark, folder)
    return I.assign_events(e, tracks, **kw)


@query("event_tracks", ASSIGNED + " select * from a")
def event_tracks(spark, folder):
    return _assigned(spark, folder)


@query("event_tracks_salted", ASSIGNED + " select * from a")
def event_tracks_salted(spark, folder):
    """The bucketed join, with every bucket of more than three rows split."""
    e, tracks = _sides(spark, folder)
    return overlap_pairs(e, tracks, ["video_id"], left_id="event_id", right_id="track_id", width_us=6 * HOUR, how="left", bucket_rows=3)


@query("event_tracks_many_ranges", f"""with {EVENTS_SQL},
e as (select user_id as video_id, event_id, start_us, end_us from ev),
t as (select user_id as video_id, event_id as track_id, start_us + {HOUR} as start_us, end_us + {3 * HOUR} as end_us from ev where k % 3 <> 0
      union all select user_id, -1 - user_id, min(start_us) - 1, max(end_us) + 1 from ev group by user_id)
select e.video_id, e.event_id, t.track_id, case when t.track_id is not null then least(e.end_us, t.end_us) - greatest(e.start_us, t.start_us) end as overlap_us
from e left join t on e.video_id = t.video_id and e.start_us < t.end_us and t.start_us < e.end_us""")
def event_tracks_many_ranges(spark, folder):
    """Short ranges of the line, and on every video one more track as long as all of it."""
    e, tracks = _sides(spark, folder)
    whole = e.groupBy("video_id").agg((F.min("start_us") - 1).alias("start_us"), (F.max("end_us") + 1).alias("end_us"))
    whole = whole.select("video_id", (-1 - F.col("video_id")).alias("track_id"), "start_us", "end_us")
    return I.assign_events(e, tracks.unionByName(whole), range_rows=500)


@query("event_tracks_right_heavy", f"""with {EVENTS_SQL},
e as (select user_id as video_id, event_id, start_us, end_us from ev),
t as (select user_id as video_id, event_id as track_id, start_us + {HOUR} as start_us, end_us + {3 * HOUR} as end_us from ev where k % 3 <> 0)
select t.video_id, t.track_id, e.event_id, case when e.event_id is not null then least(e.end_us, t.end_us) - greatest(e.start_us, t.start_us) end as overlap_us
from t left join e on e.video_id = t.video_id and e.start_us < t.end_us and t.start_us < e.end_us""")
def event_tracks_right_heavy(spark, folder):
    """Tracks against events: the fuller side is the right one, and it is the one that is split."""
    e, tracks = _sides(spark, folder)
    return overlap_pairs(tracks, e, ["video_id"], left_id="track_id", right_id="event_id", width_us=6 * HOUR, how="left", bucket_rows=3)


@query("assignment_counts", ASSIGNED + """ select video_id, event_id, count(track_id) as tracks, cast(coalesce(sum(overlap_us), 0) as bigint) as overlap_us,
  case when count(track_id) = 0 then 'none' when count(track_id) = 1 then 'one' else 'many' end as ambiguity from a group by 1, 2""")
def assignment_counts(spark, folder):
    return I.assignment_counts(_assigned(spark, folder))


RELINK = f"""with {EVENTS_SQL},
r as (select *, max(end_us) over (partition by user_id, k % 4 order by start_us, end_us, event_id rows between unbounded preceding and 1 preceding) as reach from ev),
l as (select *, coalesce(start_us <= reach + {24 * HOUR}, false) as linked from r)
select event_id as track_id, start_us - reach as gap_us, linked,
  cast(sum(case when linked then 0 else 1 end) over (partition by user_id, k % 4 order by start_us, end_us, event_id rows unbounded preceding) as bigint) as link_no from l"""


def _relink(spark, folder, **kw):
    tracks = events(spark, folder).select(
        F.col("user_id").alias("video_id"), (F.col("k") % 4).alias("player"), F.col("event_id").alias("track_id"), "start_us", "end_us")
    return I.relink_tracks(tracks, max_gap_us=24 * HOUR, **kw).select("track_id", "gap_us", "linked", "link_no")


@query("track_relink", RELINK)
def track_relink(spark, folder):
    return _relink(spark, folder)


@query("track_relink_hot_players", RELINK)
def track_relink_hot_players(spark, folder):
    return _relink(spark, folder, max_rows=24)


@query("tracking_faults", f"""with {EVENTS_SQL},
f as (select user_id as truth_id, user_id % 7 as video_id, event_id as frame_index, case when k % 4 = 0 then null else k % 3 end as track_id from ev),
l as (select *, lag(track_id) over o as prev, last_value(track_id ignore nulls) over (partition by video_id, truth_id order by frame_index rows between unbounded preceding and 1 preceding) as last
      from f window o as (partition by video_id, truth_id order by frame_index))
select video_id, truth_id, count(*) as frames, count(track_id) as tracked, count(case when track_id <> last then 1 end) as switches,
  count(case when track_id is not null and prev is null and last is not null then 1 end) as fragments from l group by 1, 2""")
def tracking_faults(spark, folder):
    frames = events(spark, folder).select(
        (F.col("user_id") % 7).alias("video_id"), F.col("user_id").alias("truth_id"), F.col("event_id").alias("frame_index"),
        F.when(F.col("k") % 4 == 0, F.lit(None)).otherwise(F.col("k") % 3).alias("track_id"))
    return I.tracking_faults(frames)


@query("review_gates", f"""with {EVENTS_SQL},
g as (select event_id as track_id, list_filter([
  case when k % 11 = 0 then 'team_uncertain' end,
  case when k % 4 > 1 and k * 5000 < 200000 then 'no_clear_winner' end,
  case when k % 4 > 0 and k % 3 = 0 then 'not_in_roster' end,
  case when k % 7 = 0 then 'relinked' end,
  case when k % 13 = 0 then 'number_conflict' end,
  case when user_id % 5 = 0 then 'many_tracks' end,
  case when user_id % 17 = 0 then 'segment_boundary' end,
  case when k % 4 > 0 and (k < 10 or k * 10000 < 500000) then 'weak_reading' end,
  case when k % 4 = 0 and k % 8 = 0 then 'no_reading' end], lambda x: x is not null) as l from ev)
select track_id, array_to_string(l, ',') as gates, len(l) > 0 as needs_review from g""")
def review_gates(spark, folder):
    k = F.col("k")
    tracks = events(spark, folder).select(
        F.col("event_id").alias("track_id"), F.when(k % 11 == 0, "unknown").otherwise("own").alias("team"), (k % 4).alias("candidates"),
        (k * 5000).alias("lead_over_next"), (k % 3 != 0).alias("in_roster"), (k % 7 == 0).alias("linked"), (k % 13 == 0).alias("number_conflict"),
        F.when(F.col("user_id") % 5 == 0, "many").otherwise("one").alias("ambiguity"), (F.col("user_id") % 17 == 0).alias("near_boundary"),
        F.length(k.cast("string")).alias("digits"), (k * 10_000).alias("conf_micro"), F.when(k % 8 == 0, "occluded").otherwise("visible_clear").alias("visibility"))
    return I.review_gates(tracks).select("track_id", F.array_join("gates", ",").alias("gates"), "needs_review")


@query("identity_metrics", f"""with {EVENTS_SQL},
r as (select user_id % 10 as video_id, k % 2 = 0 as readable, k % 20 as truth_number, case when k % 6 = 0 then null when k % 9 = 0 then 99 else k % 20 end as number,
       k % 20 + 100 as truth_ref, case when k % 5 = 0 then null else k % 20 + 100 end as identity_ref, k % 5 <> 0 as confirmed, k % 3 = 0 as routed,
       k % 2 = 0 as truly, k % 4 < 3 and k % 2 = 0 or k % 7 = 0 as ours from ev),
c as (select video_id, count(*) as total, count(case when readable then 1 end) as readable, count(case when readable and number is not null then 1 end) as answered,
  count(case when readable and number = truth_number then 1 end) as number_correct, count(case when truly then 1 end) as evaluable,
  count(case when truly and identity_ref = truth_ref and number = truth_number then 1 end) as identity_correct, count(case when confirmed then 1 end) as confirmed,
  count(case when routed then 1 end) as routed, count(case when identity_ref is null then 1 end) as unresolved,
  count(case when ours and truly then 1 end) as team_tp, count(case when ours and not truly then 1 end) as team_fp, count(case when not ours and truly then 1 end) as team_fn from r group by 1)
select *, number_correct::double / nullif(readable, 0) as number_accuracy, identity_correct::double / nullif(evaluable, 0) as identity_accuracy,
  confirmed::double / total as coverage, coalesce(team_tp::double / nullif(team_tp + team_fp, 0), 0) as team_precision,
  coalesce(team_tp::double / nullif(team_tp + team_fn, 0), 0) as team_recall, coalesce((2 * team_tp)::double / nullif(2 * team_tp + team_fp + team_fn, 0), 0) as team_f1 from c""")
def identity_metrics(spark, folder):
    k = F.col("k")
    own = lambda c: F.when(c, "own").otherwise("other")
    rows = events(spark, folder).select(
        (F.col("user_id") % 10).alias("video_id"), (k % 2 == 0).alias("readable"), (k % 20).alias("truth_number"),
        F.when(k % 6 == 0, F.lit(None)).when(k % 9 == 0, 99).otherwise(k % 20).alias("number"), (k % 20 + 100).alias("truth_ref"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(k % 20 + 100).alias("identity_ref"), F.when(k % 5 != 0, "confirmed").otherwise("candidate").alias("identity_status"),
        (k % 3 == 0).alias("routed_to_review"), own(k % 2 == 0).alias("truth_team"), own(((k % 4 < 3) & (k % 2 == 0)) | (k % 7 == 0)).alias("team"))
    return I.identity_metrics(rows, ["video_id"])


@query("character_accuracy", f"""with {EVENTS_SQL}, r as (select cast(k as varchar) as a, cast(user_id % 100 as varchar) as b from ev)
select cast(sum(case when substr(a, 1, 1) = substr(b, 1, 1) then 1 else 0 end + case when length(a) > 1 and length(b) > 1 and substr(a, 2, 1) = substr(b, 2, 1) then 1 else 0 end) as bigint) as hits,
       cast(sum(greatest(length(a), length(b))) as bigint) as characters from r""")
def character_accuracy(spark, folder):
    rows = events(spark, folder).select(F.col("k").cast("string").alias("truth_number"), (F.col("user_id") % 100).cast("string").alias("number"))
    return I.character_accuracy(rows)
