"""Windows to events."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.operators import events as E
from actiongrid.sources.sinks import inference_documents

from .bindings import HOUR, LINEITEM_WINDOWS_SQL, WINDOWS_SQL, half_even_sql, islands_sql, lineitem_windows, windows
from .registry import query

MERGE = dict(confidence_threshold=0.3, merge_gap_seconds=12 * 3600.0, min_event_seconds=60.0)
MERGED = islands_sql(WINDOWS_SQL, 300_000, 12 * HOUR, 60_000_000)
LINE_MERGE = dict(confidence_threshold=0.3, merge_gap_seconds=24 * 3600.0, min_event_seconds=7200.0)
LINE_MERGED = islands_sql(LINEITEM_WINDOWS_SQL, 300_000, 24 * HOUR, 2 * HOUR)
TABLE_SQL = f"""
select video_id, format('evt_{{:06d}}', event_no) as event_id,
       {half_even_sql('start_us', '1000')} as start_ms, {half_even_sql('end_us', '1000')} as end_ms,
       action, {half_even_sql('conf_sum', 'n_windows')} / 1000000.0::double as confidence,
       cast(null as varchar) as team_side, cast(null as varchar) as player_number,
       'predicted' as status, 'm1' as model_version, 'sliding_window' as source
from merged"""


@query("merge_events", MERGED + TABLE_SQL)
def merge_events(spark, folder):
    return E.event_table(E.merge_windows(windows(spark, folder), **MERGE), model_version="m1")


@query("merge_events_hot_videos", MERGED + TABLE_SQL)
def merge_events_hot_videos(spark, folder):
    """The same events with the fuller videos treated as too big for one task."""
    return E.event_table(E.merge_windows(windows(spark, folder), max_rows=15, **MERGE), model_version="m1")


@query("merge_events_lineitem", LINE_MERGED + " select video_id, event_no, start_us, end_us, action, conf_sum, n_windows from merged")
def merge_events_lineitem(spark, folder):
    return E.merge_windows(lineitem_windows(spark, folder), **LINE_MERGE)


@query("event_counts_by_action", MERGED + """
select action, count(*) as events, cast(sum(n_windows) as bigint) as windows, max(end_us - start_us) as longest_us
from merged group by action""")
def event_counts_by_action(spark, folder):
    return E.merge_windows(windows(spark, folder), **MERGE).groupBy("action").agg(
        F.count(F.lit(1)).alias("events"), F.sum("n_windows").alias("windows"),
        F.max(F.col("end_us") - F.col("start_us")).alias("longest_us"),
    )


@query("usable_windows", f"with {WINDOWS_SQL} select * from w where action <> 'background' and conf_micro >= 500000 and end_us > start_us")
def usable_windows(spark, folder):
    return E.usable_windows(windows(spark, folder))


@query("run_counters", MERGED + """
select w.video_id, count(*) as window_count, coalesce(any_value(n), 0) as event_count
from w left join (select video_id, count(*) as n from merged group by video_id) using (video_id)
group by w.video_id""")
def run_counters(spark, folder):
    rows = windows(spark, folder)
    return E.run_counters(rows, E.merge_windows(rows, **MERGE))


@query("inference_documents", MERGED + f""",
parts as (
  select video_id, (row_number() over (partition by video_id order by start_us, end_us, ordinal) - 1) // 25 as part,
         1 as windows, 0 as events, conf_micro, 0 as start_ms from w
  union all
  select video_id, (row_number() over (partition by video_id order by {half_even_sql('start_us', '1000')}, event_no) - 1) // 25,
         0, 1, 0, {half_even_sql('start_us', '1000')} from merged
)
select video_id, part, cast(sum(windows) as bigint) as windows, cast(sum(events) as bigint) as events,
       cast(sum(conf_micro) as bigint) as conf_micro, cast(sum(start_ms) as bigint) as start_ms
from parts group by video_id, part""")
def documents(spark, folder):
    """Nested output documents, read back as JSON and counted."""
    rows = windows(spark, folder)
    events = E.event_table(E.merge_windows(rows, **MERGE), model_version="m1")
    videos = rows.select("video_id").distinct().withColumn("fps", F.lit(30.0))
    made = inference_documents(videos, events, rows, model_version="m1", settings={"stride": 0.4}, part_rows=25)
    schema = (
        "struct<format_version:int,model_version:string,settings:struct<stride:double>,"
        "events:array<struct<event_id:string,start_ms:long>>,windows:array<struct<confidence:double>>>"
    )
    doc = made.withColumn("d", F.from_json("document", schema))
    return doc.where("d.format_version = 1 and d.model_version = 'm1' and d.settings.stride = 0.4").select(
        "video_id", "part", F.size("d.windows").cast("long").alias("windows"), F.size("d.events").cast("long").alias("events"),
        F.aggregate("d.windows", F.lit(0).cast("long"), lambda a, x: a + F.round(x["confidence"] * 1e6).cast("long")).alias("conf_micro"),
        F.aggregate("d.events", F.lit(0).cast("long"), lambda a, x: a + x["start_ms"]).alias("start_ms"),
    )
