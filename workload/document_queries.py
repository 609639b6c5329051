"""Documents and manifests as files: written from all events, read by ranges, checked and applied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from actiongrid.operators import review as R
from actiongrid.plans.ordered import in_order
from actiongrid.session import scratch_path
from actiongrid.sources.documents import CONFIRMATION_FIELDS, REQUEST_FIELDS, read_match, read_results, read_spec
from actiongrid.sources.manifest_csv import scan_csv, scan_manifest
from actiongrid.sources.sinks import write_csv, write_list_document

from .bindings import EVENTS_SQL, events, manifest_rows
from .registry import query
from .review_queries import (
    APPLIED, MANIFEST, NOTES_SQL, OPS_SQL, clock_of_seconds_sql, confirmations, operation, record_count, requests,
)

RANGE = 1 << 16
SPEC_HEAD = {"format_version": 1, "manifest": "manifest.csv", "target_team": "near"}
RESULTS_HEAD = {"format_version": 1, "manifest": "manifest.csv", "spec": "spec.json", "time_precision_seconds": 0.01}


def with_values(text: Column, changes: list[tuple[Column, str, str]]) -> Column:
    """JSON `text` with another value of one plain field: the first (when, field, value) that holds."""
    pattern = value = None
    for when, field, new in changes:
        old, new = F.lit(f'"{field}":("(?:[^"\\\\]|\\\\.)*"|[^,}}]*)'), F.lit(f'"{field}":{new}')
        pattern = F.when(when, old) if pattern is None else pattern.when(when, old)
        value = F.when(when, new) if value is None else value.when(when, new)
    return F.coalesce(F.regexp_replace(text, pattern, value), text)


def json_items(cells, fields):
    """(position, item) of a table of cells; null cells are absent."""
    return cells.select("position", F.to_json(F.struct(*[F.col(f) for f in fields])).alias("item"))


def spec_items(spark, folder):
    """Requests of all events as JSON; twelve values of k break a rule each."""
    e = events(spark, folder)
    k = F.col("k")
    index = F.when(k == 10, 0).when(k == 11, 1).otherwise(F.col("event_id") + 1)
    rows = e.select(
        (F.col("event_id") + 1).alias("position"), "k", index.cast("long").alias("record_index"),
        F.when(k == 1, " \n ").otherwise(F.concat(F.lit(' see [{"'), "event_type", F.lit('"}, "\\ ]'))).alias("reason"),
        F.when(k == 2, "drop").when(k == 4, F.lit(None)).otherwise(operation(F.col("event_id"))).alias("suggested_operation"),
        F.when(k == 3, "spike").otherwise("set").alias("suggested_action"),
        F.when(k == 5, -1.0).when(k == 6, 5.0).otherwise(1.25).alias("suggested_start_seconds"),
        F.when(k == 12, -2.0).otherwise(5.0).alias("suggested_end_seconds"),
    )
    text = F.to_json(F.struct(*[F.col(f) for f in REQUEST_FIELDS]))
    text = F.when(k == 7, '[7, {"record_index": 1}]').when(k == 8, F.concat(F.lit('{"more": [1, "]"], '), F.substring(text, 2, 1_000_000))).otherwise(text)
    return rows.select("position", with_values(text, [(k == 9, "record_index", "true")]).alias("item"))


SPEC_SQL = f"""with {EVENTS_SQL},
rq as (select event_id + 1 as position, k, event_type, event_id,
              case when k = 7 then null when k = 9 or k = 11 then 1 when k = 10 then 0 else event_id + 1 end as record_index from ev),
fq as (select record_index, min(position) as first_position from rq where record_index is not null and k <> 9 group by record_index)
select position, case when k = 7 then null when k = 1 then '' else 'see [{{"' || event_type || '"}}, "\\ ]' end as reason,
  case when k = 7 then 'not_object' when k = 8 then 'unknown_fields' when k = 9 then 'index_type'
       when record_index not between 1 and (select count(*) from events) then 'index_range'
       when position > first_position then 'index_repeated'
       when k = 1 then 'reason' when k = 2 then 'operation' when k = 3 then 'action' when k = 4 then 'operation_missing'
       when k = 5 then 'start_time' when k = 12 then 'end_time' when k = 6 then 'time_order' end as code
from rq left join fq using (record_index)"""


@query("spec_documents", SPEC_SQL)
def spec_documents(spark, folder):
    """One specification of all events in one file: every request with the first rule it breaks."""
    path = write_list_document(SPEC_HEAD, "requests", spec_items(spark, folder), scratch_path(spark, "spec"))
    _, found = read_spec(spark, path, RANGE)
    checked = R.check_requests(found, record_count(spark, folder))
    return checked.select("position", "reason", F.get("errors", F.lit(0))["code"].alias("code"))


def result_items(spark, folder):
    """Confirmations of all events as JSON; fourteen values of k break a rule each."""
    cells = confirmations(spark, folder)
    k = events(spark, folder).select((F.col("event_id") + 1).alias("position"), "k")
    rows = json_items(cells, CONFIRMATION_FIELDS).join(k, "position")
    text, k = F.col("item"), F.col("k")
    text = with_values(text, [(k == n, field, value) for n, field, value in (
        (9, "record_index", '"9"'), (10, "record_index", "0"), (11, "record_index", "1"), (12, "operation", '"drop"'), (13, "confirmed_action", '"spike"'),
        (14, "confirmed_start_seconds", "-1"), (15, "confirmed_end_seconds", '"5"'), (16, "confirmed_end_seconds", "0.0"), (17, "operation", '"keep"'),
        (18, "confirmation_note", "5"), (20, "source_start_seconds", "null"), (21, "source_notes", '"other"'))])
    text = F.when(k == 7, "null").when(k == 8, F.concat(F.lit('{"more": {"a": 1}, '), F.substring(text, 2, 1_000_000))).otherwise(text)
    return rows.select("position", text.alias("item"))


RESULT_SQL = MANIFEST + f""",
rq as (select record_index as position, k, {OPS_SQL} as operation, start_us, s_us, e_us,
              case when k = 7 then null when k = 9 then 9 when k = 10 then 0 when k = 11 then 1 else record_index end as record_index from m),
fq as (select record_index, min(position) as first_position from rq where record_index is not null and k <> 9 group by record_index)
select position, case when k <> 7 then case when k = 20 then null else s_us / 1000000.0::double end end as source_start_seconds,
  case when k = 7 then 'not_object' when k = 8 then 'unknown_fields' when k = 9 then 'index_type' when k = 10 then 'not_requested'
       when position > first_position then 'index_repeated'
       when k = 12 then 'operation'
       when (case when k = 17 then 'keep' else operation end)
            <> (case when k = 11 then 'keep' else operation end) then 'operation_differs'
       when k = 13 then 'action' when k = 14 then 'start_time' when k = 15 then 'end_time' when k = 16 then 'time_order'
       when k = 18 then 'note_type' when k = 20 then 'source_time' when k = 21 then 'snapshot'
       when k = 11 and position <> 1 then 'snapshot' end as code
from rq left join fq using (record_index)"""


@query("result_documents", RESULT_SQL)
def result_documents(spark, folder):
    """One results document of all events in one file, checked against requests and source rows."""
    path = write_list_document(RESULTS_HEAD, "confirmations", result_items(spark, folder), scratch_path(spark, "results"))
    _, found = read_results(spark, path, RANGE)
    checked = R.check_confirmations(found, requests(spark, folder), manifest_rows(spark, folder, clean=True))
    return checked.select("position", "source_start_seconds", F.get("errors", F.lit(0))["code"].alias("code"))


@query("match_segments", f"""with {EVENTS_SQL}
select 's' || event_id as segment_id, k % 5 + 1 as set_number, case when k % 7 = 0 then null else event_type end as phase,
       start_us / 1000000.0::double as start_seconds, end_us / 1000000.0::double as end_seconds,
       '0,10,' || (k + 20) || ',700' as crop from ev""")
def match_segments(spark, folder):
    """The segments of one match document, typed by Spark's own inference."""
    e = events(spark, folder)
    item = F.struct(
        F.concat(F.lit("s"), "event_id").alias("segment_id"), (F.col("k") % 5 + 1).alias("set_number"),
        F.when(F.col("k") % 7 != 0, F.col("event_type")).alias("phase"),
        (F.col("start_us") / F.lit(1e6)).alias("start_seconds"), (F.col("end_us") / F.lit(1e6)).alias("end_seconds"),
        F.array(F.lit(0), F.lit(10), F.col("k") + 20, F.lit(700)).alias("crop"),
    )
    items = e.select((F.col("event_id") + 1).alias("position"), F.to_json(item, {"ignoreNullFields": "false"}).alias("item"))
    head = {"match_id": "m", "teams": [{"name": "a, b"}, {"name": "]"}], "note": 'x "[" \\'}
    path = write_list_document(head, "segments", items, scratch_path(spark, "match"))
    found = read_match(spark, path, "segments", RANGE)
    return found.withColumn("crop", F.array_join(F.col("crop").cast("array<string>"), ","))


def review_files(spark, folder):
    """Manifest, specification and results of all events as files."""
    base = scratch_path(spark, "review")
    rows = manifest_rows(spark, folder, clean=True)
    columns = [c for c in rows.columns if c != "record_index"]
    manifest = write_csv(in_order(rows, "record_index"), f"{base}/manifest.csv", columns)
    wanted = requests(spark, folder).withColumn("suggested_end_seconds", F.col("suggested_end_seconds") + 1)  # no empty window
    spec = write_list_document(SPEC_HEAD, "requests", json_items(wanted, REQUEST_FIELDS), f"{base}/spec.json")
    results = write_list_document(
        RESULTS_HEAD, "confirmations", json_items(confirmations(spark, folder), CONFIRMATION_FIELDS), f"{base}/results.json")
    return manifest, spec, results, f"{base}/output"


@query("review_queue_files", MANIFEST + f"""
select row_number() over (order by record_index) as place, record_index, 'clips/../u' || user_id || '.mp4' as video_path, s_us / 1000000.0::double as current_start_seconds,
  {clock_of_seconds_sql('s_us / 1000000.0::double')} as current_start_time, {clock_of_seconds_sql('e_us / 1000000.0::double')} as current_end_time,
  label as current_action, split, {NOTES_SQL} as source_notes, 'look at ' || event_type as review_reason, {OPS_SQL} as suggested_operation,
  case when k % 6 = 0 then 'dig' end as suggested_action,
  case when k % 2 = 0 then {clock_of_seconds_sql('(end_us + 2000000) / 1000000.0::double')} end as suggested_end_time
from m""")
def review_queue_files(spark, folder):
    """File to file: manifest and specification checked, the queue written; read back part by part in order."""
    manifest, spec, _, output = review_files(spark, folder)
    done = R.prepare_review_queue(spark, manifest, spec, output, video_root="/media")
    back = scan_csv(spark, output, place="place")
    if done["records"] != record_count(spark, folder):
        raise AssertionError(done)
    names = ["record_index", "video_path", "current_start_seconds", "current_start_time", "current_end_time", "current_action", "split",
             "source_notes", "review_reason", "suggested_operation", "suggested_action", "suggested_end_time"]
    seconds, index = (F.col(c).cast(t).alias(c) for c, t in (("current_start_seconds", "double"), ("record_index", "long")))
    return back.select("place", index, seconds, *[c for c in names if c not in ("record_index", "current_start_seconds")])


@query("apply_review_files", APPLIED + """
select row_number() over (order by origin, ordinal) as record_index, 'clips/../u' || user_id || '.mp4' as video_path, a.start_seconds, a.end_seconds,
  trim(a.label) as label, upper(split) as split,
  case when k % 2 = 0 then 'near' else 'far' end as team_side, case when k % 5 = 0 then '' else cast(k % 20 as varchar) end as player_number,
  case when has_crop then '0' else '' end as crop_x1, case when has_crop then '10' else '' end as crop_y1,
  case when has_crop then cast(k * 14 + 10 as varchar) else '' end as crop_x2, case when has_crop then '700' else '' end as crop_y2,
  coalesce(a.review_status, '') as review_status, trim(a.notes) as notes
from applied a join t on t.record_index = a.ordinal""")
def apply_review_files(spark, folder):
    """File to file: all three inputs read and checked, the next version published and read back."""
    manifest, spec, results, output = review_files(spark, folder)
    R.apply_review(spark, manifest, spec, results, output, video_root="/media")
    back = scan_manifest(spark, output)
    columns = [c for c in back.columns if c not in ("record_index", "source_file", "extra_cells")]
    return back.select("record_index", *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])
