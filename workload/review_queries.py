"""Requests, queue and applied confirmations."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.domain import REVIEW_OPERATIONS
from actiongrid.functions.text import seconds_text_us
from actiongrid.operators import manifest as M
from actiongrid.operators import review as R
from actiongrid.plans.ordered import in_order, numbered, range_count
from actiongrid.session import scratch_path
from actiongrid.sources.documents import CONFIRMATION_FIELDS, REQUEST_FIELDS, item_cells, table_cells
from actiongrid.sources.manifest_csv import require_unique_index, scan_manifest
from actiongrid.sources.sinks import write_csv, write_review_queue

from .bindings import clock_of_seconds_sql, events, manifest_rows, manifest_sql
from .registry import query, table



def operation(position):
    return F.element_at(F.array(*[F.lit(x) for x in REVIEW_OPERATIONS]), (position % 4 + 1).cast("int"))


OPS_SQL = "['keep','relabel','move_window','add_window'][event_id % 4 + 1]"
NEW_ACTION_SQL = "case when k % 6 = 0 then 'dig' else action end"
SEC_SQL = lambda us: f"case when ({us}) % 1000000 = 0 then cast(({us}) // 1000000 as varchar) else (({us}) // 1000000) || '.' || rtrim(printf('%06d', ({us}) % 1000000), '0') end"
MANIFEST = f"with {manifest_sql(clean=True)}"
NOTES_SQL = "'n' || k || case when k % 4 = 0 then '; Reviewer note: see this' else '' end"


def record_count(spark, folder):
    return table(spark, folder, "events").count()


def requests(spark, folder):
    """Every record is requested; a suggested time shifts the start by one second."""
    e = events(spark, folder)
    rows = e.select(
        (F.col("event_id") + 1).alias("record_index"), (F.col("event_id") + 1).alias("position"),
        F.concat(F.lit(" look at "), "event_type", F.lit(" ")).alias("reason"),
        operation(F.col("event_id")).alias("suggested_operation"),
        F.when(F.col("k") % 6 == 0, "dig").alias("suggested_action"),
        F.when(F.col("k") % 2 == 0, (F.col("start_us") + 1_000_000) / F.lit(1e6)).alias("suggested_start_seconds"),
        F.when(F.col("k") % 2 == 0, (F.col("end_us") + 1_000_000) / F.lit(1e6)).alias("suggested_end_seconds"),
    )
    return table_cells(rows, REQUEST_FIELDS, position="position")


def confirmations(spark, folder, *, faulty=False):
    """Confirmations of all requests: times one second later, 'dig' where suggested. With
    `faulty` some have a changed snapshot, another operation or a reversed time."""
    m = manifest_rows(spark, folder, clean=True)
    e = events(spark, folder).withColumn("record_index", F.col("event_id") + 1).drop("event_id")
    bad = F.lit(faulty)
    joined = m.select(
        "record_index", "start_seconds", "end_seconds", "team_side", "player_number", "video_path", "label", "split", "notes",
        F.when(F.col("crop_x1") == "", "").otherwise(F.concat_ws(",", "crop_x1", "crop_y1", "crop_x2", "crop_y2")).alias("crop"),
    ).join(e.select("record_index", "start_us", "end_us", "k", "action", "event_type"), "record_index")
    k = F.col("k")
    rows = joined.select(
        "record_index", F.col("record_index").alias("position"),
        F.col("video_path").alias("source_video_path"),
        (F.col("start_seconds").cast("double") + F.when(bad & (k % 11 == 0), 0.0000005).otherwise(0.0)).alias("source_start_seconds"),
        F.col("end_seconds").cast("double").alias("source_end_seconds"),
        F.trim("label").alias("source_action"), F.col("split").alias("source_split"), F.col("team_side").alias("source_team_side"),
        F.col("player_number").alias("source_player_number"), F.col("crop").alias("source_crop"),
        F.when(bad & (k % 13 == 0), "other").otherwise(F.trim("notes")).alias("source_notes"),
        F.when(bad & (k % 17 == 0), "keep").otherwise(operation(F.col("record_index") - 1)).alias("operation"),
        F.when(k % 6 == 0, "dig").otherwise(F.col("action")).alias("confirmed_action"),
        ((F.col("start_us") + 1_000_000) / F.lit(1e6)).alias("confirmed_start_seconds"),
        F.when(bad & (k % 19 == 0), F.lit(0.0)).otherwise((F.col("end_us") + 2_000_000) / F.lit(1e6)).alias("confirmed_end_seconds"),
        F.when(k % 5 == 0, F.concat(F.lit(" by "), "event_type")).otherwise("").alias("confirmation_note"),
    )
    return table_cells(rows, CONFIRMATION_FIELDS, position="position")


@query("review_queue", MANIFEST + f"""
select record_index, 'clips/../u' || user_id || '.mp4' as video_path,
  {clock_of_seconds_sql('s_us / 1000000.0::double')} as current_start_time, {clock_of_seconds_sql('e_us / 1000000.0::double')} as current_end_time, label as current_action, split,
  case when k % 2 = 0 then 'near' else 'far' end as team_side, case when k % 5 = 0 then '' else cast(k % 20 as varchar) end as player_number,
  case when has_crop then '0,10,' || (k * 14 + 10) || ',700' else '' end as crop,
  {NOTES_SQL} as source_notes, case when k % 4 = 0 then 'see this' else '' end as reviewer_note,
  'look at ' || event_type as review_reason, {OPS_SQL} as suggested_operation, case when k % 6 = 0 then 'dig' else '' end as suggested_action,
  case when k % 2 = 0 then {clock_of_seconds_sql('(start_us + 1000000) / 1000000.0::double')} else '' end as suggested_start_time,
  case when k % 2 = 0 then {clock_of_seconds_sql('(end_us + 1000000) / 1000000.0::double')} else '' end as suggested_end_time,
  '' as confirmed_action, '' as confirmed_start_time, '' as confirmed_end_time, '' as confirmation_note
from m""")
def review_queue(spark, folder):
    """Written as CSV in record order and read back by name."""
    manifest = M.check_manifest(manifest_rows(spark, folder, clean=True), video_root="/media")
    valid = R.check_requests(requests(spark, folder), record_count(spark, folder))
    path = write_review_queue(R.review_queue(manifest, valid), scratch_path(spark, "queue"), bom=False)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in back.columns
            if c != "record_index" and not c.endswith("_seconds")]
    return back.select(F.col("record_index").cast("long").alias("record_index"), *text)


def parts(spark, folder):
    """The clean manifest written as CSV parts, four or more, and scanned again."""
    rows = manifest_rows(spark, folder, clean=True)
    columns = [c for c in rows.columns if c != "record_index"]
    cut = in_order(rows, "record_index", parts=max(4, range_count(spark, record_count(spark, folder))))
    return scan_manifest(spark, write_csv(cut, scratch_path(spark, "parts"), columns))


@query("review_queue_parts", MANIFEST + f"""
select record_index, 'clips/../u' || user_id || '.mp4' as video_path, s_us / 1000000.0::double as current_start_seconds, e_us / 1000000.0::double as current_end_seconds,
  {clock_of_seconds_sql('s_us / 1000000.0::double')} as current_start_time, {clock_of_seconds_sql('e_us / 1000000.0::double')} as current_end_time, label as current_action, split,
  case when k % 2 = 0 then 'near' else 'far' end as team_side, case when k % 5 = 0 then '' else cast(k % 20 as varchar) end as player_number,
  case when has_crop then '0,10,' || (k * 14 + 10) || ',700' else '' end as crop,
  {NOTES_SQL} as source_notes, case when k % 4 = 0 then 'see this' else '' end as reviewer_note,
  'look at ' || event_type as review_reason, {OPS_SQL} as suggested_operation, case when k % 6 = 0 then 'dig' else '' end as suggested_action,
  case when k % 2 = 0 then (start_us + 1000000) / 1000000.0::double end as suggested_start_seconds,
  case when k % 2 = 0 then (end_us + 1000000) / 1000000.0::double end as suggested_end_seconds,
  case when k % 2 = 0 then {clock_of_seconds_sql('(start_us + 1000000) / 1000000.0::double')} else '' end as suggested_start_time,
  case when k % 2 = 0 then {clock_of_seconds_sql('(end_us + 1000000) / 1000000.0::double')} else '' end as suggested_end_time,
  '' as confirmed_action, '' as confirmed_start_time, '' as confirmed_end_time, '' as confirmation_note
from m""")
def review_queue_parts(spark, folder):
    """All columns of the queue, over a manifest of several files."""
    manifest = M.check_manifest(require_unique_index(parts(spark, folder)))
    valid = R.check_requests(requests(spark, folder), record_count(spark, folder))
    queue = R.review_queue(manifest, valid)
    return queue.withColumns({f"suggested_{x}_seconds": F.col(f"suggested_{x}_seconds").try_cast("double") for x in ("start", "end")})


BAD_REQUESTS = """
rq as (
  select event_id + 1 as position, k, user_id, event_id,
         case when k % 10 = 0 then 1 + user_id else event_id + 1 end - case when k = 99 then 100000000 else 0 end as record_index
  from ev
),
fq as (select record_index, min(position) as first_position from rq group by record_index),
er as (
  select position,
    case when record_index not between 1 and (select count(*) from events) then 'index_range'
         when position > first_position then 'index_repeated'
         when k = 1 then 'reason' when k = 2 then 'operation' when k = 3 then 'action' when k = 4 then 'operation_missing'
         when k = 5 then 'start_time' when k = 6 then 'time_order' end as code
  from rq join fq using (record_index)
)"""


@query("request_errors", MANIFEST + f", {BAD_REQUESTS} select position, code from er where code is not null")
def request_errors(spark, folder):
    """The first broken rule of every request of a list with repeated and broken ones."""
    k = F.col("k")
    index = F.when(k % 10 == 0, 1 + F.col("user_id")).otherwise(F.col("event_id") + 1) - F.when(k == 99, 100_000_000).otherwise(0)
    rows = events(spark, folder).select(
        (F.col("event_id") + 1).alias("position"), index.alias("record_index"),
        F.when(k == 1, "  ").otherwise("why").alias("reason"),
        F.when(k == 2, "drop").when(k == 4, F.lit(None)).otherwise("keep").alias("suggested_operation"),
        F.when(k == 3, "spike").otherwise("set").alias("suggested_action"),
        F.when(k == 5, -1.0).when(k == 6, 5.0).otherwise(1.0).alias("suggested_start_seconds"),
        F.lit(5.0).alias("suggested_end_seconds"),
    )
    found = R.check_requests(table_cells(rows, REQUEST_FIELDS, position="position"), record_count(spark, folder))
    return found.where(F.size("errors") > 0).select("position", F.col("errors")[0]["code"].alias("code"))


@query("request_cells", """
select event_id + 1 as position, case event_id % 6 when 0 then 'int' when 1 then 'number' when 2 then 'bool' when 3 then 'text' when 4 then 'null' else 'absent' end as kind,
  case when event_id % 4 = 0 then 'extra' else '' end as unknown from events""")
def request_cells(spark, folder):
    """JSON items keep the difference between integer, real, boolean, null and missing."""
    v = F.element_at(F.array(*[F.lit(x) for x in ('"record_index":7,', '"record_index":7.0,', '"record_index":true,', '"record_index":"7",', '"record_index":null,', "")]),
                     (F.col("event_id") % 6 + 1).cast("int"))
    extra = F.when(F.col("event_id") % 4 == 0, '"extra":[1],').otherwise("")
    text = F.concat(F.lit("{"), v, extra, F.lit('"reason":"x"}'))
    rows = table(spark, folder, "events").select((F.col("event_id") + 1).alias("position"), F.parse_json(text).alias("item"))
    return item_cells(rows, "item", REQUEST_FIELDS).select(
        "position", F.col("record_index_kind").alias("kind"), F.array_join("unknown_fields", ",").alias("unknown"))


@query("confirmation_errors", MANIFEST + """
select record_index, case when k % 17 = 0 and event_id % 4 <> 0 then 'operation_differs' when k % 19 = 0 then 'time_order'
       when k % 11 = 0 or k % 13 = 0 then 'snapshot' end as code
from m where (k % 17 = 0 and event_id % 4 <> 0) or k % 19 = 0 or k % 11 = 0 or k % 13 = 0""")
def confirmation_errors(spark, folder):
    found = R.check_confirmations(confirmations(spark, folder, faulty=True), requests(spark, folder), manifest_rows(spark, folder, clean=True))
    return found.where(F.size("errors") > 0).select("record_index", F.col("errors")[0]["code"].alias("code"))


APPLIED = MANIFEST + f""",
c as (select *, {OPS_SQL} as operation, {NEW_ACTION_SQL} as new_label, start_us + 1000000 as ns, end_us + 2000000 as ne,
      case when k % 5 = 0 then '; reviewer note: by ' || event_type else '' end as tail, {NOTES_SQL} as old_notes from m),
t as (select *, {SEC_SQL('ns')} as nst, {SEC_SQL('ne')} as net, {SEC_SQL('s_us')} as ost, {SEC_SQL('e_us')} as oet,
      (s_us // 1000000) || '.' || printf('%06d', s_us % 1000000) as raw_start, (e_us // 1000000) || '.' || printf('%06d', e_us % 1000000) as raw_end from c),
applied as (
  select 0 as origin, record_index as ordinal, case when operation = 'add_window' then raw_start else nst end as start_seconds,
         case when operation = 'add_window' then raw_end else net end as end_seconds,
         case when operation = 'add_window' then ' ' || label else new_label end as label,
         case when operation = 'add_window' then null else 'reviewed' end as review_status,
         case when operation = 'add_window' then 'n' || k || case when k % 4 = 0 then '; Reviewer note: see this ' else '' end
              else old_notes || '; Second-pass human-reviewed; operation=' || operation || '; prior=' || label || '@' || ost || '-' || oet
                   || '; confirmed=' || new_label || '@' || nst || '-' || net || tail end as notes
  from t
  union all
  select 1, record_index, nst, net, new_label, 'reviewed',
         old_notes || '; Second-pass human-reviewed; added from source record ' || record_index || '; confirmed=' || new_label || '@' || nst || '-' || net || tail
  from t where operation = 'add_window'
)"""


@query("apply_review", APPLIED + " select * from applied")
def apply_review(spark, folder):
    rows = manifest_rows(spark, folder, clean=True)
    made = R.apply_confirmations(rows, confirmations(spark, folder))
    return made.select("origin", "ordinal", "start_seconds", "end_seconds", "label", "review_status", "notes")


@query("apply_review_parts", APPLIED + """
select origin, ordinal, 'clips/../u' || user_id || '.mp4' as video_path, a.start_seconds, a.end_seconds, trim(a.label) as label, upper(split) as split,
  case when k % 2 = 0 then 'near' else 'far' end as team_side, case when k % 5 = 0 then '' else cast(k % 20 as varchar) end as player_number,
  case when has_crop then '0' else '' end as crop_x1, case when has_crop then '10' else '' end as crop_y1,
  case when has_crop then cast(k * 14 + 10 as varchar) else '' end as crop_x2, case when has_crop then '700' else '' end as crop_y2,
  coalesce(a.review_status, '') as review_status, trim(a.notes) as notes
from applied a join t on t.record_index = a.ordinal""")
def apply_review_parts(spark, folder):
    """All columns of the next version, over a manifest of several files."""
    made = R.apply_confirmations(require_unique_index(parts(spark, folder)), confirmations(spark, folder))
    columns = [c for c in made.columns if c not in ("origin", "ordinal", "record_index")]
    return made.select("origin", "ordinal", *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])


@query("apply_counters", APPLIED + """
select (select count(*) from m) as source_records, (select count(*) from t where operation <> 'add_window') as updated_records,
  (select count(*) from t where operation = 'add_window') as added_records,
  (select count(*) from t where operation = 'keep') as keep_changed, (select count(*) from applied) as output_records""")
def apply_counters(spark, folder):
    return R.apply_counters(manifest_rows(spark, folder, clean=True), confirmations(spark, folder))


@query("confirmation_order_breaks", """
with c as (select event_id + 1 as position, case when event_id % 9 = 0 then event_id + 3 else event_id + 1 end as record_index from events)
select a.position, a.record_index, b.record_index as next_index from c a join c b on b.position = a.position + 1 where b.record_index <= a.record_index""")
def confirmation_order_breaks(spark, folder):
    rows = table(spark, folder, "events").select(
        (F.col("event_id") + 1).alias("position"),
        (F.col("event_id") + F.when(F.col("event_id") % 9 == 0, 3).otherwise(1)).alias("record_index"))
    return R.order_breaks(rows)


@query("published_version", APPLIED + """
select row_number() over (order by origin, ordinal) as record_index, 'clips/../u' || user_id || '.mp4' as video_path, a.start_seconds, a.end_seconds,
  trim(a.label) as label, upper(split) as split,
  case when k % 2 = 0 then 'near' else 'far' end as team_side, case when k % 5 = 0 then '' else cast(k % 20 as varchar) end as player_number,
  case when has_crop then '0' else '' end as crop_x1, case when has_crop then '10' else '' end as crop_y1,
  case when has_crop then cast(k * 14 + 10 as varchar) else '' end as crop_x2, case when has_crop then '700' else '' end as crop_y2,
  coalesce(a.review_status, '') as review_status, trim(a.notes) as notes
from applied a join t on t.record_index = a.ordinal""")
def published_version(spark, folder):
    """The applied rows checked, written as a new version and read back, all rows and columns."""
    rows = manifest_rows(spark, folder, clean=True)
    made = R.apply_confirmations(rows, confirmations(spark, folder)).drop("record_index")
    version = numbered(made, ("origin", "ordinal"), "record_index")
    columns = [c for c in rows.columns if c != "record_index"] + ["review_status"]
    path = scratch_path(spark, "version")
    M.publish_manifest(version, columns, path, video_root="/media")
    back = scan_manifest(spark, path)
    return back.select("record_index", *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])


@query("seconds_round_trip", MANIFEST + f" select record_index, {SEC_SQL('s_us')} as text from m")
def seconds_round_trip(spark, folder):
    return M.check_manifest(manifest_rows(spark, folder, clean=True)).select("record_index", seconds_text_us("start_us").alias("text"))
