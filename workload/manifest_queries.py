"""Manifest scan, rules, summary and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.functions.text import formula_guard
from actiongrid.operators import manifest as M
from actiongrid.plans.ordered import in_order
from actiongrid.session import scratch_path
from actiongrid.sources.manifest_csv import scan_manifest
from actiongrid.sources.media import fingerprints, media_table
from actiongrid.sources.ranges import RANGE_BYTES, listing
from actiongrid.sources.sinks import write_csv

from .bindings import EVENTS_SQL, MEDIA_SQL, manifest_rows, manifest_sql, media
from .registry import query, table

DIRTY, CLEAN = f"with {manifest_sql()}", f"with {manifest_sql(clean=True)}"


def checked(spark, folder, *, clean=False, **kw):
    return M.check_manifest(manifest_rows(spark, folder, clean=clean), video_root="/media", **kw)


SUMMARY = """,
s as (
  select 'records' as metric, '' as key, count(*) as value from m
  union all select 'videos', '', count(distinct video_path) from m
  union all select 'duration_us', '', cast(sum(e_us - s_us) as bigint) from m
  union all select 'records_by_split', split, count(*) from m group by split
  union all select 'records_by_label', label, count(*) from m group by label
  union all select 'videos_by_split', d.split, (select count(distinct video_path) from m where m.split = d.split)
            from (select unnest(['train', 'val', 'test']) as split) d
)
select * from s"""


@query("manifest_summary", CLEAN + SUMMARY)
def manifest_summary(spark, folder):
    return M.manifest_summary(checked(spark, folder, clean=True))


@query("manifest_csv_round_trip", CLEAN + SUMMARY)
def manifest_csv_round_trip(spark, folder):
    """Write the manifest as CSV files, scan them by header name, check and summarize."""
    rows = manifest_rows(spark, folder, clean=True)
    path = scratch_path(spark, "manifest")
    write_csv(rows, path, [c for c in rows.columns if c != "record_index"])
    return M.manifest_summary(M.check_manifest(scan_manifest(spark, path), video_root="/media"))


@query("manifest_csv_cells", DIRTY + """
select code, count(*) as n, cast(sum(coalesce(s_us, 0)) as bigint) as start_us from m group by code""")
def manifest_csv_cells(spark, folder):
    """Broken rows survive the CSV scan cell by cell: counts per first rule."""
    rows = manifest_rows(spark, folder)
    path = scratch_path(spark, "manifest")
    write_csv(rows, path, [c for c in rows.columns if c != "record_index"])
    seen = M.check_manifest(scan_manifest(spark, path), video_root="/media")
    return seen.where("not extra_cells").groupBy(F.get("errors", F.lit(0))["code"].alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("start_us", F.lit(0))).alias("start_us"))


@query("manifest_typed", CLEAN + """
select record_index, video_path, s_us as start_us, e_us as end_us, label, split,
       case when k % 2 = 0 then 'near' else 'far' end as team_side,
       case when k % 5 = 0 then null else cast(k % 20 as varchar) end as player_number,
       case when has_crop then '0,10,' || (k * 14 + 10) || ',700' else '' end as crop
from m""")
def manifest_typed(spark, folder):
    from actiongrid.functions.text import crop_text

    return checked(spark, folder, clean=True).select(
        "record_index", "video_path", "start_us", "end_us", "label", "split", "team_side", "player_number",
        crop_text("crop").alias("crop"))


@query("manifest_errors", DIRTY + " select record_index, 0 as rule, code from m where code is not null")
def manifest_errors(spark, folder):
    return M.error_rows(checked(spark, folder)).drop("message")


@query("first_error", DIRTY + " select record_index, code from m where code is not null order by record_index limit 1")
def first_error(spark, folder):
    return M.first_error(checked(spark, folder)).drop("message")


@query("validation_report", DIRTY + """
select record_index, code, (select count(code) from m) as total_errors
from m where code is not null order by record_index limit 100""")
def validation_report(spark, folder):
    return M.capped_report(checked(spark, folder), 100).drop("message", "rule")


@query("split_leakage", DIRTY + """
select video_path, string_agg(distinct split, ',' order by split) as splits
from m where split in ('train', 'val', 'test') group by video_path having count(distinct split) > 1""")
def split_leakage(spark, folder):
    return M.split_leakage(checked(spark, folder)).withColumn("splits", F.array_join("splits", ","))


@query("leakage_text", DIRTY + """
select video_path, regexp_extract(video_path, '([^/]*)$', 1) || ': ' || string_agg(distinct split, ', ' order by split) as detail
from m where split in ('train', 'val', 'test') group by video_path having count(distinct split) > 1""")
def leakage_text(spark, folder):
    return M.leakage_text(M.split_leakage(checked(spark, folder)))


@query("missing_files", f"""{CLEAN}, {MEDIA_SQL}
select record_index from m where not exists (select 1 from med where med.video_path = m.video_path)""")
def missing_files(spark, folder):
    existing = media_table(media(spark, folder))
    seen = checked(spark, folder, clean=True, existing=existing)
    return M.error_rows(seen).where("code = 'missing_file'").select("record_index")


@query("media_table", f"with {EVENTS_SQL}, {MEDIA_SQL} select video_path, frame_count, duration_seconds from med")
def media_facts(spark, folder):
    return media_table(media(spark, folder)).select("video_path", "frame_count", "duration_seconds")


@query("bounds_violations", f"""{CLEAN}, {MEDIA_SQL}
select record_index, video_path, e_us as end_us from m join med using (video_path)
where e_us / 1000000.0::double > duration_seconds + 1.0::double / fps""")
def bounds_violations(spark, folder):
    found = M.bounds_violations(checked(spark, folder, clean=True), media_table(media(spark, folder)))
    return found.select("record_index", "video_path", "end_us")


@query("annotations_without_media", f"{CLEAN}, {MEDIA_SQL} select record_index from m where video_path not in (select video_path from med)")
def annotations_without_media(spark, folder):
    return M.without_media(checked(spark, folder, clean=True), media_table(media(spark, folder))).select("record_index")


@query("crop_violations", f"""{CLEAN}, {MEDIA_SQL}
select record_index from m join med using (video_path) where has_crop and k * 14 + 10 > 1280""")
def crop_violations(spark, folder):
    return M.crop_violations(checked(spark, folder, clean=True), media_table(media(spark, folder))).select("record_index")


@query("split_presence", CLEAN + " select split, count(*) as n from m where split in ('train', 'val') group by split")
def split_presence(spark, folder):
    rows = checked(spark, folder, clean=True)
    M.require_train_and_val(rows)
    return rows.where(F.col("split").isin("train", "val")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("file_fingerprints", """
select 'group=' || page_id % 40 as folder, cast(sum(strlen(coalesce(html, '')) + 1) as bigint) as length,
       sha256(string_agg(coalesce(html, ''), chr(10) order by page_id) || chr(10)) as sha256
from pages group by page_id % 40""")
def file_fingerprints(spark, folder):
    """Size and SHA-256 of files of pages, one file a group."""
    path = scratch_path(spark, "pages")
    pages = table(spark, folder, "pages").select((F.col("page_id") % 40).alias("group"), "page_id", F.coalesce("html", F.lit("")).alias("value"))
    ordered = pages.repartition("group").sortWithinPartitions("group", "page_id").select("group", "value")
    ordered.write.partitionBy("group").text(path)
    found = fingerprints(spark, f"{path}/group=*")
    return found.select(F.regexp_extract("path", "(group=[0-9]+)", 1).alias("folder"), "length", "sha256")


@query("manifest_csv_one_large_file", CLEAN + """
select record_index, 'clips/../u' || user_id || '.mp4' as video_path, upper(split) as split,
  case when k % 5 = 0 then null else cast(k % 20 as varchar) end as player_number,
  case when k % 3 = 0 then 'two' || chr(10) || 'lines, "' || k || '"' || chr(10) when k % 3 = 1 then '"' else 'n' || k || ',' end as notes
from m""")
def manifest_csv_one_large_file(spark, folder):
    """A single file with line breaks, quotes and commas in its cells, read by many tasks."""
    k = F.col("event_id")
    e = table(spark, folder, "events").select("event_id", F.regexp_extract("props", r'"k": (\d+)', 1).cast("long").alias("k"))
    notes = F.when(F.col("k") % 3 == 0, F.concat(F.lit('two\nlines, "'), F.col("k"), F.lit('"\n'))).when(F.col("k") % 3 == 1, '"').otherwise(
        F.concat(F.lit("n"), F.col("k"), F.lit(",")))
    rows = manifest_rows(spark, folder, clean=True).drop("notes").join(e.select((k + 1).alias("record_index"), notes.alias("notes")), "record_index")
    columns = [c for c in rows.columns if c != "record_index"]
    path = write_csv(in_order(rows, "record_index"), scratch_path(spark, "one-file"), columns, one_file=True)
    size = sum(n for _, n in listing(spark, path))
    found = scan_manifest(spark, path, min(RANGE_BYTES, max(1 << 14, size // 16 + 1)))
    return found.select("record_index", "video_path", "split", "player_number", "notes")


@query("formula_guard", r"""
select doc_id, sha256(case when regexp_matches(t, '^[=+\-@]') then '''' || t else t end) as sha256
from (select doc_id, case when doc_id % 3 = 0 then '=' || text when doc_id % 3 = 1 then '-' || text else text end as t from documents)""")
def guarded_cells(spark, folder):
    cell = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "text")).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), "text")).otherwise(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.sha2(formula_guard(cell), 256).alias("sha256"))
