"""Manifest validation, summary and publication.

Every rule is one predicate; a row carries the list of rules it breaks in a fixed
order. The report stays lazy. Strict use raises for the first row and its first rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import ACTION_LABELS, CROP, CROP_COLUMNS, ERROR, MANIFEST_REQUIRED, SPLITS, ManifestError
from ..functions.numbers import seconds_to_us
from ..functions.text import file_name, float_value, int_of_stripped, optional_text, resolve_path, stripped_or_empty
from ..plans.guards import columns_present
from ..plans.literal import domain_table
from ..plans.ordered import in_order
from ..session import scratch_path


ERRORS = f"array<{ERROR.simpleString()}>"


def error(code: str, broken: Column, message: Column | str) -> Column:
    """A list with one error, or an empty list."""
    text = F.lit(message) if isinstance(message, str) else message
    found = F.array(F.struct(F.lit(code).alias("code"), text.alias("message"))).cast(ERRORS)
    return F.when(F.coalesce(broken, F.lit(False)), found).otherwise(F.array().cast(ERRORS))


def error_list(*errors: Column) -> Column:
    """All errors in rule order. Concatenation stays inside generated code."""
    return F.concat(*errors)


def _cell(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def require_columns(rows: DataFrame) -> None:
    missing = columns_present(rows, MANIFEST_REQUIRED)
    if missing:
        raise ManifestError("missing_columns", ", ".join(missing))


def check_manifest(
    rows: DataFrame,
    *,
    video_root: str = "/",
    allowed_labels: Sequence[str] = ACTION_LABELS,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Typed rows with an `errors` list. Input: text columns plus record_index.

    `existing` (column video_path) switches the file check on. The text of the times is
    kept as start_text and end_text: reviews compare it exactly."""
    require_columns(rows)
    crops = [stripped_or_empty(_cell(rows, c)) for c in CROP_COLUMNS]
    given = sum((F.when(c != "", 1).otherwise(0) for c in crops), F.lit(0))
    numbers = [int_of_stripped(c) for c in crops]
    path = stripped_or_empty("video_path")
    carried = [c for c in ("source_file", "extra_cells", "review_status", "notes") if c in rows.columns]
    typed = rows.select(
        "record_index", *carried,
        path.alias("raw_path"),
        resolve_path(path, video_root).alias("video_path"),
        F.col("start_seconds").alias("start_text"), F.col("end_seconds").alias("end_text"),
        float_value("start_seconds").alias("start_seconds"),
        float_value("end_seconds").alias("end_seconds"),
        stripped_or_empty("label").alias("label"),
        F.lower(stripped_or_empty("split")).alias("split"),
        optional_text(_cell(rows, "team_side")).alias("team_side"),
        optional_text(_cell(rows, "player_number")).alias("player_number"),
        given.alias("__given"), F.array(*numbers).alias("__crop"),
    )
    exists = F.lit(True)
    if existing is not None:
        known = existing.select("video_path").distinct().withColumn("__exists", F.lit(True))
        typed = typed.join(known, "video_path", "left")
        exists = F.coalesce("__exists", F.lit(False))

    start, end, box = F.col("start_seconds"), F.col("end_seconds"), F.col("__crop")
    infinite = [float("inf"), float("-inf")]
    not_finite = F.isnan(start) | F.isnan(end) | start.isin(infinite) | end.isin(infinite)
    has_crop, sane = F.col("__given") == 4, _sane(box)
    whole = F.lit(True)
    for i in range(4):
        whole = whole & F.get(box, F.lit(i)).isNotNull()
    errors = error_list(
        error("bad_time", start.isNull() | end.isNull(), "start_seconds or end_seconds is no number"),
        error("empty_path", F.col("raw_path") == "", "video_path is empty"),
        error("unknown_label", ~F.col("label").isin(*allowed_labels),
              F.concat(F.lit("label outside of the domain: "), F.col("label"))),
        error("bad_split", ~F.col("split").isin(*SPLITS),
              F.concat(F.lit("split outside of the domain: "), F.col("split"))),
        error("not_finite", not_finite, "times must be finite"),
        error("bad_order", ~not_finite & ((start < 0) | (end <= start)), "0 <= start < end does not hold"),
        error("missing_file", ~exists, F.concat(F.lit("no such file: "), F.col("video_path"))),
        error("crop_incomplete", F.col("__given").between(1, 3), "a crop needs four values or none"),
        error("crop_not_integer", has_crop & ~whole, "crop values must be integers"),
        error("crop_invalid", has_crop & whole & ~sane, "crop corners are negative or reversed"),
    )
    corners = [F.get(box, F.lit(i)).try_cast("int").alias(f.name) for i, f in enumerate(CROP.fields)]
    kept = [c for c in typed.columns if not c.startswith("__")]
    return typed.select(
        *kept,
        errors.alias("errors"),
        F.when(has_crop & F.coalesce(sane, F.lit(False)), F.struct(*corners)).alias("crop"),
        seconds_to_us(start).alias("start_us"), seconds_to_us(end).alias("end_us"),
    )


def _sane(box: Column) -> Column:
    """Corners are not negative and in order; null if one is missing."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    return (x1 >= 0) & (y1 >= 0) & (x2 > x1) & (y2 > y1)


def error_rows(checked: DataFrame) -> DataFrame:
    """Long report: record_index, rule (position in the row's list), code, message.

    The outer explode is deliberate: an inner one makes Spark push `size(errors) > 0` below
    the parsing projection and evaluate every rule twice, outside of its shared subterms."""
    keys = [c for c in ("source_file", "record_index") if c in checked.columns]
    return (
        checked.select(*keys, F.posexplode_outer("errors").alias("rule", "e"))
        .where(F.col("e").isNotNull())
        .select(*keys, "rule", "e.code", "e.message")
    )


def first_error(checked: DataFrame) -> DataFrame:
    """The error strict mode raises: first row, first rule. One aggregate, no sort and, for
    the reason given in `error_rows`, no filter on `errors`."""
    keys = [c for c in ("source_file", "record_index") if c in checked.columns]
    head = F.get("errors", F.lit(0))
    found = F.min_by(
        F.struct("record_index", head.alias("e")), F.when(F.size("errors") > 0, F.struct(*keys))
    )
    return (
        checked.agg(found.alias("f")).where("f is not null")
        .select("f.record_index", "f.e.code", "f.e.message")
    )


def capped_report(checked: DataFrame, limit: int = 100) -> DataFrame:
    """The first `limit` errors for display, each beside the full error count."""
    errors = error_rows(checked)
    total = errors.agg(F.count(F.lit(1)).alias("total_errors"))
    order = [c for c in ("source_file", "record_index", "rule") if c in errors.columns]
    # the right side is one row by construction
    return errors.orderBy(*order).limit(limit).join(F.broadcast(total), F.lit(True))


def split_leakage(checked: DataFrame) -> DataFrame:
    """Videos found in more than one split, with the sorted splits (at most three)."""
    return (
        checked.where(F.col("split").isin(*SPLITS)).groupBy("video_path")
        .agg(F.sort_array(F.collect_set("split")).alias("splits"))
        .where(F.size("splits") > 1)
    )


def leakage_text(leaks: DataFrame) -> DataFrame:
    """One line per leaking video: name: split, split."""
    return leaks.select(
        "video_path",
        F.concat(file_name("video_path"), F.lit(": "), F.array_join("splits", ", ")).alias("detail"),
    )


def require_valid(checked: DataFrame, *, shown: int = 20) -> DataFrame:
    """Raise for the first broken rule, an empty table or split leakage. The whole detail of a
    leakage is a table that the error names; `shown` of its lines are quoted."""
    bad = first_error(checked).first()
    if bad is not None:
        raise ManifestError(bad.code, bad.message, bad.record_index + 1)
    if checked.isEmpty():
        raise ManifestError("empty", "no data rows")
    leaks = leakage_text(split_leakage(checked))
    if not leaks.isEmpty():
        path = scratch_path(checked.sparkSession, "split-leakage")
        leaks.orderBy("video_path").select("detail").write.text(path)
        lines = checked.sparkSession.read.text(path)
        head = "; ".join(sorted(r.value for r in lines.orderBy("value").limit(shown).collect()))
        raise ManifestError("split_leakage", f"{head} (all {lines.count()} lines: {path})")
    return checked


def manifest_summary(checked: DataFrame) -> DataFrame:
    """Long form (metric, key, value). All three splits appear in videos_by_split.

    One shuffle on video first shrinks the table to (video, split, label) counts."""
    cells = checked.groupBy("video_path", "split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("us")
    )
    sets = cells.groupingSets(
        [[], ["split"], ["label"]], "split", "label",
    ).agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("us").alias("us"),
        F.count_distinct("video_path").alias("videos"),
    )
    item = lambda m, k, v: F.struct(F.lit(m).alias("metric"), k.alias("key"), v.cast("long").alias("value"))
    none = F.lit("")
    whole = F.array(
        item("records", none, F.coalesce("n", F.lit(0))), item("videos", none, F.col("videos")),
        item("duration_us", none, F.coalesce("us", F.lit(0))),
    )
    by_split = F.array(item("records_by_split", F.col("split"), F.col("n")),
                       item("videos_by_split", F.col("split"), F.col("videos")))
    by_label = F.array(item("records_by_label", F.col("label"), F.col("n")))
    rows = sets.select(F.inline(F.when(F.col("g") == 3, whole).when(F.col("g") == 1, by_split).otherwise(by_label)))
    zeros = domain_table(checked.sparkSession, SPLITS, name="key").select(
        F.lit("videos_by_split").alias("metric"), "key", F.lit(0).cast("long").alias("value")
    )
    return rows.unionByName(zeros).groupBy("metric", "key").agg(F.sum("value").alias("value"))


def summary_document(summary: DataFrame) -> dict:
    """Nested report form of the few summary rows."""
    doc = {"records_by_split": {}, "videos_by_split": {}, "records_by_label": {}}
    for r in summary.orderBy("metric", "key").collect():
        if r.key == "" and r.metric in ("records", "videos", "duration_us"):
            doc[r.metric] = r.value
        else:
            doc[r.metric][r.key] = r.value
    doc["duration_seconds"] = round(doc.pop("duration_us", 0) / 1e6, 3)
    return doc


def bounds_violations(checked: DataFrame, media: DataFrame) -> DataFrame:
    """Annotations that end more than one frame after their video."""
    facts = media.select("video_path", "duration_seconds", "fps")
    return checked.join(facts, "video_path").where(
        F.col("end_seconds") > F.col("duration_seconds") + F.lit(1.0) / F.col("fps")
    )


def without_media(checked: DataFrame, media: DataFrame) -> DataFrame:
    return checked.join(media.select("video_path"), "video_path", "left_anti")


def crop_violations(checked: DataFrame, media: DataFrame) -> DataFrame:
    """Crops that leave the frame of their video."""
    c = F.col("crop")
    inside = (
        (c["x1"] >= 0) & (c["y1"] >= 0) & (c["x2"] > c["x1"]) & (c["y2"] > c["y1"])
        & (c["x2"] <= F.col("width")) & (c["y2"] <= F.col("height"))
    )
    return checked.where(c.isNotNull()).join(media.select("video_path", "width", "height"), "video_path").where(~inside)


def require_train_and_val(checked: DataFrame) -> None:
    seen = {r.split for r in checked.where(F.col("split").isin("train", "val")).select("split").distinct().collect()}
    for name in ("train", "val"):
        if name not in seen:
            raise ManifestError("split_missing", f"no {name} rows")


def load_manifest(spark, path: str, **options) -> DataFrame:
    """Scan, check and require validity."""
    from ..session import durable
    from ..sources.manifest_csv import scan_manifest

    return require_valid(check_manifest(durable(scan_manifest(spark, path)), **options))


def publish_manifest(rows: DataFrame, columns: Sequence[str], path: str, *, inputs=(), **options) -> dict:
    """Check the rows that would be written, write them beside a path that must not exist, read
    them back, check again and rename. A version that fails a check leaves nothing behind.

    Rows are written in the order of record_index, if they have one, and get it again when the
    version is scanned."""
    from ..plans.guards import output_apart_from_inputs
    from ..session import durable
    from ..sources.manifest_csv import scan_manifest
    from ..sources.sinks import publish, write_csv

    output_apart_from_inputs(path, inputs)
    require_valid(check_manifest(rows, **options))
    if "record_index" in rows.columns:
        rows = in_order(rows, "record_index")

    def check(staged: str) -> dict:
        stored = check_manifest(durable(scan_manifest(rows.sparkSession, staged)), **options)
        return summary_document(manifest_summary(require_valid(stored)))

    return publish(rows.sparkSession, path, lambda staged: write_csv(rows, staged, columns, inputs=inputs), check)
