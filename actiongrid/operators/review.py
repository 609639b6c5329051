"""Human review: request checks, the review queue, and applying confirmed results.

Requests and confirmations are tables of cells with their JSON kinds (see
`sources.documents`). Joins are plain equi joins on record_index; which side is
broadcast is left to the sizes Spark sees at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import ACTION_LABELS, CROP_COLUMNS, REVIEW_OPERATIONS, REVIEW_QUEUE_COLUMNS, ReviewError
from ..functions.text import (
    append_note, audit_note, crop_text, float_value, reviewer_note, seconds_text, strip,
    stripped_or_empty, timecode,
)
from .manifest import error, error_list

NUMERIC = ("int", "number")


def _absent(name: str) -> Column:
    return F.col(f"{name}_kind").isin("absent", "null")


def _outside(name: str, domain: Sequence[str]) -> Column:
    return (F.col(f"{name}_kind") != "text") | ~F.coalesce(F.col(name).isin(*domain), F.lit(False))


def _bad_time(name: str) -> Column:
    value = F.col(name)
    finite = value.isNotNull() & ~F.isnan(value) & (value < float("inf")) & (value >= 0)
    return ~F.col(f"{name}_kind").isin(*NUMERIC) | ~finite


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Mark every occurrence of a record_index after its first."""
    first = rows.where("record_index is not null").groupBy("record_index").agg(
        F.min("position").alias("__first")
    )
    return rows.join(first, "record_index", "left").withColumn(
        "repeated", F.coalesce(F.col("position") > F.col("__first"), F.lit(False))
    ).drop("__first")


def check_requests(requests: DataFrame, record_count: int) -> DataFrame:
    """Requests with the ordered list of rules each one breaks."""
    index_ok = F.col("record_index_kind") == "int"
    times_given = (F.col("suggested_start_seconds_kind") != "absent") | (
        F.col("suggested_end_seconds_kind") != "absent"
    )
    start_given = F.col("suggested_start_seconds_kind") != "absent"
    end_given = F.col("suggested_end_seconds_kind") != "absent"
    start_bad, end_bad = _bad_time("suggested_start_seconds"), _bad_time("suggested_end_seconds")
    rules = error_list(
        error("not_object", ~F.col("is_object"), "a request must be an object"),
        error("unknown_fields", F.size("unknown_fields") > 0, F.array_join("unknown_fields", ", ")),
        error("index_type", ~index_ok, "record_index must be an integer"),
        error("index_range", index_ok & ~F.col("record_index").between(1, record_count),
              "record_index is out of range"),
        error("index_repeated", F.col("repeated"), "record_index was requested before"),
        error("reason", (F.col("reason_kind") != "text") | (strip("reason") == ""), "reason is blank"),
        error("operation", ~_absent("suggested_operation") & _outside("suggested_operation", REVIEW_OPERATIONS),
              "unsupported operation"),
        error("action", ~_absent("suggested_action") & _outside("suggested_action", ACTION_LABELS),
              "unknown action"),
        error("operation_missing", (~_absent("suggested_action") | times_given) & _absent("suggested_operation"),
              "a suggestion needs an operation"),
        error("start_time", start_given & start_bad, "start must be a finite number, not negative"),
        error("end_time", end_given & end_bad, "end must be a finite number, not negative"),
        error("time_order", start_given & end_given & ~start_bad & ~end_bad
              & (F.col("suggested_end_seconds") <= F.col("suggested_start_seconds")),
              "start < end does not hold"),
    )
    return _with_repeats(requests).withColumn("reason", strip("reason")).withColumn("errors", rules)


def first_failure(checked: DataFrame) -> DataFrame:
    """Position, code and message of the first broken rule; no row when all hold."""
    return (
        checked.where(F.size("errors") > 0)
        .agg(F.min_by(F.struct("position", F.col("errors")[0].alias("e")), "position").alias("f"))
        .where("f is not null").select("f.position", "f.e.code", "f.e.message")
    )


def require_no_errors(checked: DataFrame) -> DataFrame:
    bad = first_failure(checked).first()
    if bad is not None:
        raise ReviewError(bad.code, bad.message, bad.position)
    return checked


def review_queue(manifest: DataFrame, requests: DataFrame) -> DataFrame:
    """The 24 queue columns for every request; the confirmation columns stay blank."""
    notes = stripped_or_empty("notes") if "notes" in manifest.columns else F.lit("")
    rows = manifest.withColumn("__notes", notes).join(
        requests.drop("errors", "position"), "record_index"
    )
    blank = F.lit("")
    text = lambda c: F.coalesce(F.col(c), blank)
    number = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    clock = lambda c: F.coalesce(timecode(c), blank)
    return rows.select(
        "record_index", F.col("raw_path").alias("video_path"),
        F.col("start_seconds").alias("current_start_seconds"),
        F.col("end_seconds").alias("current_end_seconds"),
        timecode("start_seconds").alias("current_start_time"),
        timecode("end_seconds").alias("current_end_time"),
        F.col("label").alias("current_action"), "split",
        text("team_side").alias("team_side"), text("player_number").alias("player_number"),
        crop_text("crop").alias("crop"),
        F.col("__notes").alias("source_notes"), reviewer_note("__notes").alias("reviewer_note"),
        F.col("reason").alias("review_reason"),
        text("suggested_operation").alias("suggested_operation"),
        text("suggested_action").alias("suggested_action"),
        number("suggested_start_seconds").alias("suggested_start_seconds"),
        number("suggested_end_seconds").alias("suggested_end_seconds"),
        clock("suggested_start_seconds").alias("suggested_start_time"),
        clock("suggested_end_seconds").alias("suggested_end_time"),
        *[blank.alias(c) for c in REVIEW_QUEUE_COLUMNS[-4:]],
    ).select(*REVIEW_QUEUE_COLUMNS)


def _source_cells(rows: DataFrame) -> DataFrame:
    """What a confirmation must have seen of its source row."""
    cell = lambda name: stripped_or_empty(name) if name in rows.columns else F.lit("")
    return rows.select(
        "record_index",
        cell("video_path").alias("row_video_path"), cell("label").alias("row_action"),
        cell("split").alias("row_split"), cell("team_side").alias("row_team_side"),
        cell("player_number").alias("row_player_number"), cell("notes").alias("row_notes"),
        F.concat_ws(",", *[F.nullif(cell(c), F.lit("")) for c in CROP_COLUMNS]).alias("row_crop"),
        float_value("start_seconds").alias("row_start"), float_value("end_seconds").alias("row_end"),
    )


def check_confirmations(confirmations: DataFrame, requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Confirmations joined to their request and source row, with the rules they break.
    The snapshot is compared exactly, times as numbers."""
    wanted = requests.select(
        "record_index", F.lit(True).alias("__requested"),
        F.col("suggested_operation").alias("__operation"),
    )
    joined = (
        _with_repeats(confirmations)
        .join(wanted, "record_index", "left")
        .join(_source_cells(rows), "record_index", "left")
    )
    requested = F.coalesce("__requested", F.lit(False))
    operation_bad = _outside("operation", REVIEW_OPERATIONS)
    start_bad, end_bad = _bad_time("confirmed_start_seconds"), _bad_time("confirmed_end_seconds")
    same = F.lit(True)
    for name in ("video_path", "action", "split", "team_side", "player_number", "crop", "notes"):
        same = same & (F.col(f"source_{name}_kind") == "text") & F.col(f"source_{name}").eqNullSafe(F.col(f"row_{name}"))
    same = same & F.col("source_start_seconds").eqNullSafe(F.col("row_start"))
    same = same & F.col("source_end_seconds").eqNullSafe(F.col("row_end"))
    rules = error_list(
        error("not_object", ~F.col("is_object"), "a confirmation must be an object"),
        error("unknown_fields", F.size("unknown_fields") > 0, F.array_join("unknown_fields", ", ")),
        error("index_type", F.col("record_index_kind") != "int", "record_index must be an integer"),
        error("not_requested", ~requested, "record_index was not requested"),
        error("index_repeated", F.col("repeated"), "record_index was confirmed before"),
        error("operation", operation_bad, "unsupported operation"),
        error("operation_differs", ~operation_bad & ~F.col("operation").eqNullSafe(F.col("__operation")),
              "operation differs from the request"),
        error("action", _outside("confirmed_action", ACTION_LABELS), "unknown action"),
        error("start_time", start_bad, "confirmed start must be finite, not negative"),
        error("end_time", end_bad, "confirmed end must be finite, not negative"),
        error("time_order", ~start_bad & ~end_bad
              & (F.col("confirmed_end_seconds") <= F.col("confirmed_start_seconds")), "start < end does not hold"),
        error("note_type", ~F.col("confirmation_note_kind").isin("text", "absent"), "the note must be text"),
        error("source_time", _bad_time("source_start_seconds") | _bad_time("source_end_seconds"),
              "source times must be finite, not negative"),
        error("snapshot", requested & ~same, "the source row has changed"),
    )
    return joined.withColumn("errors", rules).drop("__requested", "__operation")


def order_breaks(confirmations: DataFrame) -> DataFrame:
    """Positions whose successor has a smaller record_index: an equi join of neighbours
    instead of a sort of the whole table."""
    here = confirmations.select("position", "record_index")
    following = confirmations.select(
        (F.col("position") - 1).alias("position"), F.col("record_index").alias("next_index")
    )
    return here.join(following, "position").where(F.col("next_index") <= F.col("record_index"))


def require_complete(confirmations: DataFrame, requests: DataFrame) -> None:
    if confirmations.count() != requests.count():
        raise ReviewError("incomplete", "every request needs exactly one confirmation")


def apply_confirmations(rows: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Source rows with confirmed values, followed by the added rows.

    Every operation writes time, label, status and note, `keep` included. `add_window`
    leaves its source row alone and adds a changed copy. Sort by (origin, ordinal) for
    the file order."""
    for name in ("review_status", "notes"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    source_columns = [c for c in rows.columns if c not in ("source_file", "extra_cells", "record_index")]
    changes = confirmations.select(
        "record_index", F.col("position").alias("__position"), "operation",
        "confirmed_action", seconds_text("confirmed_start_seconds").alias("__start"),
        seconds_text("confirmed_end_seconds").alias("__end"),
        audit_note(
            record_index=F.col("record_index"), operation=F.col("operation"),
            prior_action=F.col("source_action"),
            prior_start=seconds_text("source_start_seconds"), prior_end=seconds_text("source_end_seconds"),
            action=F.col("confirmed_action"),
            start=seconds_text("confirmed_start_seconds"), end=seconds_text("confirmed_end_seconds"),
            note=stripped_or_empty("confirmation_note"),
        ).alias("__note"),
    )
    new_values = {
        "start_seconds": F.col("__start"), "end_seconds": F.col("__end"),
        "label": F.col("confirmed_action"), "review_status": F.lit("reviewed"),
        "notes": append_note("notes", F.col("__note")),
    }
    hit = F.col("__note").isNotNull()
    changed = changes.where(F.col("operation") != "add_window")
    kept = rows.join(changed, "record_index", "left").select(
        F.lit(0).alias("origin"), F.col("record_index").alias("ordinal"), "record_index",
        *[(F.when(hit, new_values[c]).otherwise(F.col(c)) if c in new_values else F.col(c)).alias(c)
          for c in source_columns],
    )
    added = rows.join(changes.where(F.col("operation") == "add_window"), "record_index").select(
        F.lit(1).alias("origin"), F.col("__position").alias("ordinal"), "record_index",
        *[(new_values[c] if c in new_values else F.col(c)).alias(c) for c in source_columns],
    )
    return kept.unionByName(added)


def apply_counters(rows: DataFrame, confirmations: DataFrame) -> DataFrame:
    """source, updated, added and output record counts, and `keep`s that moved or relabelled."""
    ops = confirmations.agg(
        F.count_if(F.col("operation") != "add_window").alias("updated_records"),
        F.count_if(F.col("operation") == "add_window").alias("added_records"),
        F.count_if(
            (F.col("operation") == "keep")
            & ((F.col("confirmed_action") != F.col("source_action"))
               | (F.col("confirmed_start_seconds") != F.col("source_start_seconds"))
               | (F.col("confirmed_end_seconds") != F.col("source_end_seconds")))
        ).alias("keep_changed"),
    )
    total = rows.agg(F.count(F.lit(1)).alias("source_records"))
    # both sides are one row by construction
    return total.join(F.broadcast(ops), F.lit(True)).withColumn(
        "output_records", F.col("source_records") + F.col("added_records")
    )


def prepare_review_queue(spark, manifest: str, spec: str, output: str, **options) -> dict:
    """File to file: check manifest and spec, write the queue, return the counters."""
    from ..plans.guards import output_apart_from_inputs
    from ..session import durable
    from ..sources.documents import read_spec
    from ..sources.manifest_csv import require_unique_index, scan_manifest
    from ..sources.sinks import write_review_queue
    from .manifest import check_manifest, require_valid

    output_apart_from_inputs(output, (manifest, spec))
    head, requests = read_spec(spark, spec)
    require_same_name("manifest", head["manifest"], manifest)
    raw = require_unique_index(durable(scan_manifest(spark, manifest)))
    checked = require_valid(check_manifest(raw, **options))
    valid = require_no_errors(check_requests(requests, checked.count()))
    write_review_queue(review_queue(checked, valid), output, inputs=(manifest, spec))
    return {"output": output, "records": valid.count(), "target_team": head["target_team"].strip()}


def require_same_name(what: str, written: str | None, path: str) -> None:
    name = lambda p: str(p or "").rstrip("/").rsplit("/", 1)[-1]
    if name(written) != name(path):
        raise ReviewError("binding", f"{what} '{written}' does not name '{path}'")


def apply_review(spark, manifest: str, spec: str, results: str, output: str, **options) -> dict:
    """File to file: check everything, then publish the next manifest version."""
    from ..plans.guards import output_apart_from_inputs
    from ..plans.ordered import numbered
    from ..session import durable
    from ..sources.documents import read_results, read_spec
    from ..sources.manifest_csv import PROVENANCE, require_no_extra_cells, require_unique_index, scan_manifest
    from .manifest import check_manifest, publish_manifest, require_valid

    inputs = (manifest, spec, results)
    output_apart_from_inputs(output, inputs)
    head, requests = read_spec(spark, spec)
    found, confirmations = read_results(spark, results)
    require_same_name("manifest", head["manifest"], manifest)
    require_same_name("manifest", found["manifest"], manifest)
    require_same_name("spec", found["spec"], spec)
    raw = require_unique_index(durable(scan_manifest(spark, manifest)))
    checked = require_valid(check_manifest(raw, **options))
    require_no_extra_cells(raw)
    valid = require_no_errors(check_requests(requests, checked.count()))
    require_complete(confirmations, valid)
    confirmed = require_no_errors(check_confirmations(confirmations, valid, raw))
    if not order_breaks(confirmed).isEmpty():
        raise ReviewError("order", "confirmations must follow the order of the requests")
    names = [c for c in raw.columns if c not in PROVENANCE]
    columns = names + [c for c in ("review_status", "notes") if c not in names]
    result = apply_confirmations(raw, confirmed)
    # the file order of the result becomes its record index
    ordered = numbered(result.drop("record_index"), ("origin", "ordinal"), "record_index")
    summary = publish_manifest(ordered, columns, output, inputs=inputs, **options)
    counters = apply_counters(raw, confirmed).first().asDict()
    return {"output": output, **counters, **summary}
