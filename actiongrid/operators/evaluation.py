"""Detections against annotations, from frames to the report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import ACTION_LABELS, COMPATIBLE_LABELS
from ..plans.ordered import in_order
from ..session import durable
from ..sources.sinks import write_record
from .detections import evaluation_rows, evidence_parts, window_winner
from .metrics import evaluate, per_class, summary


def evaluate_detections(
    annotations: DataFrame, detections: DataFrame, *, confidence_threshold: float,
    order: Sequence[str] = ("frame_index", "position"),
) -> DataFrame:
    """One report row per annotation: its prediction and the evidence for it.

    annotations: as `check_manifest` gives them; detections: as `extract_detections` gives them,
    with the annotation's record_index as window_id. Detections of other windows are left out."""
    windows = annotations.select(F.col("record_index").alias("window_id"))
    mine = detections.join(windows, "window_id", "left_semi")
    winners = window_winner(mine, confidence_threshold=confidence_threshold, windows=windows, order=order)
    predictions = winners.select(F.col("window_id").alias("record_index"), "action", "conf_micro")
    # a window has few frames: its parts fit into the one cell that the report gives them
    parts = evidence_parts(mine, order=order).groupBy(F.col("window_id").alias("record_index")).agg(
        F.array_sort(F.collect_list(F.struct("part", "evidence"))).alias("parts")
    )
    evidence = parts.select("record_index", F.flatten(F.transform("parts", lambda p: p["evidence"])).alias("evidence"))
    return evaluation_rows(annotations, predictions, evidence)


def metric_sets(rows: DataFrame) -> DataFrame:
    """(metric_set, metric, label, value): strict and compatible scores of evaluation rows."""
    out = None
    for name, labels in (("strict", ACTION_LABELS), ("compatible", COMPATIBLE_LABELS)):
        matrix = evaluate(rows)[name]
        whole = summary(matrix, labels).select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.lit("").alias("label"), F.col(m).cast("double").alias("value"))
            for m in ("samples", "accuracy", "macro_f1")])))
        classes = per_class(matrix, labels).select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col("label"), F.col(m).cast("double").alias("value"))
            for m in ("precision", "recall", "f1", "support")])))
        one = whole.unionByName(classes).select(F.lit(name).alias("metric_set"), "metric", "label", "value")
        out = one if out is None else out.unionByName(one)
    return out


def write_report(rows: DataFrame, path: str, *, settings: Mapping[str, object], manifest: Mapping[str, object]) -> str:
    """The report: `head` is one JSON object with format_version, settings, manifest_summary and
    both metric sets (rows of a closed label domain); `records` has a JSON line per row, in order, in
    compressed parts: the evidence of neighbouring rows is much alike."""
    in_order(rows, "record_index").write.option("compression", "gzip").json(f"{path}/records")
    # the metrics ask for the labels several times: these are taken from the records, not computed again
    labels = rows.select("expected_action", "predicted_action").schema
    stored = durable(rows.sparkSession.read.schema(labels).json(f"{path}/records"))
    sets: dict = {}
    for r in metric_sets(stored).collect():  # labels times metrics
        place = sets.setdefault(r.metric_set, {"per_class": {}})
        if r.label:
            place["per_class"].setdefault(r.label, {})[r.metric] = r.value
        else:
            place[r.metric] = r.value
    head = {"format_version": 1, "settings": dict(settings), "manifest_summary": dict(manifest), "metrics": sets, "records": "records"}
    write_record(rows.sparkSession, head, f"{path}/head")
    return path
