"""Detector output to window predictions.

Frames arrive with parallel arrays (class ids, confidences, boxes) and a name
map. A window's prediction is one `max` over an ordered struct, which Spark
combines on the map side, so a window with very many detections is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import ACTION_LABELS, BACKGROUND_LABEL, EXTERNAL_LABELS, EVALUATION_COLUMNS, DataError
from ..functions.labels import class_name, normalize_external
from ..functions.text import crop_text, strip, timecode_us
from ..functions.numbers import int_div, us_to_seconds
from ..plans.guards import fraction
from ..plans.literal import label_at, ordinal_of
from ..plans.ordered import MAX_ROWS, attach, order_by_key


def extract_detections(frames: DataFrame) -> DataFrame:
    """frames(window_id, frame_index, class_ids, confidences, boxes, names) to one row
    per usable detection, in (frame_index, position) order."""
    zipped = frames.select(
        "window_id", "frame_index", "names",
        F.posexplode(F.arrays_zip("class_ids", "confidences", "boxes")).alias("position", "d"),
    ).where(
        # arrays_zip pads the shorter arrays with nulls; a detection needs all three
        F.col("d.class_ids").isNotNull() & F.col("d.confidences").isNotNull() & F.col("d.boxes").isNotNull()
    )
    label = class_name("names", F.col("d.class_ids").cast("int"))
    return (
        zipped.select(
            "window_id", "frame_index", "position",
            label.alias("source_label"),
            normalize_external(label).alias("action"),
            F.round(F.col("d.confidences").cast("double") * 1_000_000).cast("long").alias("conf_micro"),
            F.col("d.boxes").cast("array<double>").alias("box_xyxy"),
        )
        .where(F.col("action").isNotNull() & (F.size("box_xyxy") == 4))
    )


def frames_of_samples(windows: DataFrame, samples: str) -> DataFrame:
    """Explode an array of frame structs; the 0-based position is the frame index."""
    return windows.select("window_id", F.posexplode(samples).alias("frame_index", "frame")).select(
        "window_id", "frame_index", "frame.*"
    )


def window_winner(
    detections: DataFrame,
    *,
    confidence_threshold: float,
    windows: DataFrame | None = None,
    order: Sequence[str] = ("frame_index", "position"),
    labels: Sequence[str] = ACTION_LABELS,
) -> DataFrame:
    """Best detection per window: highest confidence, then earliest label of the domain,
    then earliest detection. Windows without one are background with confidence 0.
    `windows` adds windows that have no detection at all."""
    fraction("confidence_threshold", confidence_threshold)
    ordinal = ordinal_of("action", labels)
    eligible = (F.col("conf_micro") >= round(confidence_threshold * 1_000_000)) & ordinal.isNotNull()
    key = F.struct(
        F.col("conf_micro"), (-ordinal).alias("label_rank"),
        *[(-F.col(c)).alias(f"o{i}") for i, c in enumerate(order)],
    )
    best = detections.groupBy("window_id").agg(
        F.max(F.when(eligible, key)).alias("best"), F.count(F.lit(1)).alias("n_detections")
    )
    if windows is not None:
        best = attach(windows.select("window_id").distinct(), best, ("window_id",))
    return best.select(
        "window_id",
        F.coalesce(label_at(-F.col("best.label_rank"), labels), F.lit(BACKGROUND_LABEL)).alias("action"),
        F.coalesce("best.conf_micro", F.lit(0)).cast("long").alias("conf_micro"),
        F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
    )


def evidence_struct() -> Column:
    return F.struct(
        "frame_index", "source_label", "action",
        (F.col("conf_micro") / F.lit(1_000_000.0)).alias("confidence"), "box_xyxy",
    )


def evidence_parts(
    detections: DataFrame,
    *,
    order: Sequence[str] = ("frame_index", "position"),
    part_rows: int = 10_000,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """All detections of a window as ordered arrays of at most `part_rows` elements:
    window_id, part, evidence. Usual windows have one part; nothing is dropped."""
    numbered = order_by_key(detections, ("window_id",), order, max_rows=max_rows).scan(number="nth").rows()
    return (
        numbered.groupBy("window_id", int_div(F.col("nth") - 1, part_rows).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("nth", evidence_struct().alias("e")))).alias("items"))
        .select("window_id", "part", F.transform("items", lambda x: x["e"]).alias("evidence"))
    )


def model_labels(models: DataFrame) -> DataFrame:
    """(model_id, labels): the names of a model map(string -> string) as one array in the order
    of their integer ids; ids that are no integers come first."""
    entry = F.transform(F.map_entries("names"), lambda e: F.struct(e["key"].try_cast("int").alias("id"), e["value"].alias("label")))
    return models.select("model_id", F.transform(F.array_sort(entry), lambda e: e["label"]).alias("labels"))


def missing_capabilities(models: DataFrame) -> DataFrame:
    """Per model the required external labels it does not name."""
    required = F.array(*[F.lit(k) for k, v in sorted(EXTERNAL_LABELS.items()) if v is not None])
    available = F.transform(F.map_values("names"), lambda v: F.lower(strip(v)))
    return models.select("model_id", F.sort_array(F.array_except(required, available)).alias("missing"))


def require_capabilities(models: DataFrame) -> None:
    bad = missing_capabilities(models).where(F.size("missing") > 0).first()
    if bad is not None:
        raise DataError("model_labels", f"model {bad.model_id} lacks {', '.join(bad.missing)}")


def score_to_label(
    rows: DataFrame, scores: str, labels: Sequence[str], *, softmax: bool = True
) -> DataFrame:
    """Label and confidence of a score array; equal scores go to the first label."""
    s = F.transform(F.col(scores), lambda x: x.cast("double"))
    top = F.array_max(s)
    index = (F.array_position(s, top) - 1).cast("int")
    if softmax:
        total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        confidence = F.lit(1.0) / total
    else:
        confidence = top
    return rows.withColumn("action", label_at(index, labels)).withColumn(
        "conf_micro", F.round(confidence * 1_000_000).cast("long")
    )


def evaluation_rows(annotations: DataFrame, predictions: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Annotations joined 1:1 with predictions on record_index, in report columns.

    annotations: record_index, video_path, start_us, end_us, label, split, team_side,
    player_number, crop. `evidence` has record_index and an evidence array; without it
    the column is an empty array (see `evidence_parts` for the long form)."""
    joined = annotations.join(
        predictions.select("record_index", F.col("action").alias("predicted_action"), "conf_micro"),
        "record_index",
    )
    empty = F.array().cast("array<struct<frame_index:int,source_label:string,action:string,confidence:double,box_xyxy:array<double>>>")
    if evidence is None:
        joined = joined.withColumn("evidence", empty)
    else:
        joined = joined.join(evidence.select("record_index", "evidence"), "record_index", "left").withColumn(
            "evidence", F.coalesce("evidence", empty)
        )
    return joined.select(
        "record_index", "video_path",
        us_to_seconds("start_us").alias("start_seconds"), us_to_seconds("end_us").alias("end_seconds"),
        timecode_us("start_us").alias("start_time"), timecode_us("end_us").alias("end_time"),
        "split",
        F.coalesce("team_side", F.lit("")).alias("team_side"),
        F.coalesce("player_number", F.lit("")).alias("player_number"),
        F.col("label").alias("expected_action"), "predicted_action",
        (F.col("conf_micro") / F.lit(1_000_000.0)).alias("confidence"),
        (F.col("label") == F.col("predicted_action")).alias("correct"),
        crop_text("crop").alias("crop"), "evidence",
    ).select(*EVALUATION_COLUMNS)
