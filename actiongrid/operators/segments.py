"""Match segments, annotation coverage and scan windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.intervals import cover, earlier_overlap, overlap_witness
from ..plans.ordered import MAX_ROWS, order_by_key
from .windows import sliding_windows


def segment_cover(annotations: DataFrame, segments: DataFrame, *, keys: Sequence[str] = ("video_id", "side"), **kw) -> DataFrame:
    """Each annotation must lie in exactly one segment of its side: `covered` is 1 then."""
    return cover(annotations, segments, keys, id_col="annotation_id", cover_id="segment_id", **kw)


def overlapping_candidates(intervals: DataFrame, windows: DataFrame, *, keys: Sequence[str] = ("video_id",), **kw) -> DataFrame:
    """New intervals with a window they overlap (witness), null for the free ones."""
    return overlap_witness(intervals, windows, keys, id_col="interval_id", other_id="window_id", **kw)


def free_candidates(intervals: DataFrame, windows: DataFrame, **kw) -> DataFrame:
    return overlapping_candidates(intervals, windows, **kw).where("witness is null").drop("witness")


def inside_named_segment(intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """Flag intervals that lie within the segment they name, on the same side."""
    seg = segments.select(
        F.col("segment_id").alias("source_segment_id"), F.col("side").alias("seg_side"),
        F.col("start_us").alias("seg_start"), F.col("end_us").alias("seg_end"),
    )
    inside = (
        (F.col("seg_start") <= F.col("start_us")) & (F.col("end_us") <= F.col("seg_end"))
        & (F.col("side") == F.col("seg_side"))
    )
    return intervals.join(seg, "source_segment_id", "left").withColumn(
        "inside", F.coalesce(inside, F.lit(False))
    )


def consecutive_faults(segments: DataFrame, *, keys: Sequence[str] = ("video_id",), order: Sequence[str] = ("position",), max_rows: int = MAX_ROWS) -> DataFrame:
    """Neighbours in given order that overlap or step back in time, with the gap between."""
    checked = order_by_key(segments, keys, order, max_rows=max_rows).scan(
        lag={"prev_start": "start_us", "prev_end": "end_us"}
    ).rows()
    return checked.withColumn("gap_us", F.col("start_us") - F.col("prev_end")).withColumn(
        "fault",
        F.when(F.col("end_us") <= F.col("start_us"), "empty")
        .when(F.col("start_us") < F.col("prev_start"), "unsorted")
        .when(F.col("gap_us") < 0, "overlap"),
    )


def duplicate_candidates(windows: DataFrame, *, keys: Sequence[str] = ("video_id", "side", "label"), id_col: str = "window_id", **kw) -> DataFrame:
    """Windows of one video, side and label that overlap an earlier one; for review only.
    Each is listed once with one partner, however dense the group is."""
    return earlier_overlap(windows, keys, id_col=id_col, **kw).where("witness is not null")


def scan_windows(segments: DataFrame, *, window_seconds: float, stride_seconds: float, tolerance_us: int = 0) -> DataFrame:
    """Sliding windows inside each segment widened by its tolerance; crop and side come
    with the segment and the gaps between segments stay empty."""
    low = F.greatest(F.col("start_us") - tolerance_us, F.lit(0))
    spans = segments.select(
        "video_id", "segment_id", low.alias("base_us"),
        (F.col("end_us") + tolerance_us - low).alias("duration_us"),
    )
    keys = ("video_id", "segment_id", "base_us")
    made = sliding_windows(spans, window_seconds=window_seconds, stride_seconds=stride_seconds, keys=keys)
    carried = [c for c in ("side", "crop") if c in segments.columns]
    return made.join(segments.select("video_id", "segment_id", *carried), ["video_id", "segment_id"]).select(
        "video_id", "segment_id", *carried, "ordinal",
        (F.col("base_us") + F.col("start_us")).alias("start_us"),
        (F.col("base_us") + F.col("end_us")).alias("end_us"),
    )


def boundary_vicinity(points: DataFrame, segments: DataFrame, *, tolerance_us: int, keys: Sequence[str] = ("video_id",), **kw) -> DataFrame:
    """Events (with start_us, end_us) that touch a zone around a segment boundary."""
    edges = segments.select(
        *keys, F.col("segment_id"),
        F.explode(F.array("start_us", "end_us")).alias("edge"),
    ).select(
        *keys, "segment_id", (F.col("edge") - tolerance_us).alias("start_us"),
        (F.col("edge") + tolerance_us + 1).alias("end_us"),
    )
    return overlap_witness(points, edges, keys, id_col="event_id", other_id="segment_id", **kw).withColumn(
        "near_boundary", F.col("witness").isNotNull()
    ).drop("witness")


def refinement_faults(refined: DataFrame, actions: DataFrame) -> DataFrame:
    """Refined windows must equal the actions inside their reviewed range: rows found on
    one side only. refined: interval_id, label, start_us, end_us, range_start_us,
    range_end_us; actions: interval_id, label, start_us, end_us."""
    ranges = refined.select(F.col("interval_id").alias("__of"), "range_start_us", "range_end_us").distinct()
    within = (F.col("start_us") >= F.col("range_start_us")) & (F.col("end_us") <= F.col("range_end_us"))
    inside = actions.join(ranges, (F.col("interval_id") == F.col("__of")) & within, "left_semi")
    columns = ["interval_id", "label", "start_us", "end_us"]
    a = refined.select(*columns).withColumn("in_refined", F.lit(1))
    b = inside.select(*columns).withColumn("in_actions", F.lit(1))
    counted = a.unionByName(b, allowMissingColumns=True).groupBy(*columns).agg(
        F.count("in_refined").alias("in_refined"), F.count("in_actions").alias("in_actions")
    )
    return counted.where(F.col("in_refined") != F.col("in_actions"))
