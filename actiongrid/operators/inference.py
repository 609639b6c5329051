"""The table part of running a model over videos: times, scores, windows, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detections import score_to_label
from .events import event_table, merge_windows, run_counters
from .windows import sliding_windows


def window_grid(media: DataFrame, *, window_seconds: float, stride_seconds: float, **kw) -> DataFrame:
    spans = media.select("video_id", F.round(F.col("duration_seconds") * 1_000_000).cast("long").alias("duration_us"))
    return sliding_windows(spans, window_seconds=window_seconds, stride_seconds=stride_seconds, **kw)


def score_windows(grid: DataFrame, scores: DataFrame, labels: Sequence[str], *, softmax: bool = True) -> DataFrame:
    """Windows with the label and confidence of their score array (video_id, ordinal, scores)."""
    joined = grid.join(scores.select("video_id", "ordinal", "scores"), ["video_id", "ordinal"])
    return score_to_label(joined, "scores", labels, softmax=softmax).drop("scores")


def infer_events(windows: DataFrame, *, model_version: str, **merge_options) -> tuple[DataFrame, DataFrame]:
    """(published events, counters per video) of labelled windows."""
    events = merge_windows(windows, **merge_options)
    return event_table(events, model_version=model_version), run_counters(windows, events)
