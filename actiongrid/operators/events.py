"""Sliding windows to action events.

Windows of a video, ordered by (start, end, ordinal), extend the open event when
they carry its action and start no later than its end plus the gap. Any other
action closes it. As an expression: a *run* is a stretch of equal actions; inside
a run an event ends where a start lies beyond the largest end so far plus the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import BACKGROUND_LABEL, EVENT_COLUMNS
from ..functions.numbers import half_even_div, us_to_ms
from ..plans.guards import fraction, micros
from ..plans.ordered import CHUNK, MAX_ROWS, attach, order_by_key

ORDER = ("start_us", "end_us", "ordinal")


def usable_windows(
    windows: DataFrame,
    *,
    confidence_threshold: float = 0.5,
    background_label: str = BACKGROUND_LABEL,
) -> DataFrame:
    """Drop background, weak and empty windows; all three are pushed to the scan."""
    return windows.where(usable_if(confidence_threshold, background_label))


def usable_if(confidence_threshold: float, background_label: str = BACKGROUND_LABEL) -> Column:
    fraction("confidence_threshold", confidence_threshold)
    return (
        (F.col("action") != background_label)
        & (F.col("conf_micro") >= round(confidence_threshold * 1_000_000))
        & (F.col("end_us") > F.col("start_us"))
    )


def _islands(rows: DataFrame, parts: tuple[str, ...], gap_us: int) -> DataFrame:
    """Number the runs and the islands of each part, and fold islands to one row."""
    order = Window.partitionBy(*parts).orderBy(*ORDER)
    in_run = (
        Window.partitionBy(*parts, "run").orderBy(*ORDER)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    prior = F.lag("action").over(order)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        rows.withColumn("turn", F.when(prior.isNull() | (prior != F.col("action")), 1).otherwise(0))
        .withColumn("run", F.sum("turn").over(so_far))
        .withColumn("reach", F.max("end_us").over(in_run))
        .withColumn(
            "opens",
            F.when(F.col("reach").isNull() | (F.col("start_us") > F.col("reach") + gap_us), 1)
            .otherwise(0),
        )
        .withColumn("island", F.sum("opens").over(so_far))
    )
    return marked.groupBy(*parts, "island").agg(
        F.min("run").alias("run"),
        F.first("action").alias("action"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.sum("conf_sum").alias("conf_sum"),
        F.sum("n_windows").alias("n_windows"),
    )


def _join_chunks(pieces: DataFrame, gap_us: int, min_us: int) -> DataFrame:
    """Stitch per-chunk islands of hot videos and number the surviving events.

    One summary row per chunk carries the action and the reach of the run that is
    open at its end; only pieces of a chunk's first run can continue an event.
    """
    parts = ("video_id", CHUNK)
    last = F.max_by(F.struct("run", "action"), F.col("island"))
    summary = pieces.groupBy(*parts).agg(
        F.min_by("action", "island").alias("first_action"),
        last["action"].alias("last_action"),
        F.max("run").alias("runs"),
        F.max(F.struct("run", "end_us"))["end_us"].alias("last_reach"),
    )
    over = Window.partitionBy("video_id").orderBy(CHUNK)
    before = F.lag("last_action").over(over)
    carry = (
        summary.withColumn(
            "cut",
            F.when(
                before.isNull() | (F.col("runs") > 1) | (before != F.col("first_action")), 1
            ).otherwise(0),
        )
        .withColumn("stretch", F.sum("cut").over(over))
        .withColumn(
            "reach",
            F.max("last_reach").over(
                Window.partitionBy("video_id", "stretch").orderBy(CHUNK)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .select(
            *parts,
            F.lag("last_action").over(over).alias("open_action"),
            F.lag("reach").over(over).alias("open_reach"),
        )
    )
    continues = (
        (F.col("run") == 1)
        & (F.col("action") == F.col("open_action"))
        & (F.col("start_us") <= F.col("open_reach") + gap_us)
    )
    flagged = attach(pieces, carry, parts).withColumn(
        "opens", F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)
    )
    opened = flagged.groupBy(*parts).agg(F.sum("opens").alias("n_open"))
    earlier = opened.select(
        *parts,
        F.coalesce(
            F.sum("n_open").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("earlier"),
    )
    here = Window.partitionBy(*parts).orderBy("island").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    numbered = attach(
        flagged.withColumn("nth", F.sum("opens").over(here)), earlier, parts
    ).withColumn("event_seq", F.col("nth") + F.col("earlier"))
    events = (
        numbered.groupBy("video_id", "event_seq")
        .agg(
            F.min(CHUNK).alias(CHUNK),
            F.min_by("action", F.struct(CHUNK, "island")).alias("action"),
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("conf_sum").alias("conf_sum"),
            F.sum("n_windows").alias("n_windows"),
        )
        .where(F.col("end_us") - F.col("start_us") >= min_us)
    )
    kept = events.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
    offset = kept.select(
        *parts,
        F.coalesce(
            F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("offset"),
    )
    local = F.row_number().over(Window.partitionBy(*parts).orderBy("event_seq"))
    return attach(events.withColumn("nth", local), offset, parts).select(
        "video_id",
        (F.col("nth") + F.col("offset")).alias("event_no"),
        "start_us", "end_us", "action", "conf_sum", "n_windows",
    )


def merge_windows(
    windows: DataFrame,
    *,
    confidence_threshold: float = 0.5,
    merge_gap_seconds: float = 0.25,
    min_event_seconds: float = 0.2,
    background_label: str = BACKGROUND_LABEL,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Events as exact integers: video_id, event_no, start_us, end_us, action,
    conf_sum (millionths), n_windows. Events that are too short get no number,
    yet they have kept their neighbours apart."""
    usable = usable_windows(
        windows, confidence_threshold=confidence_threshold, background_label=background_label
    )
    return merge_spans(
        as_spans(usable),
        gap_us=micros("merge_gap_seconds", merge_gap_seconds),
        min_us=micros("min_event_seconds", min_event_seconds),
        max_rows=max_rows,
    )


def as_spans(windows: DataFrame) -> DataFrame:
    """Windows as spans that stand for one window each."""
    return windows.select(
        "video_id", "ordinal", "start_us", "end_us", "action",
        F.col("conf_micro").alias("conf_sum"), F.lit(1).cast("long").alias("n_windows"),
    )


def merge_spans(
    spans: DataFrame, *, gap_us: int, min_us: int, max_rows: int = MAX_ROWS, key_counts: DataFrame | None = None,
) -> DataFrame:
    """The merge itself, on spans that may already stand for several windows; `key_counts` as in
    `order_by_key`."""
    split = order_by_key(spans, ("video_id",), ORDER, max_rows=max_rows, key_counts=key_counts)

    number = F.row_number().over(Window.partitionBy("video_id").orderBy("island"))
    cold = (
        _islands(split.cold, ("video_id",), gap_us)
        .where(F.col("end_us") - F.col("start_us") >= min_us)
        .select(
            "video_id", number.cast("long").alias("event_no"),
            "start_us", "end_us", "action", "conf_sum", "n_windows",
        )
    )
    if split.hot is None:
        return cold
    hot = _join_chunks(_islands(split.hot, ("video_id", CHUNK), gap_us), gap_us, min_us)
    return cold.unionByName(hot)


def event_id(number: Column | str) -> Column:
    value = F.col(number) if isinstance(number, str) else number
    return F.format_string("evt_%06d", value)


def event_table(events: DataFrame, *, model_version: str, source: str = "sliding_window") -> DataFrame:
    """The eleven published event columns."""
    return events.select(
        F.col("video_id"),
        event_id("event_no").alias("event_id"),
        us_to_ms("start_us").alias("start_ms"),
        us_to_ms("end_us").alias("end_ms"),
        F.col("action"),
        (half_even_div("conf_sum", F.col("n_windows")) / F.lit(1_000_000.0)).alias("confidence"),
        F.lit(None).cast("string").alias("team_side"),
        F.lit(None).cast("string").alias("player_number"),
        F.lit("predicted").alias("status"),
        F.lit(model_version).alias("model_version"),
        F.lit(source).alias("source"),
    ).select(*EVENT_COLUMNS)


def run_counters(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Per video: windows scored and events kept (0 when none survived)."""
    scored = windows.groupBy("video_id").agg(F.count(F.lit(1)).alias("window_count"))
    kept = events.groupBy("video_id").agg(F.count(F.lit(1)).alias("event_count"))
    return attach(scored, kept, ("video_id",)).select(
        "video_id", "window_count", F.coalesce("event_count", F.lit(0)).alias("event_count")
    )
