"""Window and sample-time generation, batching and forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import US_PER_SECOND, MediaError
from ..functions.numbers import as_col, int_div
from ..plans.guards import positive
from ..plans.ordered import MAX_ROWS, order_by_key

BLOCK = 65_536  # windows generated per row of the first explode
STARTS = 256  # accumulated starts per row of their table


def _checked(window_seconds: float, stride_seconds: float) -> None:
    positive("window_seconds", window_seconds)
    positive("stride_seconds", stride_seconds)
    if stride_seconds > window_seconds:
        raise ValueError("stride_seconds may not exceed window_seconds")


def sliding_windows(
    spans: DataFrame,
    *,
    window_seconds: float,
    stride_seconds: float,
    keys: Sequence[str] = ("video_id",),
    accumulate: bool = False,
) -> DataFrame:
    """spans(keys..., duration_us) to keys..., ordinal, start_us, end_us.

    A span no longer than the window gives one window of its own length. Otherwise
    starts are 0, stride, ... while they fit, plus one window that ends with the span
    unless the last regular one does. A long span is first cut into blocks that are
    spread over the cluster, so no task builds the windows of a whole long video.
    `accumulate=True` adds the stride up in double seconds instead (see `_accumulated`).
    """
    _checked(window_seconds, stride_seconds)
    if accumulate:
        return _accumulated(spans, window_seconds, stride_seconds, keys)
    w = round(window_seconds * US_PER_SECOND)
    stride_us = stride_seconds * US_PER_SECOND
    last = F.col("duration_us") - w
    if stride_us == int(stride_us):
        steps = int_div(last, int(stride_us)) + 1
        start_at = lambda i: i * F.lit(int(stride_us))
    else:
        steps = F.floor((last + 0.001) / F.lit(stride_us)) + 1
        start_at = lambda i: F.round(i * F.lit(stride_us)).cast("long")
    short = F.col("duration_us") <= w
    n_regular = F.when(short, F.lit(1)).otherwise(steps).cast("long")
    tail = F.when(~short & (start_at(n_regular - 1) != last), 1).otherwise(0)
    spark = spans.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = (
        spans.where(F.col("duration_us") > 0)
        .select(*keys, "duration_us", n_regular.alias("n_regular"), (n_regular + tail).alias("n"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), int_div(F.col("n") - 1, BLOCK))))
        .repartition(parts, *keys, "block")
    )
    first = F.col("block") * BLOCK
    ordinal = F.explode(F.sequence(first, F.least(first + BLOCK, F.col("n")) - 1))
    i = F.col("ordinal")
    start = F.when(short, F.lit(0)).when(i < F.col("n_regular"), start_at(i)).otherwise(last)
    return (
        blocks.withColumn("ordinal", ordinal)
        .withColumn("start_us", start.cast("long"))
        .withColumn("end_us", F.when(short, F.col("duration_us")).otherwise(F.col("start_us") + w))
        .select(*keys, "ordinal", "start_us", "end_us")
    )


def _accumulated(spans: DataFrame, window: float, stride: float, keys: Sequence[str]) -> DataFrame:
    """Starts by repeated double addition, whose drift can add a last window that all but
    equals the one before it. All spans share one sequence of starts: it is built once, as a
    table of runs of STARTS starts, and each span takes the runs it needs."""
    spark = spans.sparkSession
    typed = spans.where(F.col("duration_us") > 0).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], (F.col("duration_us") / F.lit(1e6)).alias("__d"))
    longest = typed.agg(F.max("__d")).first()[0] or 0.0
    heads, start = [], 0.0  # the first start of every run, and the last one before it
    while not heads or start <= longest - window + 1e-9:
        head = start
        for _ in range(STARTS):
            before, start = start, start + stride
        heads.append((len(heads), head, before))
    runs = spark.createDataFrame(heads, "__run long, __head double, __tail double")
    grown = F.aggregate(
        F.sequence(F.lit(2), F.lit(STARTS)), F.array("__head"),
        lambda all_, _: F.concat(all_, F.array(F.element_at(all_, -1) + F.lit(stride))))
    runs = runs.select((F.col("__run") + 0).alias("__of"), grown.alias("__starts"), F.lag("__tail").over(Window.orderBy("__run")).alias("__before"))
    last, short = F.col("__d") - F.lit(window), F.col("__d") <= F.lit(window)
    # one run more than the exact quotient asks for, because sums may lag behind it
    most = F.floor(last / F.lit(stride * STARTS)) + 1
    asked = typed.where(~short).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
    taken = asked.join(runs, F.col("__run") == F.col("__of"))
    fitting = F.filter("__starts", lambda x: x <= last + F.lit(1e-9))
    ends = (F.size(fitting) < STARTS) & (F.coalesce(F.col("__before"), F.lit(0.0)) <= last + F.lit(1e-9))
    final = F.when(F.size(fitting) > 0, F.element_at(fitting, -1)).otherwise(F.col("__before"))
    extra = F.when(ends & (F.abs(final - last) > 1e-9) & (last > 0), F.array(last)).otherwise(F.array().cast("array<double>"))
    placed = taken.select(*[f"__k{i}" for i in range(len(keys))], "__d", "__run", F.posexplode(F.concat(fitting, extra)).alias("__i", "__s"))
    # the extra window of a span ends with it
    end = F.when(F.col("__s") == last, F.col("__d")).otherwise(F.col("__s") + F.lit(window))
    ordinal = F.col("__run") * STARTS + F.col("__i")
    micro = lambda c: F.rint(c * 1e6).cast("long")
    names = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]
    many = placed.select(*names, ordinal.cast("long").alias("ordinal"), micro(F.col("__s")).alias("start_us"), micro(end).alias("end_us"))
    one = typed.where(short).select(
        *names, F.lit(0).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("start_us"), micro(F.col("__d")).alias("end_us"))
    return one.unionByName(many)


def frame_times(windows: DataFrame, num_frames: int) -> DataFrame:
    """Midpoints of `num_frames` equal slices of each window, as micro-second halves:
    sample_us2 is twice the time, an exact integer only where the slices allow it, so the
    time itself is given in double seconds beside its integer numerator."""
    positive("num_frames", num_frames)
    length = F.col("end_us") - F.col("start_us")
    numerator = lambda i: F.col("start_us") * (2 * num_frames) + (2 * i + 1) * length
    return (
        windows.where((F.col("start_us") >= 0) & (length > 0))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(num_frames - 1))).alias("frame_index"))
        .withColumn("sample_numerator", numerator(F.col("frame_index")).cast("long"))
        .withColumn("sample_seconds", F.col("sample_numerator") / F.lit(2e6 * num_frames))
    )


def sheet_times(media: DataFrame, samples: int) -> DataFrame:
    """Evenly spaced times d/(n+1)*(i+1), held one frame before the end."""
    positive("samples", samples)
    d = F.col("duration_seconds")
    return media.select(
        "video_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"), d, "fps"
    ).select(
        "video_id", "sample",
        clamped_time(d / F.lit(samples + 1) * (F.col("sample") + 1), d, F.col("fps")).alias("time_seconds"),
    )


def clamped_time(time: Column, duration: Column, fps: Column) -> Column:
    return F.least(time, F.greatest(duration - F.lit(1.0) / fps, F.lit(0.0)))


def batch_groups(
    windows: DataFrame, batch_size: int, *, order: Sequence[str] = ("start_us", "end_us", "ordinal"),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add the batch a window falls into and how many windows are done with that batch."""
    positive("batch_size", batch_size)
    counts = windows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    ordered = order_by_key(windows, ("video_id",), order, max_rows=max_rows, key_counts=counts).scan(number="nth")
    totals = counts.withColumnRenamed("n", "total")
    batch = int_div(F.col("nth") - 1, batch_size)
    return (
        ordered.rows().join(totals, "video_id")
        .withColumn("batch", batch)
        .withColumn("completed", F.least((F.col("batch") + 1) * batch_size, F.col("total")))
    )


def forward_fill(
    samples: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Missing samples repeat the one before; `missing_first` marks those that cannot."""
    from ..plans.ordered import Running

    filled = order_by_key(samples, keys, order, max_rows=max_rows).scan(
        running={"filled": Running("last", F.col(value))}
    )
    return filled.rows().withColumn("missing_first", F.col("filled").isNull())


def require_filled(filled: DataFrame) -> DataFrame:
    if not filled.where("missing_first").isEmpty():
        raise MediaError("first_frame", "the first sample of a window is missing")
    return filled


def span_of(rows: DataFrame, *, key: str = "video_id", end: str = "end_us") -> DataFrame:
    return rows.groupBy(key).agg(F.max(as_col(end)).alias("duration_us"))
