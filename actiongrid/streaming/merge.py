"""Merging windows that arrive over time.

Each micro-batch is one run of the batch merge over what is still open plus what has
become ready, so hot videos are chunked exactly as in batch. What is carried between
micro-batches is one row per video (open event, watermark, counter) and the windows
that are not ready yet. A video without arrivals does not change, so a batch reads and writes
the state of its own videos only: state is a log (see `statelog`), whose latest entry of a video
counts. Everything a batch writes goes under its own batch number: a replayed batch overwrites
itself and reads the state before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import as_spans, event_table, merge_spans, usable_if, usable_windows
from ..plans.guards import micros, non_negative
from ..plans.ordered import MAX_ROWS, attach, order_by_key
from .statelog import COMPACT_EVERY, StateLog, delete

SPAN = "video_id string, ordinal long, start_us long, end_us long, action string, conf_sum long, n_windows long"
VIDEO = (
    "video_id string, watermark_us long, emitted long, "
    "open struct<start_us:long,end_us:long,action:string,conf_sum:long,n_windows:long>"
)
EVENT = "video_id string, event_no long, start_us long, end_us long, action string, conf_sum long, n_windows long"


@dataclass(frozen=True)
class MergeSettings:
    gap_us: int
    min_us: int
    delay_us: int
    confidence_threshold: float = 0.5
    max_rows: int = MAX_ROWS

    @classmethod
    def of(cls, *, merge_gap_seconds=0.25, min_event_seconds=0.2, delay_seconds=0.0, **kw):
        return cls(
            micros("merge_gap_seconds", merge_gap_seconds), micros("min_event_seconds", min_event_seconds),
            round(non_negative("delay_seconds", delay_seconds) * 1_000_000), **kw,
        )


@dataclass(frozen=True)
class StreamState:
    videos: DataFrame
    waiting: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> "StreamState":
        return cls(spark.createDataFrame([], VIDEO), spark.createDataFrame([], SPAN))


@dataclass(frozen=True)
class StepResult:
    state: StreamState
    events: DataFrame
    late: DataFrame


def arrivals(windows: DataFrame, settings: MergeSettings) -> DataFrame:
    """One row per video that got windows: the largest start and how many windows are usable."""
    return windows.groupBy("video_id").agg(
        F.max("start_us").alias("seen_us"), F.count_if(usable_if(settings.confidence_threshold)).alias("n_usable"))


def step(
    state: StreamState, windows: DataFrame, settings: MergeSettings, *, final: bool = False,
    store: Callable[[str, DataFrame], DataFrame] = lambda name, df: df, seen: DataFrame | None = None,
) -> StepResult:
    """One micro-batch. A window is late when its start lies at or before the watermark of
    its video (largest start seen minus the delay) as it stood before the batch. Ready are
    the windows up to the new watermark; an event is closed by a later one or when the
    watermark has passed its end plus the gap. `final` closes everything. `store` may write
    a table and read it back, so that nothing that needs it computes it again: the videos and
    the next state have one row per video, the merged spans are what the events are taken from.
    `seen` are the `arrivals` of the windows, if they are at hand."""
    seen = arrivals(windows, settings) if seen is None else seen
    # a late window starts at or before the old watermark, so the largest start needs no look at it
    held = state.waiting.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_held"))
    videos = store("videos", attach(attach_full(state.videos, seen), held, ("video_id",)).select(
        "video_id", "watermark_us", "emitted", "open",
        F.greatest("watermark_us", F.col("seen_us") - settings.delay_us).alias("mark_us"),
        (F.coalesce("n_usable", F.lit(0)) + F.coalesce("n_held", F.lit(0)) + 1).alias("n"),
    ))

    marks = videos.select("video_id", "watermark_us", "mark_us")
    is_late = F.coalesce(F.col("start_us") <= F.col("watermark_us"), F.lit(False))
    ready_if = F.lit(True) if final else F.col("start_us") <= F.col("mark_us")
    usable = attach(as_spans(usable_windows(windows, confidence_threshold=settings.confidence_threshold)), marks, ("video_id",))
    pool = usable.where(~is_late).unionByName(attach(state.waiting, marks, ("video_id",))).drop("watermark_us")
    ready = pool.where(ready_if).drop("mark_us")
    waiting = pool.where(~ready_if).drop("mark_us")

    reopened = videos.where("open is not null").select(
        "video_id", F.lit(-1).cast("long").alias("ordinal"), "open.start_us", "open.end_us",
        "open.action", "open.conf_sum", "open.n_windows",
    )
    merged = store("merged", merge_spans(
        ready.unionByName(reopened), gap_us=settings.gap_us, min_us=0, max_rows=settings.max_rows,
        key_counts=videos.select("video_id", "n")))

    # only the last span of a video may stay open
    is_long = F.col("end_us") - F.col("start_us") >= settings.min_us
    last = merged.groupBy("video_id").agg(
        F.max("event_no").alias("last_no"), F.count_if(is_long).alias("n_long"),
        F.max_by(F.struct("start_us", "end_us", "action", "conf_sum", "n_windows"), "event_no").alias("last"),
    )
    past = F.lit(True) if final else F.coalesce(F.col("mark_us") > F.col("last.end_us") + settings.gap_us, F.lit(False))
    after = attach(videos.drop("open"), last, ("video_id",)).withColumn("now_open", F.when(~past, F.col("last")))
    open_long = F.coalesce(F.col("now_open.end_us") - F.col("now_open.start_us") >= settings.min_us, F.lit(False))
    after = store("after", after.select(
        "video_id", "mark_us", "now_open", "last_no", F.coalesce("emitted", F.lit(0)).cast("long").alias("emitted"),
        (F.coalesce("n_long", F.lit(0)) - F.when(open_long, 1).otherwise(0)).cast("long").alias("n_new"),
    ))
    next_videos = after.select(
        "video_id", F.col("mark_us").alias("watermark_us"), (F.col("emitted") + F.col("n_new")).alias("emitted"),
        F.col("now_open").alias("open"),
    )

    before = after.select("video_id", "emitted", F.when(F.col("now_open").isNotNull(), F.col("last_no")).alias("open_no"))
    kept = attach(merged.where(is_long), before, ("video_id",)).where("open_no is null or event_no < open_no").drop("open_no")
    numbered = order_by_key(
        kept, ("video_id",), ("event_no",), max_rows=settings.max_rows,
        key_counts=after.where("n_new > 0").select("video_id", F.col("n_new").alias("n")),
    ).scan(number="nth").rows()
    events = numbered.select(
        "video_id", (F.col("nth") + F.col("emitted")).alias("event_no"),
        "start_us", "end_us", "action", "conf_sum", "n_windows",
    )
    late = attach(windows, marks.where("watermark_us is not null"), ("video_id",), "inner").where(is_late).drop("watermark_us", "mark_us")
    return StepResult(StreamState(next_videos, waiting), events, late)


def attach_full(videos: DataFrame, marks: DataFrame) -> DataFrame:
    return videos.join(marks, "video_id", "full_outer")


def state_log(spark: SparkSession, base: str, compact_every: int = COMPACT_EVERY) -> StateLog:
    return StateLog(spark, f"{base}/state", "video_id", {"videos": VIDEO, "waiting": SPAN}, compact_every)


def run_batch(
    spark: SparkSession, base: str, batch: int, windows: DataFrame, settings: MergeSettings, *, final: bool = False,
    compact_every: int = COMPACT_EVERY,
) -> None:
    """Read the state of the batch's videos, take one step, write everything of this batch.

    Arrivals are kept for the length of the batch, so its outputs read them once. `final` is a
    step of all videos."""
    log = state_log(spark, base, compact_every)
    place = lambda name, number=batch: f"{base}/{name}/batch={number}"

    made = ("seen", "videos", "merged", "after")

    def store(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(place(name))
        return spark.read.schema(df.schema).parquet(place(name))

    windows = windows.persist()
    try:
        seen = store("seen", arrivals(windows, settings))
        found = log.before(batch, None if final else seen.select("video_id"))
        result = step(StreamState(found["videos"], found["waiting"]), windows, settings, final=final, store=store, seen=seen)
        log.write(batch, {"videos": result.state.videos, "waiting": result.state.waiting})
        for name, df in (("events", result.events), ("late", result.late)):
            df.write.mode("overwrite").parquet(place(name))
    finally:
        windows.unpersist()
    log.compact(batch)
    for name in made:
        delete(spark, place(name, batch - 2))


def start_merge_stream(windows: DataFrame, base: str, settings: MergeSettings, *, checkpoint: str, trigger: dict | None = None):
    """Start the streaming query; `base` receives state, events and late windows."""
    spark = windows.sparkSession

    def handle(batch_df: DataFrame, batch_id: int) -> None:
        run_batch(batch_df.sparkSession, base, batch_id, batch_df, settings)

    return (
        windows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def finish(spark: SparkSession, base: str, last_batch: int, settings: MergeSettings, schema) -> None:
    """Close what is open after the last micro-batch."""
    run_batch(spark, base, last_batch + 1, spark.createDataFrame([], schema), settings, final=True)


def closed_events(spark: SparkSession, base: str) -> DataFrame:
    """Everything closed so far, in the columns of the batch merge."""
    return spark.read.schema(EVENT).parquet(f"{base}/events").drop("batch")


def stream_events(spark: SparkSession, base: str, *, model_version: str) -> DataFrame:
    return event_table(closed_events(spark, base), model_version=model_version)
