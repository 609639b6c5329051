"""Continuous manifest validation: good rows on one side, broken rows with their rules on the
other. Split leakage, a rule about the whole data set, is kept up as rows arrive: a log holds for
every video a bit for each split seen and the first record of each, so a video that turns up in a
second split is reported in the batch in which it does. Emptiness stays a batch rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import SPLITS
from ..operators.manifest import check_manifest
from .statelog import COMPACT_EVERY, StateLog

SEEN = "video_path string, splits int, firsts array<long>"


def start_validation(rows: DataFrame, valid_path: str, quarantine_path: str, *, checkpoint: str, trigger: dict | None = None, **options):
    """rows: a stream of text columns with record_index."""
    checked = check_manifest(rows, **options)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # two sinks, one evaluation
        try:
            batch.where(F.size("errors") == 0).drop("errors").write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
            batch.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        checked.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def leakage_log(spark: SparkSession, base: str, compact_every: int = COMPACT_EVERY) -> StateLog:
    return StateLog(spark, f"{base}/state", "video_path", {"seen": SEEN}, compact_every)


def leakage_step(seen: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state of the videos in `checked`, those of them that leak since these rows).

    splits has bit i for split i; firsts the smallest record index of each split, null if none.
    """
    here = [F.when(F.col("split") == s, F.col("record_index")) for s in SPLITS]
    arrived = checked.where(F.col("split").isin(*SPLITS)).groupBy("video_path").agg(F.array(*[F.min(c) for c in here]).alias("now"))
    old = seen.select("video_path", F.col("splits").alias("before"), "firsts")
    merged = F.array(*[F.least(F.get("now", F.lit(i)), F.get("firsts", F.lit(i))) for i in range(len(SPLITS))])
    both = arrived.join(old, "video_path", "left").withColumn("merged", merged)
    bits = sum((F.when(F.get("merged", F.lit(i)).isNotNull(), 1 << i).otherwise(0) for i in range(len(SPLITS))), F.lit(0))
    state = both.select("video_path", bits.cast("int").alias("splits"), F.col("merged").alias("firsts"), "before")
    leaks = state.where((F.bit_count("splits") > 1) & (F.coalesce(F.bit_count("before"), F.lit(0)) < 2))
    return state.drop("before"), leaks.drop("before")


def start_leakage(rows: DataFrame, base: str, *, checkpoint: str, trigger: dict | None = None, compact_every: int = COMPACT_EVERY, **options):
    """rows: a stream of text columns with record_index. Videos that begin to leak are appended
    under `base`/leaks, batch by batch; `leaks_so_far` gives all splits of all of them."""
    checked = check_manifest(rows, **options)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = leakage_log(spark, base, compact_every)
        batch = batch.select("video_path", "split", "record_index").persist()
        try:
            seen = log.before(batch_id, batch.select("video_path").distinct())["seen"]
            state, leaks = leakage_step(seen, batch)
            leaks.write.mode("overwrite").parquet(f"{base}/leaks/batch={batch_id}")
            log.write(batch_id, {"seen": state})
        finally:
            batch.unpersist()
        log.compact(batch_id)

    return (
        checked.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def leaks_so_far(spark: SparkSession, base: str, after_batch: int) -> DataFrame:
    """(video_path, splits) of every video seen in several splits up to `after_batch`."""
    seen = leakage_log(spark, base).before(after_batch + 1)["seen"]
    names = F.array(*[F.when(F.col("splits").bitwiseAND(1 << i) > 0, s) for i, s in enumerate(SPLITS)])
    return seen.where(F.bit_count("splits") > 1).select("video_path", F.array_sort(F.array_compact(names)).alias("splits"))
