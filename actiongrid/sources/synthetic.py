"""Generated labelled manifests of any size, for tests of a deployment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import ACTION_LABELS

# Three repeating label orders, one second per label.
ORDERS = (
    ACTION_LABELS,
    tuple(reversed(ACTION_LABELS)),
    ("serve", "set", "attack", "block", "dig", "receive", "background"),
)


def synthetic_manifest(spark: SparkSession, videos: int = 3, *, segment_seconds: float = 1.0) -> DataFrame:
    """Two of three videos train, the third validates; one row per video and label."""
    n = len(ACTION_LABELS)
    orders = F.array(*[F.array(*[F.lit(x) for x in order]) for order in ORDERS])
    ids = spark.range(videos * n).select(
        F.col("id"), F.expr(f"id div {n}").alias("video"), F.expr(f"cast(id % {n} as int)").alias("slot")
    )
    pattern = (F.col("video") % 3).cast("int")
    name = F.format_string(
        "%s_%02d.avi", F.when(pattern == 2, "val").otherwise("train"),
        F.when(pattern == 2, F.expr("video div 3 + 1")).otherwise(F.expr("video div 3 * 2 + video % 3 + 1")),
    )
    return ids.select(
        (F.col("id") + 1).alias("record_index"),
        name.alias("video_path"),
        (F.col("slot") * segment_seconds).cast("string").alias("start_seconds"),
        ((F.col("slot") + 1) * segment_seconds).cast("string").alias("end_seconds"),
        F.element_at(F.element_at(orders, pattern + 1), F.col("slot") + 1).alias("label"),
        F.lit("").alias("team_side"), F.lit("").alias("player_number"),
        F.when(pattern == 2, "val").otherwise("train").alias("split"),
    )
