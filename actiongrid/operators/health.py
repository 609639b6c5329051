"""Data health, storage and package inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import set_hash


def check(name: str, faults: DataFrame, *, severity: str = "error") -> DataFrame:
    """One status row of a check: its faults are counted, never fetched."""
    return faults.agg(F.count(F.lit(1)).alias("faults")).select(
        F.lit(name).alias("check_name"),
        F.when(F.col("faults") == 0, "healthy").otherwise(severity).alias("status"), "faults",
    )


def not_run(spark, name: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(name).alias("check_name"), F.lit("not_run").alias("status"), F.lit(0).cast("long").alias("faults")
    )


def status_table(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def dangling(rows: DataFrame, column: str, targets: DataFrame, target_column: str) -> DataFrame:
    """Rows whose reference names nothing; null references are allowed."""
    keys = targets.select(F.col(target_column).alias(column))
    return rows.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def split_mixing(rows: DataFrame, *, key: str = "match_id", split: str = "split") -> DataFrame:
    """Keys found in more than one split; min and max suffice, no set is built."""
    return rows.groupBy(key).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b").select(key)


def hash_drift(rows: DataFrame, recorded: str, computed: str) -> DataFrame:
    return rows.where(~F.col(recorded).eqNullSafe(F.col(computed)))


def orphans(assets: DataFrame, references: DataFrame, *, key: str = "asset_id") -> DataFrame:
    return assets.join(references.select(key), key, "left_anti")


def storage_usage(assets: DataFrame, references: DataFrame, *, key: str = "asset_id") -> DataFrame:
    """Bytes and files per kind, and how much of it nothing refers to."""
    used = references.select(key).distinct().withColumn("__used", F.lit(1))
    lonely = F.col("__used").isNull()
    return assets.join(used, key, "left").groupBy("kind").agg(
        F.count(F.lit(1)).alias("assets"), F.sum("bytes").alias("bytes"),
        F.count_if(lonely).alias("unreferenced_assets"),
        F.sum(F.when(lonely, F.col("bytes")).otherwise(0)).alias("unreferenced_bytes"),
    )


def entity_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Count and order-free hash per entity type of a package; each table has id and sha."""
    rows = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("entity_type"), F.col("id").cast("string").alias("id"), "sha")
         for name, df in sorted(tables.items())],
    )
    return set_hash(rows, "sha", ["entity_type"], count="entities", out="entities_sha256")


def in_workspace(rows: DataFrame, workspace_id: str) -> DataFrame:
    """Every read goes through one workspace; a table without the column is refused."""
    if "workspace_id" not in rows.columns:
        raise ValueError("the table has no workspace_id")
    return rows.where(F.col("workspace_id") == workspace_id)
