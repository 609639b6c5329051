"""Small literal relations: closed domains as tables, without any cross join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def domain_table(
    spark: SparkSession, labels: Sequence[str], *, name: str = "label", ordinal: str = "ordinal"
) -> DataFrame:
    """One row per label with its position; a single-partition range, no shuffle."""
    if not labels:
        raise ValueError("the label domain is empty")
    values = F.array(*[F.lit(v) for v in labels])
    return spark.range(0, len(labels), 1, 1).select(
        F.col("id").cast("int").alias(ordinal),
        F.element_at(values, F.col("id").cast("int") + 1).alias(name),
    )


def domain_pairs(spark: SparkSession, size: int, left: str, right: str) -> DataFrame:
    """All size x size index pairs, made from one range by div and mod."""
    return spark.range(0, size * size, 1, 1).select(
        F.expr(f"cast(id div {size} as int)").alias(left),
        F.expr(f"cast(id % {size} as int)").alias(right),
    )


def ordinal_of(col: Column | str, labels: Sequence[str]) -> Column:
    """Position of a label in its domain, null outside of it."""
    values = F.array(*[F.lit(v) for v in labels])
    position = F.array_position(values, F.col(col) if isinstance(col, str) else col)
    return F.nullif(position, F.lit(0)).cast("int") - 1


def label_at(index: Column | str, labels: Sequence[str]) -> Column:
    values = F.array(*[F.lit(v) for v in labels])
    return F.try_element_at(values, (F.col(index) if isinstance(index, str) else index) + 1)


def mapped(col: Column | str, pairs: Mapping[str, str]) -> Column:
    """`pairs.get(value)` as an expression."""
    items = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*items), F.col(col) if isinstance(col, str) else col)


def remapped(col: Column | str, pairs: Mapping[str, str]) -> Column:
    """`pairs.get(value, value)` as an expression."""
    value = F.col(col) if isinstance(col, str) else col
    return F.coalesce(mapped(value, pairs), value)
