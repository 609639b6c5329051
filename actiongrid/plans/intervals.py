"""Interval relations within a key.

Existence and counting questions (overlaps anything? covered once or more?) are
answered by a sweep: both sides are laid on one time line per key and a running
maximum decides. No pairs are formed, so dense keys stay linear, and hot keys are
chunked by `order_by_key`.

Only where pairs *are* the result (assignments with their overlap) intervals are
put into fixed-width time buckets and joined on (key, bucket). Buckets that are too
full are salted: the left side is spread and the right side repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .guards import positive
from .ordered import MAX_ROWS, Running, attach, order_by_key

START, END = "start_us", "end_us"


def _line(rows: DataFrame, keys, position: Column, side: int, reach: Column, ident: Column, keep: Sequence[str]) -> DataFrame:
    return rows.select(
        *keys, position.alias("__at"), F.lit(side).alias("__side"), ident.cast("string").alias("__id"),
        reach.alias("__reach"), F.struct(*[F.col(c) for c in keep]).alias("__row"),
    )


def overlap_witness(
    rows: DataFrame, others: DataFrame, keys: Sequence[str], *, id_col: str, other_id: str,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """`rows` plus `witness`: the id of an interval of `others` that strictly overlaps
    (start < other end and other start < end), null if none does. One sweep over the
    union: of all others that start before the row ends, the one reaching furthest
    decides. The witness is the furthest-reaching one, largest id on ties."""
    mine = _line(rows, keys, F.col(END), 0, F.lit(None), F.col(id_col), rows.columns)
    theirs = others.select(
        *keys, F.col(START).alias("__at"), F.lit(1).alias("__side"), F.col(other_id).cast("string").alias("__id"),
        F.struct(F.col(END).alias("reach"), F.col(other_id).alias("id")).alias("__reach"),
    )
    swept = order_by_key(
        mine.drop("__reach").unionByName(theirs, allowMissingColumns=True),
        keys, ("__at", "__side", "__id"), max_rows=max_rows,
    ).scan(running={"__best": Running("max", F.col("__reach"), before=True)})
    return (
        swept.rows().where(F.col("__side") == 0)
        .select("__row.*", F.when(F.col("__best.reach") > F.col(f"__row.{START}"), F.col("__best.id")).alias("witness"))
    )


def earlier_overlap(
    rows: DataFrame, keys: Sequence[str], *, id_col: str, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Self form: `rows` plus `witness`, an interval of the same key that comes earlier in
    (start, end, id) order and still runs when this one starts. A key is free of overlaps
    exactly if no row has a witness."""
    base = rows.withColumn("__reach", F.struct(F.col(END).alias("reach"), F.col(id_col).alias("id")))
    swept = order_by_key(base, keys, (START, END, id_col), max_rows=max_rows).scan(
        running={"__best": Running("max", F.col("__reach"), before=True)}
    )
    nonempty = F.col(END) > F.col(START)
    return swept.rows().withColumn(
        "witness", F.when(nonempty & (F.col("__best.reach") > F.col(START)), F.col("__best.id"))
    ).drop("__reach", "__best")


def cover(
    rows: DataFrame, covers: DataFrame, keys: Sequence[str], *, id_col: str, cover_id: str,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """`rows` plus `covered` (0, 1, or 2 for several) and `cover_id`: containment
    cover.start <= start and end <= cover.end. Two running maxima (the furthest and the
    second furthest reach so far) separate none, one and several without any pair."""
    theirs = covers.select(
        *keys, F.col(START).alias("__at"), F.lit(0).alias("__side"), F.col(cover_id).cast("string").alias("__id"),
        F.struct(F.col(END).alias("reach"), F.col(cover_id).alias("id")).alias("__reach"),
    )
    mine = _line(rows, keys, F.col(START), 1, F.lit(None), F.col(id_col), rows.columns).drop("__reach")
    order = ("__at", "__side", "__id")
    line = order_by_key(theirs.unionByName(mine, allowMissingColumns=True), keys, order, max_rows=max_rows)
    first = line.scan(running={"__best": Running("max", F.col("__reach"), before=True)})
    # a newcomer pushes the smaller of itself and the best so far to second place
    pushed = F.when(F.col("__reach").isNotNull() & F.col("__best").isNotNull(), F.least("__reach", "__best"))
    second = first.map(lambda d: d.withColumn("__pushed", pushed)).scan(
        running={"__second": Running("max", F.col("__pushed"), before=True)}
    )
    end = F.col(f"__row.{END}")
    one = F.coalesce(F.col("__best.reach") >= end, F.lit(False))
    two = F.coalesce(F.col("__second.reach") >= end, F.lit(False))
    return second.rows().where(F.col("__side") == 1).select(
        "__row.*",
        (one.cast("int") + two.cast("int")).alias("covered"),
        F.when(one & ~two, F.col("__best.id")).alias("cover_id"),
    )


def _buckets(start: Column, end: Column, width: int) -> Column:
    low, high = F.floor(start / F.lit(width)), F.floor(F.greatest(start, end - 1) / F.lit(width))
    return F.explode(F.sequence(low, high))


def overlap_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_id: str, right_id: str,
    width_us: int, how: str = "inner", bucket_rows: int = 100_000,
) -> DataFrame:
    """All strictly overlapping pairs with overlap_us; `how='left'` keeps lonely rows.

    A pair is reported only in the later of the two first buckets, so none repeats. A bucket
    above `bucket_rows` is split on the side that holds more of it, by salt, and the other
    side's rows are repeated for each salt value. Lonely rows come from a sweep, not from the
    pairs: rows without a witness. `width_us` should be near the usual length: an interval is
    repeated for every bucket it touches."""
    positive("width_us", width_us)
    keys = list(keys)
    a = left.select(
        *keys, F.col(left_id).alias("__a"), F.col(START).alias("__as"), F.col(END).alias("__ae"),
        _buckets(F.col(START), F.col(END), width_us).alias("__bucket"),
    )
    b = right.select(
        *keys, F.col(right_id).alias("__b"), F.col(START).alias("__bs"), F.col(END).alias("__be"),
        _buckets(F.col(START), F.col(END), width_us).alias("__bucket"),
    )
    cell = [*keys, "__bucket"]
    sides = a.select(*cell, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        b.select(*cell, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    full = sides.groupBy(*cell).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r")).where(
        (F.greatest("__l", "__r") > bucket_rows) & (F.least("__l", "__r") > 0))
    split = durable(full.select(
        *cell, F.ceil(F.greatest("__l", "__r") / F.lit(bucket_rows)).cast("int").alias("__split"),
        (F.col("__l") >= F.col("__r")).alias("__left")))
    if not split.isEmpty():
        a = _salted(attach(a, split, cell), "__a", F.col("__left"))
        b = _salted(attach(b, split, cell), "__b", ~F.col("__left"))
        cell = [*cell, "__salt"]
    first_shared = F.greatest(F.floor(F.col("__as") / F.lit(width_us)), F.floor(F.col("__bs") / F.lit(width_us)))
    pairs = (
        a.join(b, cell)
        .where((F.col("__as") < F.col("__be")) & (F.col("__bs") < F.col("__ae")) & (F.col("__bucket") == first_shared))
        .select(
            *keys, F.col("__a").alias(left_id), F.col("__b").alias(right_id),
            (F.least("__ae", "__be") - F.greatest("__as", "__bs")).alias("overlap_us"),
        )
    )
    if how == "inner":
        return pairs
    seen = overlap_witness(
        left.select(*keys, left_id, START, END), right, keys, id_col=left_id, other_id=right_id)
    lonely = seen.where("witness is null").select(*keys, left_id)
    return pairs.unionByName(lonely, allowMissingColumns=True)


def _salted(rows: DataFrame, ident: str, spread: Column) -> DataFrame:
    """Rows with a salt: one value by id where this side is spread, else a copy for each."""
    parts = F.coalesce("__split", F.lit(1))
    one = F.array(F.pmod(F.xxhash64(ident), parts))
    each = F.sequence(F.lit(0), parts - 1).cast("array<bigint>")
    salts = F.when(F.coalesce(spread, F.lit(True)), one).otherwise(each)
    return rows.withColumn("__salt", F.explode(salts)).drop("__split", "__left")
