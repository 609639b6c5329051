"""Ordered analytics that do not depend on one task per key.

A window function needs all rows of a key in one task. That is right for the
many keys of ordinary size, and wrong for a key that holds a large part of the
table. `order_by_key` therefore measures the keys first (one partially
aggregated count). Keys above `max_rows` are cut into ordered chunks by range
partitioning on (key, order); the chunk number is stored with the rows on
reliable storage, so a recomputed task can never see another cut. `scan`
evaluates running values per (key, chunk) and adds what earlier chunks carry
over, using one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

CHUNK = "__chunk"
MAX_ROWS = 4_000_000
#: Rows of a chunk below which more chunks are no use, beyond one for each shuffle partition.
CHUNK_ROWS = 1_000_000
#: Rows of ordinary keys that one task holds on average; its windows take about a kilobyte a row.
TASK_ROWS = 1_000_000
#: Rows of a range that is sorted and written by one task, at least and at most (for even ranges).
RANGE_ROWS = (10_000, 500_000)
#: Quantiles taken in the pass that counts the rows.
GRID = 2048
#: So many hot keys are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi join that keeps one copy of the key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    joined = left.join(renamed, same_keys(left, renamed, [(k, f"__k_{k}") for k in keys]), how)
    return joined.drop(*[f"__k_{k}" for k in keys])


@dataclass(frozen=True)
class Running:
    """A running value: kind is sum, max, min or last (last non-null)."""

    kind: str
    value: Column
    before: bool = False  # exclude the current row


@dataclass(frozen=True)
class OrderedRows:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    cold: DataFrame
    hot: DataFrame | None = None

    def map(self, step: Callable[[DataFrame], DataFrame]) -> "OrderedRows":
        """Row-wise step on both parts (must keep keys, order and chunk)."""
        return OrderedRows(
            self.keys, self.order, step(self.cold), None if self.hot is None else step(self.hot)
        )

    def rows(self) -> DataFrame:
        if self.hot is None:
            return self.cold
        return self.cold.unionByName(self.hot.drop(CHUNK))

    def scan(
        self,
        *,
        lag: Mapping[str, str] | None = None,
        running: Mapping[str, Running] | None = None,
        number: str | None = None,
    ) -> "OrderedRows":
        """Add previous-row values, running values and a 1-based row number."""
        lag, running = dict(lag or {}), dict(running or {})
        if number:
            running[number] = Running("sum", F.lit(1).cast("long"))
        cold = _local(self.cold, self.keys, self.order, lag, running)
        hot = None
        if self.hot is not None:
            hot = _carried(self.hot, self.keys, self.order, lag, running)
        return OrderedRows(self.keys, self.order, cold, hot)


def order_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, max_rows: int = MAX_ROWS,
    key_counts: DataFrame | None = None,
) -> OrderedRows:
    """Split `df` into ordinary keys and chunked hot keys.

    `key_counts` (the keys and a count `n`, at least what `df` holds of each) spares the count
    over `df`; a dataset keeps it beside its data. Without it one count is run here.
    """
    keys, order = tuple(keys), tuple(order)
    if key_counts is None:
        key_counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot_if = F.col("n") > max_rows
    n_keys, n_rows, n_all = key_counts.agg(F.count_if(hot_if), F.sum(F.when(hot_if, F.col("n"))), F.sum("n")).first()
    if not n_keys:
        return OrderedRows(keys, order, _spread(df, keys, n_all or 0))
    heavy = durable(key_counts.where(hot_if).select(*keys))
    if n_keys <= BROADCAST_KEYS:
        heavy = F.broadcast(heavy)
    condition = same_keys(df, heavy, [(k, k) for k in keys])
    cold = df.join(heavy, condition, "left_anti")
    hot = durable(
        df.join(heavy, condition, "left_semi")
        .repartitionByRange(chunk_count(df.sparkSession, int(n_rows), max_rows), *keys, *order)
        .withColumn(CHUNK, F.spark_partition_id())
    )
    return OrderedRows(keys, order, _spread(cold, keys, n_all - n_rows), hot)


def _spread(cold: DataFrame, keys: Sequence[str], n_rows: int) -> DataFrame:
    """`cold` by its keys, in more partitions than the session's if these got more than TASK_ROWS each."""
    parts = -(-n_rows // TASK_ROWS)
    usual = int(cold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cold.repartition(parts, *keys) if parts > usual else cold


def chunk_count(spark, n_rows: int, max_rows: int) -> int:
    """Chunks for `n_rows` rows of hot keys: quarters of `max_rows`, yet a task should be worth its start.

    Every chunk is a task, a sample and a bound on the driver. A small `max_rows` says which keys are
    cut; it does not make chunks of a few rows out of a large table.
    """
    enough = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // CHUNK_ROWS))
    return max(2, min(-(-n_rows * 4 // max_rows), enough))


def in_order(df: DataFrame, column: str, *, parts: int | None = None) -> DataFrame:
    """`df` in the order of a whole-number `column`: every partition holds a range of it, in order.

    A sort would sample its whole input, and so evaluate it a second time. Here the cut points
    are quantiles of `column` alone: what the plan computes for other columns is pruned away.
    `parts` follows from the number of rows if not given (see `range_count`); nulls come first.
    """
    quantiles = lambda n: F.percentile_approx(
        column, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(max(10_000, 20 * n)))
    narrow, points = df.select(column), []
    if not parts:  # a fine grid, of which the cuts are taken once the number of rows is known
        n_rows, grid = narrow.agg(F.count(F.lit(1)), quantiles(GRID)).first()
        parts = range_count(df.sparkSession, n_rows)
        points = [grid[i * GRID // parts - 1] for i in range(1, parts)] if grid and parts <= GRID else []
    if parts > 1 and not points:
        points = narrow.agg(quantiles(parts)).first()[0]
    cuts = sorted(set(points or []))
    return (
        df.withColumn("__bucket", F.coalesce(_cuts_upto(F.col(column), cuts), F.lit(0)))
        .repartitionById(len(cuts) + 1, "__bucket").drop("__bucket").sortWithinPartitions(column)
    )


def range_count(spark, n_rows: int) -> int:
    """Ranges of sorted rows: as many as shuffle partitions, unless these get too few or too many rows."""
    least, most = RANGE_ROWS
    usual = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // least))
    return max(1, usual, -(-n_rows // most))


def _cuts_upto(value: Column, cuts: Sequence[int]) -> Column:
    """How many of the sorted `cuts` are not above `value`, by two short scans."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    runs = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    literal = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    run = F.size(F.filter(literal([r[0] for r in runs]), lambda c: c <= value))
    inner = F.size(F.filter(F.get(F.array(*map(literal, runs)), run - 1), lambda c: c <= value))
    return F.when(run == 0, 0).otherwise((run - 1) * step + inner)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`df` with the place of each row (from 1, without gaps) in the order of `order`.

    Rows are cut into ranges, sorted and stored with their place in their range, and counted per
    range; no task sees more than its range. Rows equal in `order` get places next to each other.
    """
    parts = range_count(df.sparkSession, df.select(*order).count())
    # an id of two parts: the partition above 33 bits, the row in it below
    stored = durable(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    of = F.shiftright("__id", 33)
    counts = stored.groupBy(of.alias("__of")).agg(F.count(F.lit(1)).alias("__n"))  # a row per range
    starts = counts.select("__of", (F.sum("__n").over(Window.orderBy("__of")) - F.col("__n")).alias("__before"))
    local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored.join(F.broadcast(starts), of == F.col("__of"))
    return placed.withColumn(name, F.col("__before") + local + 1).drop("__id", "__of", "__before")


def _window(keys, order, before=False):
    spec = Window.partitionBy(*keys).orderBy(*order)
    return spec.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)


def _evaluate(run: Running, keys, order) -> Column:
    over = _window(keys, order, run.before)
    if run.kind == "sum":
        return F.coalesce(F.sum(run.value).over(over), F.lit(0))
    if run.kind == "max":
        return F.max(run.value).over(over)
    if run.kind == "min":
        return F.min(run.value).over(over)
    if run.kind == "last":
        return F.last(run.value, ignorenulls=True).over(over)
    raise ValueError(f"unknown running kind {run.kind}")


def _local(df, keys, order, lag, running) -> DataFrame:
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.select(
        "*",
        *[F.lag(c).over(spec).alias(out) for out, c in lag.items()],
        *[_evaluate(r, keys, order).alias(out) for out, r in running.items()],
    )


def _carried(hot: DataFrame, keys, order, lag, running) -> DataFrame:
    parts = (*keys, CHUNK)
    position = F.struct(*[F.col(c) for c in order])
    totals = []
    for i, (out, column) in enumerate(lag.items()):
        totals.append(F.max_by(F.struct(F.col(column).alias("v")), position).alias(f"__l{i}"))
    for i, run in enumerate(running.values()):
        if run.kind == "sum":
            total = F.sum(run.value)
        elif run.kind == "max":
            total = F.max(run.value)
        elif run.kind == "min":
            total = F.min(run.value)
        else:
            total = F.max_by(run.value, F.when(run.value.isNotNull(), position))
        totals.append(total.alias(f"__r{i}"))
    summary = hot.groupBy(*parts).agg(*totals)
    over = Window.partitionBy(*keys).orderBy(CHUNK)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.lag(f"__l{i}").over(over).alias(f"__cl{i}") for i in range(len(lag))]
    for i, run in enumerate(running.values()):
        column = f"__r{i}"
        value = {
            "sum": F.coalesce(F.sum(column).over(before), F.lit(0)),
            "max": F.max(column).over(before),
            "min": F.min(column).over(before),
            "last": F.last(column, ignorenulls=True).over(before),
        }[run.kind]
        carry.append(value.alias(f"__cr{i}"))
    carried = summary.select(*parts, *carry)

    base = hot.columns
    local = _local(hot, parts, order, lag, {**running, "__nth_in_chunk": Running("sum", F.lit(1))})
    joined = attach(local, carried, parts)
    outputs = []
    for i, out in enumerate(lag):
        outputs.append(
            F.when(F.col("__nth_in_chunk") == 1, F.col(f"__cl{i}.v")).otherwise(F.col(out)).alias(out)
        )
    for i, (out, run) in enumerate(running.items()):
        mine, theirs = F.col(out), F.col(f"__cr{i}")
        value = {
            "sum": mine + theirs,
            "max": F.greatest(mine, theirs),
            "min": F.least(mine, theirs),
            "last": F.coalesce(mine, theirs),
        }[run.kind]
        outputs.append(value.alias(out))
    return joined.select(*base, *outputs)
