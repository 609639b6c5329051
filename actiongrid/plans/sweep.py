"""Overlapping pairs by a plane sweep over ranges of one time line.

Both sides lie on one line ordered by (key, start), which is cut into ranges of about equal
numbers of rows; a hot key simply has several ranges, whatever the lengths of its intervals. An
interval goes to the range it starts in and, as an open one, to every later range it reaches
into, so a very long interval costs one row a cut. Inside a range the partners of an interval
that start while it runs are neighbours in the order, and its partners among the open ones are
those that end last: both are runs of rows, found by binary search and written out piece by
piece. A pair belongs to the range of its later start, so none repeats.

The cut points are read off a sample of the stored line, a few rows a range.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .guards import positive

START, END = "start_us", "end_us"
#: Rows a range should have, and sampled rows a range to find its cut.
RANGE_ROWS = 500_000
SAMPLED = 32
#: Rows sampled for ranges smaller than RANGE_ROWS.
MOST_SAMPLED = 500_000
#: Pairs written in one batch.
BATCH = 200_000


def cut_points(line: DataFrame, range_rows: int, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key hash, start) of the first place of every range but the first, in order.

    The driver holds SAMPLED rows a range, of MOST_SAMPLED at most: beyond, ranges get more rows.
    """
    n = line.count() if n is None else n
    ranges = min(-(-n // range_rows), max(-(-n // RANGE_ROWS), MOST_SAMPLED // SAMPLED))
    if ranges < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wanted = SAMPLED * ranges
    drawn = line.select("__hash", "__start")
    if n > 4 * wanted:
        drawn = drawn.sample(2.0 * wanted / n, seed=7)
    rows = drawn.toArrow()
    hashes, starts = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.lexsort((starts, hashes))
    at = order[np.linspace(0, len(order), ranges + 1).astype(int)[1:-1]]
    return hashes[at], starts[at]


def places(cuts: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, points: np.ndarray, side: str) -> np.ndarray:
    """How many cuts lie before (`left`: strictly before) each (hash, point)."""
    low, high = (np.searchsorted(cuts[0], hashes, s) for s in ("left", "right"))
    while len(open_ := np.flatnonzero(low < high)):  # a binary search among the cuts inside the key, all rows at once
        middle = (low[open_] + high[open_]) // 2
        at, point = cuts[1][middle], points[open_]
        before = at < point if side == "left" else at <= point
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
    return low


def _ranks(groups: np.ndarray, values: np.ndarray, at_groups: np.ndarray, at_values: np.ndarray, side: str) -> np.ndarray:
    """searchsorted by (group, value); (groups, values) are sorted."""
    both = np.concatenate([groups, at_groups]), np.concatenate([values, at_values])
    asked = np.concatenate([np.zeros(len(groups), np.int8), np.full(len(at_groups), -1 if side == "left" else 1, np.int8)])
    order = np.lexsort((asked, both[1], both[0]))
    before = np.cumsum(order < len(groups))
    out = np.empty(len(asked), np.int64)
    out[order] = before
    return out[len(groups):]


def _runs(rows: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(row, partner place) of the runs low..high of each row, in slices of about BATCH pairs."""
    counts = np.maximum(high - low, 0)
    total = np.cumsum(counts)
    first = 0
    while first < len(rows):
        done = total[first - 1] if first else 0
        last = max(int(np.searchsorted(total, done + BATCH, "right")), first + 1)
        part = counts[first:last]
        if last == first + 1 and part[0] > BATCH:  # one row with very many partners
            for at in range(int(low[first]), int(high[first]), BATCH):
                some = np.arange(at, min(at + BATCH, int(high[first])))
                yield np.full(len(some), rows[first]), some
        elif part.sum():
            shift = np.repeat(low[first:last] - (np.cumsum(part) - part), part)
            yield np.repeat(rows[first:last], part), np.arange(part.sum()) + shift
        first = last


def range_pairs(group: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, opened: np.ndarray):
    """(left row, right row) of all strict overlaps of a range, except between two open ones."""
    order = np.lexsort((start, group))
    new = {side: order[~opened[order] & (left[order] == side)] for side in (True, False)}
    by_end = np.lexsort((-end, group))
    old = {side: by_end[opened[by_end] & (left[by_end] == side)] for side in (True, False)}
    for side in (True, False):
        mine, others, running = new[side], new[not side], old[not side]
        # partners that start while mine runs; equal starts count once, on the left side
        low = _ranks(group[others], start[others], group[mine], start[mine], "left" if side else "right")
        high = _ranks(group[others], start[others], group[mine], end[mine], "left")
        for a, b in _runs(mine, low, high):
            yield (a, others[b]) if side else (others[b], a)
        first = np.searchsorted(group[running], group[mine], "left")
        upto = _ranks(group[running], -end[running], group[mine], -start[mine], "left")
        for a, b in _runs(mine, first, upto):
            yield (a, running[b]) if side else (running[b], a)


def sweep_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_id: str, right_id: str, how: str = "inner",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """All strictly overlapping pairs (keys, left_id, right_id, overlap_us).

    `how='left'` also gives each lonely row of `left`, with nulls; there left_id tells the rows of
    a key apart. Rows of a null key or bound have no partner, equal rows pair for themselves.
    """
    positive("range_rows", range_rows)
    keys = list(keys)

    kind_a, kind_b = left.schema[left_id].dataType, right.schema[right_id].dataType

    def side(rows: DataFrame, is_left: bool) -> DataFrame:
        ident_a = F.col(left_id) if is_left else F.lit(None).cast(kind_a)
        ident_b = F.lit(None).cast(kind_b) if is_left else F.col(right_id)
        return rows.select(
            F.xxhash64(*keys).alias("__hash"), F.to_json(F.struct(*keys)).alias("__key"),
            F.col(START).cast("long").alias("__start"), F.col(END).cast("long").alias("__end"), F.lit(is_left).alias("__left"),
            *keys, ident_a.alias("__a"), ident_b.alias("__b"),
        ).where(" and ".join(f"`{c}` is not null" for c in [*keys, "__start", "__end"]))

    line = durable(side(left, True).unionByName(side(right, False)))
    n_rows = line.count()
    cuts = cut_points(line, range_rows, n_rows)
    shared = line.sparkSession.sparkContext.broadcast(cuts)

    def dealt(batches):
        for batch in batches:
            hashes, starts, ends = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            own = places(shared.value, hashes, starts, "right")
            last = np.maximum(places(shared.value, hashes, ends, "left"), own)
            copies = last - own + 1
            row = np.repeat(np.arange(len(own)), copies)
            number = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            made = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*made.columns, pa.array(own[row] + number), pa.array(number > 0)], [*made.schema.names, "__range", "__open"])

    wide = T.StructType([*line.schema.fields, T.StructField("__range", T.LongType()), T.StructField("__open", T.BooleanType())])
    ranged = line.mapInArrow(dealt, wide)
    # a task takes several ranges, one after another, if they are smaller than is worth a task
    tasks = min(len(cuts[0]) + 1, max(int(line.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // RANGE_ROWS)))
    ranged = ranged.repartition(tasks, "__range").sortWithinPartitions("__range")
    names = [*keys, left_id, right_id, "overlap_us"]
    kinds = [*(line.schema[k].dataType for k in keys), kind_a, kind_b, T.LongType()]
    out = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def pairs_of(table: pa.Table):
        column = lambda n: table.column(n).combine_chunks()
        group = column("__key").dictionary_encode().indices.to_numpy().astype(np.int64)
        start, end = (column(n).to_numpy() for n in ("__start", "__end"))
        is_left, opened = (column(n).to_numpy(zero_copy_only=False) for n in ("__left", "__open"))
        for a, b in range_pairs(group, start, end, is_left, opened):
            real = (start[a] < end[b]) & (start[b] < end[a])
            a, b = a[real], b[real]
            if len(a):
                overlap = np.minimum(end[a], end[b]) - np.maximum(start[a], start[b])
                of = lambda n, rows: column(n).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(of(k, a) for k in keys), of("__a", a), of("__b", b), pa.array(overlap)], names)

    def swept(batches):
        held, number = [], None
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("__range")).to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and ids[a] != number:
                    yield from pairs_of(pa.Table.from_batches(held))
                    held = []
                number = ids[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    pairs = ranged.mapInArrow(swept, out)
    if how == "inner":
        return pairs
    pairs = durable(pairs)
    met = pairs.select(left_id, *keys).distinct()
    lonely = left.select(*keys, left_id).join(met, [left_id, *keys], "left_anti")
    return pairs.unionByName(lonely.select(*keys, left_id), allowMissingColumns=True)
