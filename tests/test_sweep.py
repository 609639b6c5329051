"""Pairs of the plane sweep against all pairs, for ranges of any size."""

import random
from collections import Counter

import numpy as np
import pytest

from actiongrid.plans import sweep as S


def intervals(rng, n, keys, reach):
    rows = []
    for i in range(n):
        start = rng.randint(0, reach)
        rows.append((rng.choice(keys), start, start + rng.choice([0, 1, rng.randint(0, 12), reach]), i))
    return rows


def overlaps(a, b):
    return a[0] is not None and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize("seed", range(8))
def test_one_range(seed, monkeypatch):
    """Natives and open rows of one range; every pair with at least one native, once."""
    monkeypatch.setattr(S, "BATCH", 5)
    rng = random.Random(seed)
    cut = 20
    natives = [(k, s + cut, e + cut, i) for k, s, e, i in intervals(rng, 60, [0, 1, 2], 40)]
    opened = [(k, s, max(e, cut + rng.randint(1, 40)), i) for k, s, e, i in intervals(rng, 20, [0, 1], cut - 1)]
    rows = natives + opened
    group, start, end = (np.array([r[i] for r in rows]) for i in range(3))
    left = np.array([rng.random() < 0.5 for _ in rows])
    is_open = np.arange(len(rows)) >= len(natives)
    found = []
    for a, b in S.range_pairs(group, start, end, left, is_open):
        real = (start[a] < end[b]) & (start[b] < end[a])
        found += list(zip(a[real].tolist(), b[real].tolist()))
    want = [(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows)
            if left[i] and not left[j] and not (is_open[i] and is_open[j]) and overlaps(x, y)]
    assert sorted(found) == sorted(want)


def test_places():
    cuts = np.array([1, 5, 5, 5, 9]), np.array([7, 0, 10, 20, 3])
    hashes, points = np.array([0, 1, 1, 1, 5, 5, 5, 5, 9, 12]), np.array([50, 6, 7, 8, -1, 0, 10, 99, 2, 0])
    before = lambda strict: [sum((c, s) < (h, p) if strict else (c, s) <= (h, p) for c, s in zip(*cuts)) for h, p in zip(hashes, points)]
    assert S.places(cuts, hashes, points, "left").tolist() == before(True)
    assert S.places(cuts, hashes, points, "right").tolist() == before(False)


@pytest.mark.parametrize("range_rows", [7, 40, 10_000])
def test_pairs(spark, range_rows):
    rng = random.Random(range_rows)
    a = intervals(rng, 150, ["hot", "hot", "hot", "k", None], 200) + [("hot", 0, 500, 900), ("hot", 5, 5, 901)]
    b = intervals(rng, 120, ["hot", "hot", "k", "z", None], 200) + [("hot", 0, 500, 900), ("hot", 0, 500, 900)]
    schema = "key string, start_us long, end_us long, {} long, extra string"
    left, right = (spark.createDataFrame([(*r, "x") for r in rows], schema.format(n)) for rows, n in ((a, "aid"), (b, "bid")))
    got = S.sweep_pairs(left, right, ["key"], left_id="aid", right_id="bid", how="left", range_rows=range_rows).collect()
    want = Counter((x[0], x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b if overlaps(x, y))
    want.update((x[0], x[3], None, None) for x in a if not any(overlaps(x, y) for y in b))
    assert Counter(map(tuple, got)) == want
    inner = S.sweep_pairs(left, right, ["key"], left_id="aid", right_id="bid", range_rows=range_rows)
    assert inner.count() == sum(n for (_, _, partner, _), n in want.items() if partner is not None)
    assert S.sweep_pairs(left.limit(0), right, ["key"], left_id="aid", right_id="bid", how="left").count() == 0
    assert S.sweep_pairs(left, right.limit(0), ["key"], left_id="aid", right_id="bid", how="left").count() == len(a)


def test_long_interval_costs_one_row_a_cut(spark):
    """The rows dealt are all intervals once, and the long one once for each later range."""
    rows = [("k", i, i + 1, i) for i in range(1000)] + [("k", 0, 1000, 1000)]
    df = spark.createDataFrame(rows, "key string, start_us long, end_us long, id long")
    line = df.selectExpr("xxhash64(key) as __hash", "start_us as __start", "end_us as __end")
    cuts = S.cut_points(line, 100)
    hashes, starts, ends = (line.toArrow().column(i).to_numpy() for i in range(3))
    copies = S.places(cuts, hashes, ends, "left") - S.places(cuts, hashes, starts, "right")
    assert copies.max() == len(cuts[0]) >= 9 and (copies > 0).sum() == 1
    with pytest.raises(ValueError):
        S.sweep_pairs(df, df, ["key"], left_id="id", right_id="id", range_rows=0)


def test_small_ranges_share_tasks(spark):
    rows = [("k", i, i + 2, i) for i in range(1000)]
    left = spark.createDataFrame(rows, "key string, start_us long, end_us long, aid long")
    pairs = S.sweep_pairs(left, left.withColumnRenamed("aid", "bid"), ["key"], left_id="aid", right_id="bid", range_rows=7)
    assert pairs.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pairs.count() == 1000 + 2 * 999
