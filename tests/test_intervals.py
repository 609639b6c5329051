import random

from collections import Counter

import pytest

from actiongrid.operators import segments as S
from actiongrid.plans import intervals as I
from actiongrid.plans.ordered import Running, order_by_key
from pyspark.sql import functions as F


def make(seed, n, name, keys=2, top=60):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", s, s + rng.randrange(0, 12), f"{name}{i:03d}")
            for i in range(n) for s in [rng.randrange(top)]]


def frames(spark, seed, na=60, nb=25):
    a, b = make(seed, na, "a"), make(seed + 1, nb, "b")
    return a, b, spark.createDataFrame(a, "key string, start_us long, end_us long, aid string"), \
        spark.createDataFrame(b, "key string, start_us long, end_us long, bid string")


@pytest.mark.parametrize("max_rows", [10_000, 9])
def test_sweeps_equal_brute_force(spark, max_rows):
    a, b, left, right = frames(spark, 3)
    got = {r.aid: r.witness for r in I.overlap_witness(left, right, ["key"], id_col="aid", other_id="bid", max_rows=max_rows).collect()}
    for key, s, e, ident in a:
        found = [y[3] for y in b if y[0] == key and s < y[2] and y[1] < e]
        assert (got[ident] is not None) == bool(found) and (not found or got[ident] in found)
    covered = {r.aid: (r.covered, r.cover_id) for r in I.cover(left, right, ["key"], id_col="aid", cover_id="bid", max_rows=max_rows).collect()}
    for key, s, e, ident in a:
        found = [y[3] for y in b if y[0] == key and y[1] <= s and e <= y[2]]
        assert covered[ident] == (min(len(found), 2), found[0] if len(found) == 1 else None)
    own = {r.aid: r.witness for r in I.earlier_overlap(left, ["key"], id_col="aid", max_rows=max_rows).collect()}
    for row in a:
        before = [x[3] for x in a if x[0] == row[0] and (x[1], x[2], x[3]) < row[1:] and x[2] > row[1] and row[2] > row[1]]
        assert (own[row[3]] is not None) == bool(before) and (not before or own[row[3]] in before)


@pytest.mark.parametrize("width,bucket_rows", [(5, 1000), (100, 4)])
def test_pairs(spark, width, bucket_rows):
    a, b, left, right = frames(spark, 11)
    want = {(x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b
            if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    got = I.overlap_pairs(left, right, ["key"], left_id="aid", right_id="bid", width_us=width, bucket_rows=bucket_rows, how="left").collect()
    pairs = [(r.aid, r.bid, r.overlap_us) for r in got if r.bid is not None]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert {r.aid for r in got} == {x[3] for x in a}


@pytest.mark.parametrize("max_rows", [100, 4])
def test_ordered_scan(spark, max_rows):
    rows = [(None if i % 5 == 0 else "k", i, None if i % 3 else i) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, t long, v long")
    out = order_by_key(df, ["key"], ["t"], max_rows=max_rows).scan(
        lag={"prev": "v"}, number="n",
        running={"total": Running("sum", F.col("t"), before=True), "low": Running("min", -F.col("t")), "seen": Running("last", F.col("v"))},
    ).rows().collect()
    for key in (None, "k"):
        mine = [r for r in rows if r[0] == key]
        got = {r.t: r for r in out if r.key == key}
        for i, (_, t, v) in enumerate(mine):
            r = got[t]
            known = [x[2] for x in mine[: i + 1] if x[2] is not None]
            assert (r.n, r.prev, r.total, r.low, r.seen) == (
                i + 1, mine[i - 1][2] if i else None, sum(x[1] for x in mine[:i]), -t, known[-1] if known else None)


def test_segments(spark):
    seg = spark.createDataFrame(
        [("v", "s1", "near", 1, 0, 100), ("v", "s2", "far", 2, 100, 200), ("v", "s3", "near", 3, 190, 300), ("v", "s4", "near", 4, 150, 150)],
        "video_id string, segment_id string, side string, position int, start_us long, end_us long")
    faults = {r.segment_id: r.fault for r in S.consecutive_faults(seg).collect()}
    assert faults == {"s1": None, "s2": None, "s3": "overlap", "s4": "empty"}
    items = spark.createDataFrame([("i1", "s1", "near", 0, 100), ("i2", "s1", "far", 0, 10), ("i3", "s1", "near", 50, 101), ("i4", "zz", "near", 0, 1)],
                                  "interval_id string, source_segment_id string, side string, start_us long, end_us long")
    assert {r.interval_id: r.inside for r in S.inside_named_segment(items, seg).collect()} == {"i1": True, "i2": False, "i3": False, "i4": False}
    wide = seg.where("segment_id in ('s1','s2')").selectExpr("video_id", "segment_id", "side", "start_us*1000000 start_us", "end_us*1000000 end_us")
    made = S.scan_windows(wide, window_seconds=50.0, stride_seconds=50.0, tolerance_us=1_000_000).orderBy("segment_id", "ordinal").collect()
    assert [(r.segment_id, r.side, r.start_us // 10**6, r.end_us // 10**6) for r in made] == [
        ("s1", "near", 0, 50), ("s1", "near", 50, 100), ("s1", "near", 51, 101),
        ("s2", "far", 99, 149), ("s2", "far", 149, 199), ("s2", "far", 151, 201)]
    events = spark.createDataFrame([("v", "e1", 40, 50), ("v", "e2", 90, 97), ("v", "e3", 105, 120)], "video_id string, event_id string, start_us long, end_us long")
    near = {r.event_id: r.near_boundary for r in S.boundary_vicinity(events, seg.where("segment_id='s1'"), tolerance_us=5).collect()}
    assert near == {"e1": False, "e2": True, "e3": True}
    refined = spark.createDataFrame([("i", "set", 1, 2, 0, 10), ("i", "dig", 3, 4, 0, 10)], "interval_id string, label string, start_us long, end_us long, range_start_us long, range_end_us long")
    actions = spark.createDataFrame([("i", "set", 1, 2), ("i", "dig", 3, 5), ("i", "dig", 20, 21)], "interval_id string, label string, start_us long, end_us long")
    assert {(r.end_us, r.in_refined) for r in S.refinement_faults(refined, actions).collect()} == {(4, 1), (5, 0)}


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_in_order(spark, parts):
    """Ranges in order without a sort of the input; ties, nulls and few values included."""
    from actiongrid.plans.ordered import in_order

    rows = [(i * 7919 % 500 // 3, f"x{i}") for i in range(700)] + [(None, "none")]
    df = spark.createDataFrame(rows, "n long, x string").repartition(5)
    made = in_order(df, "n", parts=parts)
    assert made.columns == ["n", "x"] and Counter(map(tuple, made.collect())) == Counter(rows)
    held = [[r.n if r.n is not None else -1 for r in part] for part in made.rdd.glom().collect()]
    flat = [n for part in held for n in part]
    assert flat == sorted(flat) and len([p for p in held if p]) >= min(parts, 3)
    assert in_order(df.limit(0), "n", parts=parts).count() == 0
    assert "rangepartitioning" not in made._jdf.queryExecution().executedPlan().toString()


def test_small_max_rows_makes_no_chunk_per_row(spark):
    """A limit of few rows cuts many keys, but tasks stay in proportion to rows."""
    rows = spark.range(4000).select((F.col("id") % 7).alias("key"), F.col("id").alias("t"))
    split = order_by_key(rows, ["key"], ["t"], max_rows=3)
    assert split.hot.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = split.scan(number="n").rows().where("n <> (t - key) div 7 + 1").count()
    assert (got, split.hot.count()) == (0, 4000)


def test_numbered_places_come_from_sorted_ranges(spark):
    """Gapless places over several ranges, without a second shuffle of whole rows by a window."""
    from actiongrid.plans.ordered import numbered

    rows = spark.range(30_000).selectExpr("(id * 7919) % 30000 as t", "id % 2 as origin").repartition(5)
    made = numbered(rows, ("origin", "t"), "place")
    want = F.col("origin") * F.lit(15_000) + F.expr("t div 2") + 1
    assert made.count() == 30_000 and made.where(F.col("place") != want).isEmpty()
    assert "row_number" not in made._jdf.queryExecution().executedPlan().toString()


def test_ordinary_keys_get_more_partitions_with_more_rows(spark, monkeypatch):
    from actiongrid.plans import ordered as O

    monkeypatch.setattr(O, "TASK_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") % 50).alias("key"), F.col("id").alias("t"))
    split = O.order_by_key(rows, ["key"], ["t"])
    assert split.hot is None and split.cold.rdd.getNumPartitions() == 10
    assert split.scan(number="n").rows().where("n <> t div 50 + 1").isEmpty()
