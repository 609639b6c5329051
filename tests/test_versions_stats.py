import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from actiongrid.domain import ReviewError
from actiongrid.functions.hashing import drifted, merkle_tree, set_hash, updated_tree
from actiongrid.operators import health as H
from actiongrid.operators import stats as S
from actiongrid.operators import versions as V
from actiongrid.session import durable


def test_rally_notes(spark):
    rows = spark.createDataFrame([
        ("A", "05-06 serve; 07-08 dig; 30-31 block（没碰到球）; 57-02 set", 3_605_000_000, 3_664_000_000),
        ("B", "2:58-3:00 dig, 3:00-02 attack, 02-03 block", 177_000_000, 185_000_000),
        ("C", "1:41-43 set", 10_898_000_000, 10_910_000_000),
        ("D", "40:10-40:12 serve 40:15-40:16 receive", 2_408_000_000, 2_418_000_000),
        ("E", "background（x）", 0, 1), ("F", "", 0, 1)],
        "interval_id string, note string, start_us long, end_us long")
    out = V.rally_notes(rows)
    got = {}
    for r in out.orderBy("interval_id", "position").collect():
        got.setdefault(r.interval_id, []).append((r.label, r.start_us // 10**6, r.end_us // 10**6, r.ignored))
    assert got == {
        "A": [("serve", 3605, 3606, None), ("dig", 3607, 3608, None), ("block", 3630, 3631, "no_touch"), ("set", 3657, 3662, None)],
        "B": [("dig", 178, 180, None), ("attack", 180, 182, None), ("block", 182, 183, None)],
        "C": [("set", 10901, 10903, None)],
        "D": [("serve", 2410, 2412, None), ("receive", 2415, 2416, None)]}
    assert [r.interval_id for r in V.notes_without_actions(rows, out).collect()] == ["E"]


def test_expansion(spark):
    schema = "record_index long, video_path string, start_seconds string, end_seconds string, label string, split string, review_status string, notes string"
    rows = spark.createDataFrame([(i, "a.mp4", str(i), str(i + 1), "dig", "train", "reviewed", "n") for i in (1, 2, 3)], schema)
    snap = lambda i: ("a.mp4", str(i), str(i + 1), "dig", "train")
    struct = "struct<video_path:string,start_seconds:string,end_seconds:string,label:string,split:string>"
    rschema = f"remove_record_index long, keep_record_index long, removed {struct}, kept {struct}"
    removals = spark.createDataFrame([(2, 1, snap(2), snap(1))], rschema)
    actions = spark.createDataFrame([(1, "a.mp4", "set", 9.0, 10.5, "train", "S!G5", "09-10", "09-10 set")],
                                    "position int, video_path string, label string, start_seconds double, end_seconds double, split string, workbook_cell string, input_time string, source_note string")
    out = V.apply_expansion(rows, removals, actions, batch="01")
    got = out.orderBy("origin", "ordinal").collect()
    assert [(r.start_seconds, r.label) for r in got] == [("1", "dig"), ("3", "dig"), ("9", "set")]
    assert got[-1].notes == "Expansion batch 01; source workbook cell S!G5; input time 09-10; confirmed=set@9-10.5; source note: 09-10 set"
    assert V.expansion_summary(out, removals).first().asDict() == {"kept_records": 2, "added_records": 1, "output_records": 3, "removed_records": 1}
    with pytest.raises(ReviewError):
        V.apply_expansion(rows, spark.createDataFrame([(2, 1, snap(2), snap(9))], rschema), actions, batch="01")


def test_diff_and_changes(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert {(r.k, r.old_count, r.new_count, r.status) for r in V.version_diff(old, new, ["k", "v"]).collect()} == {
        (1, 2, 1, "removed"), (2, 1, 1, "unchanged"), (3, 0, 1, "added")}
    s = "source_record_id int, label string, start_us long, end_us long"
    a = spark.createDataFrame([(1, "set", 0, 1), (2, "set", 0, 1), (3, "set", 0, 1), (4, "set", 0, 1)], s)
    b = spark.createDataFrame([(1, "set", 0, 1), (2, "dig", 0, 2), (3, "set", 0, 2), (5, "set", 0, 1)], s)
    assert {r.source_record_id: r.operation for r in V.change_set(a, b).collect()} == {
        1: "keep", 2: "relabel", 3: "move_window", 4: "remove_window", 5: "add_window"}


@pytest.mark.parametrize("max_rows", [100, 2])
def test_revisions(spark, max_rows):
    rev = spark.createDataFrame(
        [("a1", "e1", 1, None, "predicted"), ("a2", "e1", 2, "a1", "review"), ("a3", "e1", 2, "a2", "review"), ("b1", "e2", 1, None, "predicted"),
         ("b2", "e2", 3, "a1", "review"), ("b3", "e2", 4, "zz", "review"), ("b4", "e2", 5, None, "review")],
        "revision_id string, event_id string, revision_no int, parent_id string, origin string")
    faults = {r.revision_id: r.fault for r in V.revision_faults(rev, max_rows=max_rows).collect()}
    assert faults == {"a3": "number_repeated", "b2": "parent_foreign", "b3": "parent_missing", "b4": "second_root"}
    assert {r.event_id: r.revision_id for r in V.latest_revisions(rev).collect()} == {"e1": "a3", "e2": "b4"}
    assert V.raw_predictions(rev).count() == 2
    events = spark.createDataFrame([("e1", "a2"), ("e2", "gone")], "event_id string, current_revision_id string")
    assert {r.event_id: r.revision_no for r in V.current_revisions(events, rev).collect()} == {"e1": 2, "e2": None}
    assert [r.revision_id for r in V.fixed_snapshot(events, rev).collect()] == ["a2"]


def test_lineage(spark):
    """Against walking every chain by hand, with cycles of 1, 2 and 5 and a missing parent."""
    import random

    rng = random.Random(2)
    parent = {f"r{i}": (f"r{rng.randrange(i)}" if i % 9 else None) for i in range(1, 60)}
    parent["r0"] = "gone"
    parent |= {f"l{i}": f"l{i - 1}" if i else None for i in range(70)}
    parent |= {"s": "s", "t0": "t1", "t1": "t0", **{f"u{i}": f"u{(i + 1) % 5}" for i in range(5)}, "v": "u3", "w": "v", "x": "s"}
    want = {}
    for node in parent:
        path, at = [node], node
        while parent.get(at) in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if parent.get(at) in parent:
            loop = path[path.index(parent[at]):]
            want[node] = ("cycle" if node in loop else "into_cycle", None, None, min(loop), len(loop))
        else:
            want[node] = ("rooted", at, len(path) - 1, None, None)
    rows = spark.createDataFrame(list(parent.items()), "revision_id string, parent_id string")
    assert {r.id: tuple(r)[1:] for r in V.revision_lineage(rows).collect()} == want
    assert V.revision_lineage(rows.limit(0)).count() == 0


def test_hashes_ignore_order_and_partitions(spark):
    rows = spark.range(100).selectExpr("id", "cast(id % 7 as string) v")
    a = V.table_hash(rows, ["id", "v"]).first()
    b = V.table_hash(rows.repartition(5).orderBy(F.desc("id")), ["v", "id"]).first()
    c = V.table_hash(rows.where("id <> 3"), ["id", "v"]).first()
    assert a == b and a.set_sha256 != c.set_sha256
    assert len(V.row_hashes(rows, ["id"]).first().content_sha256) == 64


def brute_set_hash(digests):
    counts = Counter(d for d in digests if d is not None)
    level = [(d, f"{d}:{n}") for d, n in sorted(counts.items())]
    for length in (4, 2, 0):
        parts = {}
        for prefix, h in level:
            parts.setdefault(prefix[:length], []).append(h)
        level = [(p, hashlib.sha256("".join(hs).encode()).hexdigest()) for p, hs in sorted(parts.items())]
    return level[0][1] if level else None


def test_set_hash_of_copies_and_nulls(spark):
    sha = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [("a", sha(i % 900)) for i in range(2000)] + [("a", sha(1))] * 40_000 + [(g, None) for g in ("a", "b", "c", "c")] + [("b", sha(7))] * 3 + [(None, sha(8))]
    df = spark.createDataFrame(rows, "g string, h string").repartition(7)
    got = {r.g: (r.rows, r.set_sha256) for r in set_hash(df, "h", ["g"]).collect()}
    assert got == {g: (len(own), brute_set_hash(own)) for g in ("a", "b", "c", None) for own in [[h for k, h in rows if k == g]]}
    whole = set_hash(df, "h").collect()
    assert [(r.rows, r.set_sha256) for r in whole] == [(len(rows), brute_set_hash([h for _, h in rows]))]
    empty = set_hash(df.limit(0), "h").collect()
    assert [(r.rows, r.set_sha256) for r in empty] == [(0, hashlib.sha256(b"").hexdigest())]


def test_set_hash_of_a_hot_digest(spark):
    """Copies that would make a string of over 2 GB are one leaf."""
    h, copies = hashlib.sha256(b"hot").hexdigest(), 34_000_000
    want = f"{h}:{copies}"
    for _ in range(3):
        want = hashlib.sha256(want.encode()).hexdigest()
    assert tuple(set_hash(spark.range(copies).select(F.lit(h).alias("h")), "h").first()) == (copies, want)


def test_trees(spark):
    """A tree updated by a change is the tree of the changed rows; two trees name what differs."""
    sha = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    old = [sha(i % 400) for i in range(600)] + [None]
    gone, fresh = [sha(3), sha(3), sha(399), sha(250)], [sha(9), sha(1000), sha(1001), sha(1001)]
    left = Counter(old)
    left.subtract(gone)
    left.update(fresh)
    new = list(left.elements())
    frame = lambda rows: spark.createDataFrame([(h,) for h in rows], "h string")
    tree, fine = durable(merkle_tree(frame(old), "h")), merkle_tree(frame(new), "h")
    made = updated_tree(tree, frame(fresh), frame(gone), "h")
    assert Counter(map(tuple, made.collect())) == Counter(map(tuple, fine.collect()))
    assert made.where("depth = 0").first().sha256 == brute_set_hash(new)
    a, b = Counter(old), Counter(new)
    assert {tuple(r) for r in drifted(tree, fine).collect()} == {(h, a[h], b[h]) for h in a | b if a[h] != b[h]}
    assert drifted(tree, tree).count() == 0
    empty = merkle_tree(frame([]), "h")
    assert {tuple(r) for r in drifted(empty, tree).collect() if r.digest} == {(h, 0, n) for h, n in a.items() if h}


def test_imports(spark):
    jobs = spark.createDataFrame([(1, "w", "csv", "h1", 1, ""), (2, "w", "csv", "h1", 1, ""), (3, "w", "csv", "h2", 1, "")],
                                 "job_id int, workspace_id string, import_kind string, source_sha256 string, contract_version int, options string"
                                 ).withColumn("idempotency_key", V.idempotency_key())
    done = jobs.where("job_id = 3").select("idempotency_key", F.lit(0).alias("job_id"), F.lit("succeeded").alias("status"))
    assert {r.job_id: r.decision for r in V.classify_imports(jobs, done).collect()} == {1: "run", 2: "duplicate", 3: "reuse"}
    s = "entity_type string, id string, sha string"
    have = spark.createDataFrame([("event", "1", "x"), ("version", "2", "x")], s)
    come = spark.createDataFrame([("event", "1", "x"), ("version", "2", "y"), ("event", "3", "z")], s)
    for policy, want in {"fail": ["fail"] * 3, "skip_identical": ["reuse", "insert", "fail"], "fork_versions": ["reuse", "insert", "fork"], "remap_ids": ["remap"] * 3}.items():
        got = V.resolve_conflicts(have, come, policy, versioned=["version"]).orderBy("entity_type", "id").collect()
        assert [r.decision for r in got] == want
    whole = V.resolve_conflicts(have, come.where("id <> '2'"), "fail").orderBy("id").collect()
    assert [r.decision for r in whole] == ["reuse", "insert"]
    with pytest.raises(ValueError):
        V.resolve_conflicts(have, come, "last_write_wins")
    refs = spark.createDataFrame([("version", "2", "event", "1")], "source_type string, source_id string, target_type string, target_id string")
    new, rewritten = V.remap_ids(come, refs, "pkg")
    assert rewritten.first().new_target_id == new.where("id='1'").first().new_id


def test_states_and_scope(spark):
    rows = spark.createDataFrame([("predicted", False, None), ("predicted", True, None), ("imported", False, None), ("imported", True, "move_window")],
                                 "origin string, queued boolean, operation string")
    assert [r.s for r in rows.select(V.item_state().alias("s")).collect()] == ["predicted", "queued_for_review", "source", "reviewed_moved"]
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "video_id string")
    assert [r.video_id for r in V.shared_matches(a, a.where("video_id='x'")).collect()] == ["x"]


def test_stats(spark):
    ev = spark.createDataFrame([(1, "7", "set", "a"), (2, None, "set", "a"), (3, " ", "dig", "b"), (4, "7", "dig", "a")],
                               "event_id int, player_number string, action string, team string")
    assert {(r.player, r.action, r.n) for r in S.action_counts(ev).collect()} == {
        ("7", "set", 1), ("Unknown", "set", 1), ("Unknown", "dig", 1), ("7", "dig", 1)}
    levels = {(r.level, r.player, r.action): r.n for r in S.action_rollup(ev).collect()}
    assert levels[(3, None, None)] == 4 and levels[(1, "7", None)] == 2 and levels[(2, None, "set")] == 2
    assert {(r.team, r.team_total, r.attributed, r.unattributed) for r in S.attribution(ev).collect()} == {("a", 3, 2, 1), ("b", 1, 0, 1)}
    defs = {"dig_share": (F.col("action") == "dig", F.lit(True)), "none": (F.lit(True), F.col("action") == "block")}
    got = {(r.team, r.stat): (r.numerator, r.denominator, r.value) for r in S.ratio_stats(ev, ["team"], defs).collect()}
    assert got[("a", "dig_share")] == (1, 3, 1 / 3) and got[("b", "none")] == (0, 0, None)
    assert S.stat_evidence(ev, ["team"], defs).where("counted").count() == 2
    snap = S.snapshot(ev, ["team"], version="v1", hash_columns=["event_id", "action"])
    rebuilt = S.snapshot(ev.withColumn("action", F.when(F.col("team") == "b", "set").otherwise(F.col("action"))), ["team"], version="v2", hash_columns=["event_id", "action"])
    assert {r.team: r.state for r in S.supersede(snap, rebuilt, ["team"]).collect()} == {"a": "current", "b": "superseded"}
    wide = spark.createDataFrame([("a", 1, 2)], "team string, x int, y int")
    assert {(r.team, r.metric, r.value) for r in S.metric_long(wide, ["team"], ["x", "y"]).collect()} == {("a", "x", 1), ("a", "y", 2)}


def test_time_on_court(spark):
    sets = spark.createDataFrame([("v", "s1", 0, 100), ("v", "s2", 100, 200)], "video_id string, set_id string, start_us long, end_us long")
    stints = spark.createDataFrame([("v", 1, "p", 50, 150), ("v", 2, "p", 190, 250), ("v", 3, "q", 0, 10)], "video_id string, stint_id int, player string, start_us long, end_us long")
    got = {(r.set_id, r.player): r.played_us for r in S.playing_time(stints, sets, range_rows=2).collect()}
    assert got == {("s1", "p"): 50, ("s2", "p"): 60, ("s1", "q"): 10}
    rallies = spark.createDataFrame([("v", 1, "near", 0, 10), ("v", 2, "near", 20, 30), ("v", 3, "far", 110, 120), ("v", 4, "far", 90, 110)], "video_id string, rally_id int, winner string, start_us long, end_us long")
    assert {(r.set_id, r.winner, r.points) for r in S.set_points(rallies, sets).collect()} == {("s1", "near", 2), ("s2", "far", 1), (None, "far", 1)}


def test_health(spark):
    assets = spark.createDataFrame([(1, "video", 10), (2, "video", 5), (3, "model", 7)], "asset_id int, kind string, bytes long")
    refs = spark.createDataFrame([(1,), (1,), (9,)], "asset_id int")
    table = H.status_table([
        H.check("foreign_keys", H.dangling(refs, "asset_id", assets, "asset_id")),
        H.check("orphaned_assets", H.orphans(assets, refs), severity="warning"),
        H.check("split_isolation", H.split_mixing(spark.createDataFrame([("m", "train"), ("m", "train")], "match_id string, split string"))),
        H.check("hashes", H.hash_drift(spark.createDataFrame([("a", "a"), ("a", None)], "x string, y string"), "x", "y")),
        H.not_run(spark, "later")])
    assert {r.check_name: (r.status, r.faults) for r in table.collect()} == {
        "foreign_keys": ("error", 1), "orphaned_assets": ("warning", 2), "split_isolation": ("healthy", 0), "hashes": ("error", 1), "later": ("not_run", 0)}
    usage = {r.kind: (r.assets, r.bytes, r.unreferenced_assets, r.unreferenced_bytes) for r in H.storage_usage(assets, refs).collect()}
    assert usage == {"video": (2, 15, 1, 5), "model": (1, 7, 1, 7)}
    inv = H.entity_inventory({"asset": assets.selectExpr("asset_id id", "sha2(kind,256) sha"), "ref": refs.selectExpr("asset_id id", "sha2('x',256) sha")})
    assert {r.entity_type: r.entities for r in inv.collect()} == {"asset": 3, "ref": 3}
    with pytest.raises(ValueError):
        H.in_workspace(assets, "w")
