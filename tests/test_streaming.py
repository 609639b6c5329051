import random

from actiongrid.domain import WINDOWS
from actiongrid.operators.events import merge_windows
from actiongrid.streaming.merge import MergeSettings, StreamState, closed_events, finish, run_batch, start_merge_stream, step
from actiongrid.streaming.statelog import StateLog
from actiongrid.streaming.validate import leaks_so_far, start_leakage, start_validation
from test_events import random_rows


def test_stream_equals_batch(spark, tmp_path):
    rows = [(v, i, s, e, a, c) for v, i, s, e, a, c in random_rows(5, videos=3, n=40)]
    rows.sort(key=lambda r: (r[2], r[3], r[1]))
    rng = random.Random(1)
    files = tmp_path / "in"
    for n in range(3):
        part = [r for i, r in enumerate(rows) if i * 3 // len(rows) == n]
        rng.shuffle(part)
        # starts tie across files are late by rule, so cut between distinct starts
        spark.createDataFrame(part, WINDOWS).coalesce(1).write.mode("append").parquet(str(files / f"p{n}"))
    settings = MergeSettings.of(merge_gap_seconds=0.1, min_event_seconds=0.2, delay_seconds=1.0, confidence_threshold=0.3)
    stream = spark.readStream.schema(WINDOWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(files))
    base = str(tmp_path / "out")
    query = start_merge_stream(stream, base, settings, checkpoint=str(tmp_path / "cp"))
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    finish(spark, base, last, settings, WINDOWS)
    late = spark.read.parquet(base + "/late").count()
    assert late == 0
    key = lambda r: (r.video_id, r.event_no, r.start_us, r.end_us, r.action, r.conf_sum, r.n_windows)
    got = sorted(map(key, spark.read.parquet(base + "/events").collect()))
    want = sorted(map(key, merge_windows(spark.createDataFrame(rows, WINDOWS), confidence_threshold=0.3,
                                         merge_gap_seconds=0.1, min_event_seconds=0.2).collect()))
    assert got == want


def test_state_log(spark, tmp_path):
    """A batch writes the keys it touched; the latest entry counts, before and after snapshots."""
    log = StateLog(spark, str(tmp_path), "k", {"head": "k string, n long", "rows": "k string, x long"}, compact_every=3)
    rng, now = random.Random(0), {}
    history = [{}]
    for batch in range(11):
        keys = rng.sample("abcdefgh", 3)
        for k in keys:
            now[k] = (batch, [rng.randrange(9) for _ in range(rng.randrange(3))])
        history.append(dict(now))
        heads = spark.createDataFrame([(k, now[k][0]) for k in keys], "k string, n long")
        rows = spark.createDataFrame([(k, x) for k in keys for x in now[k][1]], "k string, x long")
        for _ in range(2):  # taken again, with the same result
            seen = log.before(batch)
            assert {r.k: r.n for r in seen["head"].collect()} == {k: n for k, (n, _) in history[batch].items()}
            assert sorted(map(tuple, seen["rows"].collect())) == sorted((k, x) for k, (_, xs) in history[batch].items() for x in xs)
            few = log.before(batch, heads.select("k"))
            assert {r.k for r in few["head"].collect()} == set(keys) & set(history[batch])
            log.write(batch, {"head": heads, "rows": rows})
            log.compact(batch)
        assert spark.read.parquet(f"{tmp_path}/head/batch={batch}").count() == 3
    left = sorted(p.name for p in (tmp_path / "head").iterdir())
    assert left == ["batch=10", "batch=6", "batch=7", "batch=8", "batch=9", "upto=5", "upto=8"]


def test_merge_writes_touched_videos_only(spark, tmp_path):
    settings = MergeSettings.of(delay_seconds=1.0)
    frame = lambda videos, at: spark.createDataFrame([(v, at, at * 10**6, (at + 1) * 10**6, "set", 900_000) for v in videos], WINDOWS)
    for batch, videos in enumerate([[f"v{i}" for i in range(20)], ["v3"], ["v3", "v7"]]):
        run_batch(spark, str(tmp_path), batch, frame(videos, batch), settings)
        assert spark.read.parquet(f"{tmp_path}/state/videos/batch={batch}").count() == len(videos)
    finish(spark, str(tmp_path), 2, settings, WINDOWS)
    got = {r.video_id: (r.start_us, r.end_us, r.n_windows) for r in closed_events(spark, str(tmp_path)).collect()}
    want = {f"v{i}": (0, 10**6, 1) for i in range(20)} | {"v3": (0, 3 * 10**6, 3)}
    assert {k: v for k, v in got.items() if k != "v7"} == {k: v for k, v in want.items() if k != "v7"}


def test_hot_videos_over_batches(spark, tmp_path):
    """Videos above max_rows, counted from the arrivals, equal the batch merge; windows wait for the delay."""
    rows = sorted(random_rows(6, videos=2, n=40), key=lambda r: (r[2], r[3], r[1]))
    settings = MergeSettings.of(merge_gap_seconds=0.1, min_event_seconds=0.2, delay_seconds=1.0, confidence_threshold=0.3, max_rows=8)
    cuts = [0, len(rows) // 2, len(rows)]
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        run_batch(spark, str(tmp_path), batch, spark.createDataFrame(rows[low:high], WINDOWS), settings)
    finish(spark, str(tmp_path), 1, settings, WINDOWS)
    want = merge_windows(spark.createDataFrame(rows, WINDOWS), confidence_threshold=0.3, merge_gap_seconds=0.1, min_event_seconds=0.2)
    got = closed_events(spark, str(tmp_path)).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_jobs_of_a_merge_batch(spark, tmp_path):
    """Videos, merged spans and the next state are stored once; no output computes them again."""
    context = spark.sparkContext
    rows = [(f"v{i}", i, 10**6, 2 * 10**6, "set", 900_000) for i in range(20)]
    context.setJobGroup("merge batch", "")
    try:
        run_batch(spark, str(tmp_path), 0, spark.createDataFrame(rows, WINDOWS), MergeSettings.of())
        jobs = len(context.statusTracker().getJobIdsForGroup("merge batch"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 45


def test_leakage_stream(spark, tmp_path):
    """Four batches with a restart between them: reported once, in the batch in which it leaks."""
    schema = "record_index long, video_path string, start_seconds string, end_seconds string, label string, split string"
    batches = [[("a", "train"), ("b", "val"), ("a", "train")], [("b", "test"), ("c", "val")], [("a", "val"), ("b", "train"), ("c", "bad")], [("c", "val"), ("a", "test")]]
    told = []
    for n, part in enumerate(batches):
        spark.createDataFrame([(10 * n + i, v, "0", "1", "set", s) for i, (v, s) in enumerate(part)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = start_leakage(stream, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), compact_every=2)
        query.awaitTermination()
        told.append(sorted((r.video_path, r.splits, r.firsts) for r in spark.read.parquet(str(tmp_path / f"out/leaks/batch={n}")).collect()))
    assert told == [[], [("/b", 6, [None, 1, 10])], [("/a", 3, [0, 20, None])], []]
    assert sorted((r.video_path, r.splits) for r in leaks_so_far(spark, str(tmp_path / "out"), 3).collect()) == [
        ("/a", ["test", "train", "val"]), ("/b", ["test", "train", "val"])]


def test_late_windows_go_aside(spark):
    settings = MergeSettings.of(delay_seconds=0.0)
    first = step(StreamState.empty(spark), spark.createDataFrame([("v", 0, 0, 10**6, "set", 900000), ("v", 1, 5 * 10**6, 6 * 10**6, "set", 900000)], WINDOWS), settings)
    assert [(r.event_no, r.start_us) for r in first.events.collect()] == [(1, 0)]
    second = step(first.state, spark.createDataFrame([("v", 2, 10**6, 2 * 10**6, "set", 900000)], WINDOWS), settings, final=True)
    assert [r.ordinal for r in second.late.collect()] == [2]
    assert [(r.event_no, r.start_us) for r in second.events.collect()] == [(2, 5 * 10**6)]


def test_validation_stream(spark, tmp_path):
    schema = "record_index long, video_path string, start_seconds string, end_seconds string, label string, split string"
    spark.createDataFrame([(1, "a", "0", "1", "set", "train"), (2, "a", "1", "0", "set", "x")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = start_validation(stream, str(tmp_path / "ok"), str(tmp_path / "bad"), checkpoint=str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r.record_index for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    (bad,) = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert [e.code for e in bad.errors] == ["bad_split", "bad_order"]
