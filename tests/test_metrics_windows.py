import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from actiongrid.domain import ACTION_LABELS, COMPATIBLE_LABELS, DataError
from actiongrid.operators import detections as D
from actiongrid.operators import metrics as M
from actiongrid.operators import windows as W

# Published 7 x 7 and 6 x 6 scores can be recomputed from counts alone.


def test_small_matrix(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "target int, prediction int")
    doc = M.metrics_document(M.confusion(rows, ("a", "b"), strict=True), ("a", "b"))
    assert doc["accuracy"] == 0.75 and doc["confusion_matrix"]["values"] == [[1, 1], [0, 2]]
    assert doc["per_class"]["b"]["recall"] == 1.0
    assert doc["per_class"]["a"] == {"precision": 1.0, "recall": 0.5, "f1": 0.666667, "support": 2}
    with pytest.raises(DataError):
        M.confusion(rows.union(spark.createDataFrame([(2, 0)], rows.schema)), ("a", "b"), strict=True)
    empty = M.metrics_document(M.confusion(rows.limit(0), ("a", "b")), ("a", "b"))
    assert empty["accuracy"] == 0.0 and empty["samples"] == 0
    with pytest.raises(ValueError):
        M.confusion(rows, ())


def test_strict_and_compatible(spark):
    rows = spark.createDataFrame([("dig", "receive")], "expected_action string, predicted_action string")
    both = M.evaluate(rows)
    assert M.summary(both["strict"], ACTION_LABELS).first().accuracy == 0.0
    assert M.summary(both["compatible"], COMPATIBLE_LABELS).first().accuracy == 1.0


def test_weights_epochs_errors(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    weights = {r.label: r.weight for r in M.class_weights(rows, ("a", "b", "c")).collect()}
    assert weights == {"a": 4 / 9, "b": 4 / 3, "c": 0.0}
    history = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.5)], "epoch int, macro_f1 double")
    assert M.best_epoch(history).first().epoch == 2
    losses = M.epoch_losses(spark.createDataFrame([(1, 1.0, 3), (1, 2.0, 1)], "epoch int, loss double, samples int"))
    assert losses.first().loss == 1.25
    m = M.confusion(spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 0)], "target int, prediction int"), ("a", "b", "c"))
    assert [(r.target_label, r.predicted_label, r.n) for r in M.top_errors(m, ("a", "b", "c"), 2).collect()] == [
        ("a", "b", 2), ("b", "a", 1)]


def test_comparison(spark):
    schema = "k int, target int, prediction int"
    old = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 1)], schema)
    new = spark.createDataFrame([(2, 0, 0), (3, 1, 1), (4, 1, 0)], schema)
    r = M.comparison_report(M.compare_evaluations(old, new, ["k"])).first()
    assert (r.shared, r.removed, r.added, r.old_correct, r.new_correct, r.fixed) == (2, 1, 1, 2, 2, 1)


def names():
    return {0: "ball", 1: "spike", 2: " SERVE ", 3: "referee", 4: "set"}


def test_detections(spark):
    frames = spark.createDataFrame(
        [
            ("w", 0, [0, 1, 2], [0.9, 0.5, 0.5], [[0.0] * 4, [1.0] * 4, [2.0] * 4], names()),
            ("w", 1, [3, 2, 7, 4], [0.9, 0.5, 0.9, 0.99], [[0.0] * 4, [3.0] * 4, [0.0] * 4, [0.0] * 3], names()),
            ("x", 0, [1], [0.1], [[1.0] * 4], names()),
        ],
        "window_id string, frame_index int, class_ids array<int>, confidences array<double>, "
        "boxes array<array<double>>, names map<int,string>",
    )
    found = D.extract_detections(frames)
    assert [(r.frame_index, r.source_label, r.action) for r in found.where("window_id='w'").orderBy("frame_index", "position").collect()] == [
        (0, "spike", "attack"), (0, " SERVE ", "serve"), (1, " SERVE ", "serve")]
    windows = spark.createDataFrame([("w",), ("x",), ("y",)], "window_id string")
    best = {r.window_id: (r.action, r.conf_micro, r.n_detections)
            for r in D.window_winner(found, confidence_threshold=0.25, windows=windows).collect()}
    assert best == {"w": ("serve", 500_000, 3), "x": ("background", 0, 1), "y": ("background", 0, 0)}
    for limit in (10, 1):
        parts = D.evidence_parts(found, part_rows=2, max_rows=limit).orderBy("window_id", "part").collect()
        assert [(r.window_id, r.part, [(e.frame_index, e.action) for e in r.evidence]) for r in parts] == [
            ("w", 0, [(0, "attack"), (0, "serve")]), ("w", 1, [(1, "serve")]), ("x", 0, [(0, "attack")])]
    with pytest.raises(ValueError):
        D.window_winner(found, confidence_threshold=2)


def test_capabilities_and_scores(spark):
    models = spark.createDataFrame(
        [("good", {"10": "Block", "2": "receive", "0": "set", "3": "spike", "4": " serve"}), ("bad", {"0": "set"})],
        "model_id string, names map<string,string>")
    D.require_capabilities(models.where("model_id='good'"))
    with pytest.raises(DataError):
        D.require_capabilities(models)
    labels = D.model_labels(models.where("model_id='good'")).first().labels
    assert labels == ["set", "receive", "spike", " serve", "Block"]
    rows = spark.createDataFrame([([1.0, 3.0, 3.0],)], "scores array<double>")
    r = D.score_to_label(rows, "scores", ("a", "b", "c")).first()
    p = math.exp(0) / (math.exp(-2) + 2)
    assert r.action == "b" and r.conf_micro == round(p * 1e6)


def expected_windows(d, w, s):
    if d <= w:
        return [(0, d)]
    last = d - w
    out = [(i * s, i * s + w) for i in range(last // s + 1)]
    return out if out[-1][0] == last else out + [(last, d)]


def spans(spark, *durations):
    return spark.createDataFrame([(f"v{i}", int(d * 1e6)) for i, d in enumerate(durations)], "video_id string, duration_us long")


def test_sliding_windows(spark):
    df = spans(spark, 5.0, 0.8, 120000.0, 1.6)
    out = W.sliding_windows(df, window_seconds=2.0, stride_seconds=1.5).orderBy("video_id", "ordinal").collect()
    by = {}
    for r in out:
        by.setdefault(r.video_id, []).append((r.start_us, r.end_us))
    assert by["v0"] == [(0, 2_000_000), (1_500_000, 3_500_000), (3_000_000, 5_000_000)]
    assert by["v1"] == [(0, 800_000)] and by["v3"] == [(0, 1_600_000)]
    assert by["v2"] == expected_windows(120000 * 10**6, 2 * 10**6, 1500000)
    with pytest.raises(ValueError):
        W.sliding_windows(df, window_seconds=1.0, stride_seconds=1.5)


def test_accumulated_windows(spark):
    df = spans(spark, 5.0, 0.8, 7687.333333)
    out = W.sliding_windows(df, window_seconds=1.0, stride_seconds=0.4, accumulate=True)
    counts = Counter(r.video_id for r in out.select("video_id").collect())
    assert counts["v2"] == 19217 and counts["v1"] == 1
    first = [(r.start_us, r.ordinal) for r in out.where("video_id='v0'").orderBy("ordinal").collect()]
    assert first == [(i * 400_000, i) for i in range(11)]


def test_frames_sheets_batches_fill(spark):
    windows = spark.createDataFrame([("v", 0, 0, 3_000_000)], "video_id string, ordinal long, start_us long, end_us long")
    assert [r.sample_seconds for r in W.frame_times(windows, 3).orderBy("frame_index").collect()] == [0.5, 1.5, 2.5]
    media = spark.createDataFrame([("v", 10.0, 5.0)], "video_id string, duration_seconds double, fps double")
    assert [r.time_seconds for r in W.sheet_times(media, 4).orderBy("sample").collect()] == [2.0, 4.0, 6.0, 8.0]
    many = spark.createDataFrame([("v", i, i, i + 1) for i in range(7)], windows.schema)
    for limit in (100, 3):
        got = W.batch_groups(many, 3, max_rows=limit).orderBy("ordinal").collect()
        assert [(r.batch, r.completed) for r in got] == [(0, 3)] * 3 + [(1, 6)] * 3 + [(2, 7)]
        samples = spark.createDataFrame([("v", i, x) for i, x in enumerate(["a", None, None, "b", None])] + [("u", 0, None)],
                                        "k string, t int, frame string")
        filled = W.forward_fill(samples, keys=["k"], order=["t"], value="frame", max_rows=limit)
        assert [r.filled for r in filled.where("k='v'").orderBy("t").collect()] == ["a", "a", "a", "b", "b"]
        assert filled.where("missing_first").count() == 1
    with pytest.raises(ValueError):
        W.batch_groups(many, 0)


def test_report_records_in_order_and_metrics_from_them(spark, tmp_path):
    import json

    from actiongrid.operators.evaluation import write_report

    rows = spark.range(200).selectExpr(
        "(id * 37) % 200 as record_index", "'serve' as expected_action", "if(id % 4 = 0, 'dig', 'serve') as predicted_action").repartition(3)
    path = write_report(rows, str(tmp_path / "report"), settings={}, manifest={})
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "report" / "records").glob("part-*"))
    assert [r.record_index for r in spark.read.json(f"{path}/records").collect()] == list(range(200))
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    assert (head["metrics"]["strict"]["samples"], head["metrics"]["strict"]["accuracy"]) == (200, 0.75)
