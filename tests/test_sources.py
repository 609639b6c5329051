import json

import pytest

from actiongrid.domain import EVENT_COLUMNS, WINDOWS
from actiongrid.operators.events import event_table, merge_windows
from actiongrid.operators.inference import infer_events, score_windows, window_grid
from actiongrid.operators.training import epoch_scores, fit_window_classifier, weighted_loss
from actiongrid.sources.documents import read_match
from actiongrid.sources.sinks import inference_documents, read_record, write_documents, write_events_csv, write_record


def test_match_document(spark, tmp_path):
    doc = {"match_id": "m", "segments": [{"segment_id": "s1", "start_seconds": 0.5, "end_seconds": 9.0, "crop": [0, 0, 4, 4]},
                                         {"segment_id": "s2", "start_seconds": 9.0, "end_seconds": 12.0, "crop": None}]}
    path = tmp_path / "match.json"
    path.write_text(json.dumps(doc, indent=2))
    rows = read_match(spark, str(path), "segments").orderBy("segment_id").collect()
    assert [(r.segment_id, r.end_seconds, r.crop) for r in rows] == [("s1", 9.0, [0, 0, 4, 4]), ("s2", 12.0, None)]


def test_event_outputs(spark, tmp_path):
    sec = 10**6
    windows = spark.createDataFrame([("v", i, i * sec, (i + 1) * sec, "set" if i != 2 else "dig", 900_000) for i in range(5)], WINDOWS)
    events = event_table(merge_windows(windows), model_version="m")
    path = write_events_csv(events, str(tmp_path / "events"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == list(EVENT_COLUMNS)  # the reader takes the mark off
    parts = list((tmp_path / "events").glob("part-*.csv"))
    assert parts and all(p.read_bytes().startswith(b"\xef\xbb\xbfvideo_id,") for p in parts)
    assert back.count() == 3
    media = spark.createDataFrame([("v", 30.0)], "video_id string, fps double")
    made = inference_documents(media, events, windows, model_version="m", settings={"crop": None}, part_rows=3)
    docs = [json.loads(r[0]) for r in spark.read.text(write_documents(made, str(tmp_path / "docs"))).collect()]
    assert sorted((len(d["events"]), len(d["windows"])) for d in docs) == [(0, 2), (3, 3)]
    assert all(d["format_version"] == 1 and d["video"]["fps"] == 30.0 and d["settings"] == {"crop": None} for d in docs)
    record = {"epochs": 3, "labels": ["a"], "note": "é"}
    assert read_record(spark, write_record(spark, record, str(tmp_path / "run"))) == record
    with pytest.raises(ValueError):
        write_events_csv(events, path, inputs=[path])


def test_inference(spark):
    media = spark.createDataFrame([("v", 2.0)], "video_id string, duration_seconds double")
    grid = window_grid(media, window_seconds=1.0, stride_seconds=0.5)
    scores = spark.createDataFrame([("v", i, [0.0, 5.0]) for i in range(3)], "video_id string, ordinal long, scores array<double>")
    events, counters = infer_events(score_windows(grid, scores, ("background", "serve")), model_version="m")
    (e,) = events.collect()
    assert (e.start_ms, e.end_ms, e.action) == (0, 2000, "serve")
    assert counters.first().asDict() == {"video_id": "v", "window_count": 3, "event_count": 1}


def test_training(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(i % 2), 1.0]), "ab"[i % 2], "val" if i % 5 == 0 else "train") for i in range(40)]
    df = spark.createDataFrame(rows, ["features", "label", "split"])
    _, report = fit_window_classifier(df, ("a", "b"), max_iterations=(3, 6))
    assert report["best_macro_f1"] == 1.0 and report["best_epoch"] == 1
    with pytest.raises(ValueError):
        fit_window_classifier(df.where("split = 'train'"), ("a", "b"))
    loss = weighted_loss(spark.createDataFrame([(1, 1.0), (1, 1.0)], "epoch int, probability double")).first()
    assert (loss.samples, loss.loss) == (2, 0.0)


@pytest.mark.parametrize("learnable", [True, False])
def test_epoch_scores(spark, learnable):
    from pyspark.ml.linalg import Vectors

    labels = ("a", "b", "c")
    rows = [(Vectors.dense([float(i % 3 == 1 and i % 7 > 0), float(i % 3 == 2)] if learnable else [0.0, 0.0]), labels[i % 3], "val" if i % 5 == 0 else "train")
            for i in range(91)]
    df = spark.createDataFrame(rows, ["features", "label", "split"])
    model, report = fit_window_classifier(df, labels, max_iterations=(4,))
    guess = {r.features: int(r.prediction) for r in model.transform(df.select("features").distinct()).collect()}
    train = [label for _, label, split in rows if split == "train"]
    common = max(labels, key=train.count)
    got = {r.split: r for r in epoch_scores(df, report).collect()}
    assert set(got) == {"train", "val"}
    for split, r in got.items():
        pairs = [(label, labels[guess[x]]) for x, label, s in rows if s == split]
        right = sum(a == b for a, b in pairs)
        f1 = [2 * sum(a == b == c for a, b in pairs) / max(sum((a == c) + (b == c) for a, b in pairs), 1) for c in labels]
        assert (r.epoch, r.samples) == (1, len(pairs))
        assert abs(r.accuracy - right / len(pairs)) < 1e-6 and abs(r.macro_f1 - sum(f1) / 3) < 1e-6
        assert r.beats_majority == (right > sum(a == common for a, _ in pairs))
    assert {r.beats_majority for r in got.values()} == {learnable} or not learnable
    assert not learnable or min(r.accuracy for r in got.values()) > 0.9
    assert learnable or not got["train"].beats_majority


def test_train_scores_query(spark):
    from workload import load

    queries, twins = load()
    rows = queries["train_scores"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.epoch, r.split) for r in rows) == [(1, "train"), (1, "val"), (2, "train"), (2, "val")]
    assert "train_scores" not in twins and "train_eval" in twins


def plain_fit(x, y, w, splits, order, epochs, rate, decay, classes):
    """Adam over weighted softmax regression, batch after batch, in plain loops."""
    import numpy as np

    rows = np.hstack([x, np.ones((len(x), 1))])
    weights = first = second = np.zeros((rows.shape[1], classes))
    steps, history = 0, []

    def forward(at):
        logits = rows[at] @ weights
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        loss = sum(-np.log(chance[i, y[j]]) * w[j] for i, j in enumerate(at)) / w[at].sum()
        return chance, loss, logits.argmax(axis=1)

    for _ in range(epochs):
        total = right = 0
        for at in order:
            chance, loss, guess = forward(at)
            total += loss * len(at)
            right += (guess == y[at]).sum()
            wrong = chance - np.eye(classes)[y[at]]
            gradient = rows[at].T @ (wrong * w[at][:, None]) / w[at].sum() + decay * weights
            steps += 1
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            weights = weights - rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        _, loss, guess = forward(splits["val"])
        history.append((total / sum(map(len, order)), right / sum(map(len, order)), loss, (guess == y[splits["val"]]).mean()))
    return weights, history


def test_epochs_go_on(spark):
    """Losses, scores and weights against plain loops; a fit in two halves is the fit in one."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from actiongrid.operators.training import fit_epochs

    labels, rng = ("a", "b", "c"), np.random.default_rng(4)
    y = rng.choice(3, 90, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(90, 4)) + 2 * np.eye(3, 4)[y]
    split = np.where(np.arange(90) % 6 == 0, "val", "train")
    df = spark.createDataFrame([(Vectors.dense(v), labels[c], s) for v, c, s in zip(x.tolist(), y.tolist(), split.tolist())], ["features", "label", "split"]).coalesce(1)
    n = np.bincount(y[split == "train"], minlength=3)
    w = (len(y[split == "train"]) / (3 * n))[y]
    train = np.flatnonzero(split == "train")
    blocks = [train[i:i + 20] for i in range(0, len(train), 20)]
    # blocks are numbered as they fill: 0, 1, 2, then the rest of val, then the rest of train
    order = [np.concatenate([b for b, i in zip(blocks, (0, 1, 2, 4)) if i % 2 == k]) for k in range(2)]
    best, state, report = fit_epochs(df, labels, epochs=3, steps=2, learning_rate=0.1, block_rows=20)
    weights, history = plain_fit(x, y, w, {"val": np.flatnonzero(split == "val")}, order, 3, 0.1, 1e-4, 3)
    found = [(h["train_loss"], h["train"]["accuracy"], h["val_loss"], h["val"]["accuracy"]) for h in report["history"]]
    assert np.allclose(found, history, atol=2e-6) and np.allclose(state.matrix, weights)
    assert [h["train"]["samples"] for h in report["history"]] == [75] * 3 and report["best_macro_f1"] > 0.6
    assert report["history"][-1]["train_loss"] < report["history"][0]["train_loss"]
    _, half, _ = fit_epochs(df, labels, epochs=1, steps=2, learning_rate=0.1, block_rows=20)
    _, whole, again = fit_epochs(df, labels, epochs=2, steps=2, learning_rate=0.1, block_rows=20, go_on=half)
    assert np.allclose(whole.matrix, state.matrix) and again["history"] == report["history"]
    _, spread, _ = fit_epochs(df.repartition(40), labels, epochs=1, steps=1, learning_rate=0.1, block_rows=2)
    _, one, _ = fit_epochs(df, labels, epochs=1, steps=1, learning_rate=0.1)
    assert np.allclose(spread.matrix, one.matrix)


def test_one_file_from_sorted_parts(spark, tmp_path):
    """One file in order, though no task sorts all rows; the header stands once."""
    from actiongrid.plans.ordered import in_order
    from actiongrid.sources.documents import Document
    from actiongrid.sources.manifest_csv import scan_csv
    from actiongrid.sources.sinks import write_csv, write_list_document

    n = 30_000
    rows = spark.range(n).selectExpr("(id * 7919) % 30000 as position", "concat('{\"a\": ', (id * 7919) % 30000, '}') as item").repartition(5)
    ordered = in_order(rows, "position")
    assert ordered.rdd.getNumPartitions() > 1
    path = write_csv(ordered, str(tmp_path / "csv"), ["position", "item"], one_file=True)
    assert [p.name for p in (tmp_path / "csv").iterdir() if p.name[0] not in "._"] == ["part-00000.csv"]
    cells = scan_csv(spark, path, place="place")
    assert cells.count() == n and cells.where("position <> place - 1 or item <> concat('{\"a\": ', position, '}')").isEmpty()
    doc = Document(spark, write_list_document({"b": 1}, "l", rows, str(tmp_path / "doc")))
    items = doc.items("l")
    assert doc.fields["b"] == 1 and items.count() == n and items.where("item <> concat('{\"a\": ', position - 1, '}')").isEmpty()
    empty = write_list_document({}, "l", rows.limit(0), str(tmp_path / "empty"))
    assert Document(spark, empty).items("l").count() == 0
    with pytest.raises(FileExistsError):
        write_csv(ordered, path, ["position"], one_file=True)
