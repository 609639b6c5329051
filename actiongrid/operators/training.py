"""Fitting a window classifier on feature vectors.

A multinomial logistic regression with inverse-frequency class weights; both a train and a val
split are required. `fit_epochs` goes on from epoch to epoch: examples lie in stored blocks,
tasks sum gradients over their blocks, sums are folded in a tree, and the driver takes a step
with one small matrix. `fit_window_classifier` fits Spark ML's model anew for each of several
iteration budgets. Both keep the first epoch with the best val macro F1.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..plans.guards import positive
from ..plans.literal import ordinal_of
from ..session import durable
from .manifest import require_train_and_val
from .metrics import class_weights, confusion, metrics_document


def weighted_examples(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Class index and inverse-frequency weight (from the train split) for every row."""
    weights = class_weights(rows.where("split = 'train'"), labels).select("label", "weight")
    # at most one row per label of the closed domain
    return rows.join(F.broadcast(weights), "label").withColumn(
        "class_index", ordinal_of("label", labels).cast("double")
    )


def fit_window_classifier(
    rows: DataFrame, labels: Sequence[str], *, features: str = "features",
    max_iterations: Sequence[int] = (5, 10, 20), regularization: float = 1e-4,
):
    """Fit one model per iteration budget ('epoch'), score train and val, keep the first
    budget with the best val macro F1. rows: features (vector), label, split."""
    from pyspark.ml.classification import LogisticRegression

    positive("regularization", regularization)
    for n in max_iterations:
        positive("max_iterations", n)
    require_train_and_val(rows)
    examples = weighted_examples(rows, labels).persist()
    try:
        history, best = [], None
        for epoch, iterations in enumerate(max_iterations, start=1):
            model = LogisticRegression(
                featuresCol=features, labelCol="class_index", weightCol="weight", family="multinomial",
                maxIter=iterations, regParam=regularization,
            ).fit(examples.where("split = 'train'"))
            record = {"epoch": epoch, "iterations": iterations}
            for split in ("train", "val"):
                scored = model.transform(examples.where(F.col("split") == split)).select(
                    F.col("class_index").cast("int").alias("target"), F.col("prediction").cast("int").alias("prediction")
                )
                record[split] = metrics_document(confusion(scored, labels), labels)
            history.append(record)
            if best is None or record["val"]["macro_f1"] > best[1]:
                best = (model, record["val"]["macro_f1"], epoch)
    finally:
        examples.unpersist()
    return best[0], {"best_epoch": best[2], "best_macro_f1": best[1], "labels": list(labels), "history": history}


@dataclass
class Weights:
    """The model (a row per feature, the last for the constant) and the moments of its steps."""

    matrix: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    epoch: int = 0
    history: list = field(default_factory=list)

    @classmethod
    def zero(cls, features: int, classes: int) -> "Weights":
        return cls(*(np.zeros((features + 1, classes)) for _ in range(3)))

    def step(self, gradient: np.ndarray, rate: float) -> None:
        """One step of Adam."""
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        mean, spread = self.first / (1 - 0.9**self.steps), self.second / (1 - 0.999**self.steps)
        self.matrix = self.matrix - rate * mean / (np.sqrt(spread) + 1e-8)


def example_blocks(examples: DataFrame, features: str, block_rows: int) -> DataFrame:
    """(split, block, x, y, w): up to `block_rows` examples of a split as packed matrices."""
    from pyspark.ml.functions import vector_to_array

    def packed(batches):
        held: dict[str, list] = {}
        number = 0

        def row(split: str, rows: list):
            x, y, w = (np.array(c, np.float64) for c in zip(*rows))
            values = [[split], [number], [x.tobytes()], [y.tobytes()], [w.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["split", "block", "x", "y", "w"])

        for batch in batches:
            for split, *example in zip(*(c.to_pylist() for c in batch.columns)):
                rows = held.setdefault(split, [])
                rows.append(example)
                if len(rows) == block_rows:
                    yield row(split, held.pop(split))
                    number += 1
        for split, rows in held.items():
            yield row(split, rows)
            number += 1

    rows = examples.where("split in ('train', 'val')").select("split", vector_to_array(features).alias("x"), "class_index", "weight")
    return rows.mapInArrow(packed, "split string, block long, x binary, y binary, w binary")


def _forward(matrix: np.ndarray, x: bytes, y: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sums, gradient) of a block; sums are weights, weighted losses, then the confusion cells."""
    classes = matrix.shape[1]
    target, weight = np.frombuffer(y).astype(np.int64), np.frombuffer(w)
    rows = np.frombuffer(x).reshape(len(target), -1)
    rows = np.hstack([rows, np.ones((len(rows), 1))])
    logits = rows @ matrix
    logits -= logits.max(axis=1, keepdims=True)
    chance = np.exp(logits)
    chance /= chance.sum(axis=1, keepdims=True)
    at = np.arange(len(target))
    loss = -np.log(np.maximum(chance[at, target], 1e-300)) * weight
    cells = np.bincount(target * classes + logits.argmax(axis=1), minlength=classes * classes)
    chance[at, target] -= 1
    return np.concatenate([[weight.sum(), loss.sum()], cells]), rows.T @ (chance * weight[:, None])


def block_sums(blocks: DataFrame, matrix: np.ndarray, fan_in: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(sums, gradient) over all blocks, each task's folded first, then `fan_in` by `fan_in`.

    Sums are added in the order of the partitions, so a repeated run gives the same weights.
    """
    classes = matrix.shape[1]
    size = 2 + classes * classes
    shared = blocks.sparkSession.sparkContext.broadcast(matrix)

    def of_task(batches):
        total = np.zeros(size + matrix.size)
        for batch in batches:
            for x, y, w in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums, gradient = _forward(shared.value, x, y, w)
                total += np.concatenate([sums, gradient.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    def folded(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                totals[node] = totals.get(node, 0) + np.frombuffer(raw)
        nodes = sorted(totals)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array([totals[n].tobytes() for n in nodes], pa.binary())], ["part", "sums"])

    parts = blocks.select("x", "y", "w").mapInArrow(of_task, "sums binary").select(F.spark_partition_id().alias("part"), "sums")
    left = blocks.rdd.getNumPartitions()
    while left > fan_in:
        left = -(-left // fan_in)
        node = F.floor(F.col("part") / fan_in).cast("int").alias("node")
        dealt = parts.select(node, "part", "sums").repartition(left, "node").sortWithinPartitions("node", "part")
        parts = dealt.mapInArrow(folded, "part int, sums binary")
    total = np.zeros(size + matrix.size)
    for r in sorted(parts.collect(), key=lambda r: r.part):  # at most fan_in rows
        total += np.frombuffer(bytes(r.sums))
    return total[:size], total[size:].reshape(matrix.shape)


def _scores(cells: np.ndarray, labels: Sequence[str]) -> dict:
    classes = len(labels)
    cells = cells.reshape(classes, classes).astype(np.int64)
    n, right = int(cells.sum()), int(np.trace(cells))
    given, found = cells.sum(axis=1), cells.sum(axis=0)
    f1 = 2 * np.diag(cells) / np.maximum(given + found, 1)
    return {
        "samples": n, "accuracy": round(right / n, 6) if n else 0.0, "macro_f1": round(float(f1.mean()), 6),
        "confusion_matrix": {"labels": list(labels), "values": cells.tolist()},
    }


def fit_epochs(
    rows: DataFrame, labels: Sequence[str], *, features: str = "features", epochs: int = 10, steps: int = 4,
    learning_rate: float = 0.05, weight_decay: float = 1e-4, block_rows: int = 4096, go_on: Weights | None = None,
) -> tuple[np.ndarray, Weights, dict]:
    """(best model, weights to go on from, report). rows: features (vector), label, split.

    An epoch takes `steps` steps, each over its share of the stored train blocks. The train loss
    and scores of an epoch are those met before each step, the val ones those after the last.
    A step's loss is the mean by weight, an epoch's loss the mean of its steps by examples.
    """
    for name, value in (("epochs", epochs), ("steps", steps), ("learning_rate", learning_rate), ("block_rows", block_rows)):
        positive(name, value)
    require_train_and_val(rows)
    blocks = durable(example_blocks(weighted_examples(rows, labels), features, block_rows))
    train, val = (blocks.where(F.col("split") == s) for s in ("train", "val"))
    width = train.select(F.length("x") / F.length("y")).first()[0]
    state = go_on or Weights.zero(int(width), len(labels))
    best = (state.matrix, -1.0, 0)
    for h in state.history:
        best = (state.matrix, h["val"]["macro_f1"], h["epoch"]) if h["val"]["macro_f1"] > best[1] else best
    for _ in range(epochs):
        state.epoch += 1
        losses, cells = 0.0, np.zeros(len(labels) ** 2)
        for number in range(steps):
            sums, gradient = block_sums(train.where(F.pmod("block", F.lit(steps)) == number), state.matrix)
            if not sums[0]:
                continue  # fewer blocks than steps
            losses += sums[1] / sums[0] * sums[2:].sum()
            cells += sums[2:]
            state.step(gradient / sums[0] + weight_decay * state.matrix, learning_rate)
        after, _ = block_sums(val, state.matrix)
        record = {
            "epoch": state.epoch, "train_loss": round(float(losses / max(cells.sum(), 1)), 6),
            "val_loss": round(float(after[1] / after[0]), 6) if after[0] else 0.0,
            "train": _scores(cells, labels), "val": _scores(after[2:], labels),
        }
        state.history.append(record)
        if record["val"]["macro_f1"] > best[1]:
            best = (state.matrix, record["val"]["macro_f1"], state.epoch)
    report = {"best_epoch": best[2], "best_macro_f1": best[1], "labels": list(labels), "history": state.history}
    return best[0], state, report


def epoch_scores(rows: DataFrame, report: dict) -> DataFrame:
    """(epoch, split, samples, loss, accuracy, macro_f1, beats_majority) of the report of a fit on
    `rows`: every epoch on train and val. The loss is null where the fit recorded none. The flag tells whether more rows are right than the
    most frequent label of the train split (ties: the first label) would get right."""
    seen = []
    for h in report["history"]:
        for split in ("train", "val"):
            cells = h[split]["confusion_matrix"]["values"]
            right = sum(row[i] for i, row in enumerate(cells))
            seen.append((h["epoch"], split, h[split]["samples"], right, h.get(f"{split}_loss"), h[split]["accuracy"], h[split]["macro_f1"]))
    # one row per epoch and split
    scored = rows.sparkSession.createDataFrame(seen, "epoch int, split string, samples long, correct long, loss double, accuracy double, macro_f1 double")
    counted = rows.where(F.col("label").isin(report["labels"])).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    top = counted.where("split = 'train'").orderBy(F.desc("n"), "label").limit(1).select("label")
    common = counted.join(top, "label").select("split", F.col("n").alias("by_majority"))
    return scored.join(common, "split", "left").select(
        "epoch", "split", "samples", "loss", "accuracy", "macro_f1",
        (F.col("correct") > F.coalesce("by_majority", F.lit(0))).alias("beats_majority"),
    )


def weighted_loss(scored: DataFrame) -> DataFrame:
    """Mean negative log likelihood per epoch of (epoch, probability of the true class)."""
    return scored.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("samples"),
        ratio(F.sum(-F.log(F.col("probability"))), F.count(F.lit(1))).alias("loss"),
    )
