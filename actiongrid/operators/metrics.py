"""Classification quality from counts.

Everything starts from one partially aggregated count per (target, prediction),
so a hot class costs nothing: at most L*L rows leave each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..domain import ACTION_LABELS, COMPATIBLE_LABELS, DataError
from ..functions.labels import compatible
from ..functions.numbers import ratio
from ..plans.literal import domain_pairs, domain_table, label_at, ordinal_of


def encode(rows: DataFrame, target: str, prediction: str, labels: Sequence[str]) -> DataFrame:
    """Label columns to class indices (null outside of the domain)."""
    return rows.select(
        ordinal_of(target, labels).alias("target"), ordinal_of(prediction, labels).alias("prediction")
    )


def encode_compatible(rows: DataFrame, target: str, prediction: str) -> DataFrame:
    """Both sides remapped to what the external detector can express."""
    return rows.select(
        ordinal_of(compatible(target), COMPATIBLE_LABELS).alias("target"),
        ordinal_of(compatible(prediction), COMPATIBLE_LABELS).alias("prediction"),
    )


def out_of_domain(rows: DataFrame, size: int) -> DataFrame:
    """Rows whose class index is missing or outside of 0..size-1."""
    inside = F.col("target").between(0, size - 1) & F.col("prediction").between(0, size - 1)
    return rows.where(~F.coalesce(inside, F.lit(False)))


def confusion(rows: DataFrame, labels: Sequence[str], *, strict: bool = False) -> DataFrame:
    """Dense L x L counts: target, prediction, n. `strict` raises on foreign indices."""
    size = len(labels)
    if size == 0:
        raise ValueError("the label domain is empty")
    if strict and not out_of_domain(rows, size).isEmpty():
        raise DataError("class_index", "class index is outside of the label domain")
    counted = rows.groupBy("target", "prediction").agg(F.count(F.lit(1)).alias("n"))
    dense = domain_pairs(rows.sparkSession, size, "target", "prediction")
    return dense.join(counted, ["target", "prediction"], "left").select(
        "target", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def per_class_counts(matrix: DataFrame) -> DataFrame:
    """Per class: tp, support (true rows), predicted (rows given the class)."""
    hit = F.when(F.col("target") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = matrix.select(
        F.inline(F.array(
            F.struct(F.col("target").alias("class"), hit.alias("tp"),
                     F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"),
                     F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
        ))
    )
    return sides.groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
    )


def per_class(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Unrounded precision, recall and F1 per class; 0 where undefined."""
    p, r = F.col("precision"), F.col("recall")
    return (
        per_class_counts(matrix)
        .withColumn("label", label_at("class", labels))
        .withColumn("precision", ratio("tp", "predicted"))
        .withColumn("recall", ratio("tp", "support"))
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
        .select("class", "label", "tp", "support", "predicted", "precision", "recall", "f1")
    )


def summary(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: samples, correct, accuracy, macro_f1 (mean over all labels)."""
    return per_class(matrix, labels).agg(
        F.sum("support").alias("samples"),
        F.sum("tp").alias("correct"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        (F.sum("f1") / F.lit(float(len(labels)))).alias("macro_f1"),
    )


def metrics_document(matrix: DataFrame, labels: Sequence[str], *, digits: int = 6) -> dict:
    """The nested report form; reads L*L rows of the dense matrix."""
    classes = sorted(per_class(matrix, labels).collect(), key=lambda r: r["class"])
    cells = {(r.target, r.prediction): r.n for r in matrix.collect()}
    samples, correct = sum(r.support for r in classes), sum(r.tp for r in classes)
    size = range(len(labels))
    return {
        "accuracy": round(correct / samples, digits) if samples else 0.0,
        "macro_f1": round(sum(r.f1 for r in classes) / len(labels), digits),
        "per_class": {
            r.label: {"precision": round(r.precision, digits), "recall": round(r.recall, digits),
                      "f1": round(r.f1, digits), "support": r.support}
            for r in classes
        },
        "confusion_matrix": {
            "labels": list(labels), "values": [[cells[t, p] for p in size] for t in size]
        },
        "samples": samples,
    }


def top_errors(matrix: DataFrame, labels: Sequence[str], k: int = 3) -> DataFrame:
    """Largest off-diagonal cells; ties in label order."""
    return (
        matrix.where((F.col("target") != F.col("prediction")) & (F.col("n") > 0))
        .orderBy(F.desc("n"), "target", "prediction")
        .limit(k)
        .select(
            "target", "prediction", label_at("target", labels).alias("target_label"),
            label_at("prediction", labels).alias("predicted_label"), "n",
        )
    )


def class_weights(rows: DataFrame, labels: Sequence[str], *, label: str = "label") -> DataFrame:
    """Inverse-frequency weights N / (L * count), 0 for labels without rows. N counts all rows,
    those of other labels included."""
    counted = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row by construction
    return (
        domain_table(rows.sparkSession, labels)
        .join(counted.where(F.col("label").isin(*labels)), "label", "left")
        .join(F.broadcast(total), F.lit(True), "left")
        .select(
            "ordinal", "label", F.coalesce("n", F.lit(0)).alias("n"),
            F.when(F.col("n") > 0, F.col("total") / (F.lit(float(len(labels))) * F.col("n")))
            .otherwise(F.lit(0.0)).alias("weight"),
        )
    )


def epoch_losses(batches: DataFrame) -> DataFrame:
    """Sample-weighted loss per epoch of (epoch, loss, samples); 0 without samples."""
    return batches.groupBy("epoch").agg(
        F.sum("samples").alias("samples"),
        ratio(F.sum(F.col("loss") * F.col("samples")), F.sum("samples")).alias("loss"),
    )


def best_epoch(history: DataFrame, *, score: str = "macro_f1") -> DataFrame:
    """The earliest epoch with the largest score, as one aggregate."""
    best = F.max_by(
        F.struct("epoch", score), F.struct(F.col(score), (-F.col("epoch")).alias("earlier"))
    )
    return history.agg(best.alias("best")).select("best.*")


def correct_flag(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.withColumn("correct", F.col(expected) == F.col(predicted))


def compare_evaluations(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of two evaluations side by side with shared / removed / added."""
    a = old.select(*key, F.col("target").alias("old_target"), F.col("prediction").alias("old_prediction"),
                   F.lit(True).alias("in_old"))
    b = new.select(*key, F.col("target").alias("new_target"), F.col("prediction").alias("new_prediction"),
                   F.lit(True).alias("in_new"))
    return a.join(b, list(key), "full_outer").withColumn(
        "presence",
        F.when(F.col("in_old").isNotNull() & F.col("in_new").isNotNull(), "shared")
        .when(F.col("in_old").isNotNull(), "removed").otherwise("added"),
    )


def comparison_report(compared: DataFrame) -> DataFrame:
    """Counts and correct answers on both sides; deltas follow by subtraction."""
    old_hit = F.col("old_target") == F.col("old_prediction")
    new_hit = F.col("new_target") == F.col("new_prediction")
    return compared.agg(
        F.count_if(F.col("presence") == "shared").alias("shared"),
        F.count_if(F.col("presence") == "removed").alias("removed"),
        F.count_if(F.col("presence") == "added").alias("added"),
        F.count("in_old").alias("old_samples"),
        F.count("in_new").alias("new_samples"),
        F.count_if(old_hit).alias("old_correct"),
        F.count_if(new_hit).alias("new_correct"),
        F.count_if((F.col("presence") == "shared") & ~old_hit & new_hit).alias("fixed"),
        F.count_if((F.col("presence") == "shared") & old_hit & ~new_hit).alias("broken"),
    )


def score_deltas(old_matrix: DataFrame, new_matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Accuracy, macro F1 and per-class F1 of both evaluations and their differences."""
    def scores(matrix, side):
        classes = per_class(matrix, labels).select(
            F.concat(F.lit("f1/"), F.col("label")).alias("metric"), F.col("f1").alias("value")
        )
        whole = summary(matrix, labels).select(
            F.inline(F.array(
                F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
                F.struct(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value")),
                F.struct(F.lit("samples").alias("metric"), F.col("samples").cast("double").alias("value")),
            ))
        )
        return whole.unionByName(classes).withColumnRenamed("value", side)

    return scores(old_matrix, "old_value").join(scores(new_matrix, "new_value"), "metric").withColumn(
        "delta", F.col("new_value") - F.col("old_value")
    )


def evaluate(rows: DataFrame, *, target: str = "expected_action", prediction: str = "predicted_action") -> dict:
    """Strict and compatible matrices of label columns."""
    return {
        "strict": confusion(encode(rows, target, prediction, ACTION_LABELS), ACTION_LABELS),
        "compatible": confusion(encode_compatible(rows, target, prediction), COMPATIBLE_LABELS),
    }
