"""The corpus pipeline: each stage takes what the one before kept and decides on all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiongrid.llm.common import stored, table
from actiongrid.llm.exact_dedup import unique_rows
from actiongrid.llm.language import UNKNOWN, fit, judge, lettered
from actiongrid.llm.packing import packed_digests
from actiongrid.llm.simhash import representatives
from actiongrid.llm.substring_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects: null texts and texts without a letter.
    Without labels there is no model, and the same rule is applied without one."""
    model = fit(docs)
    if model is None:
        return docs.where(lettered(docs["text"]))
    return docs.where(judge(spark, model)(docs["text"])["lang_pred"] != UNKNOWN)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return unique_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays."""
    return representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts. Documents without any keep theirs as it is.

    Columns travel under numbers, so that none clashes with what the operator adds.
    """
    numbers = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    inner = docs.toDF(*numbers.values())
    found = without_repeats(inner, id_col=numbers["doc_id"], text_col=numbers["text"])
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col(numbers["text"]))}
    if "n_chars" in numbers:
        new["n_chars"] = F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(numbers["n_chars"]))
    return found.select(*[new.get(name, F.col(c)).alias(name) for name, c in numbers.items()])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the texts in sequences of 2048 tokens."""
    return packed_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
