"""Language ID by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to `order` bytes deep with the counts of what
followed. In a context seen n times with q different followers, a follower seen c times has
probability c / (n + q); the escape to the next shorter context has q / (n + q). Contexts that a
language has not seen cost nothing and pass on to the shorter one; below the empty context all
symbols are equally likely. The counts are frozen after training, so the code length of a text is
the exact sum of the code lengths of its bytes, and each depends only on the last `order` bytes.

A model is fitted on a bounded sample of labelled rows (`per_language` whole texts a language,
those with the smallest hash of their id), counted on the executors. What the driver holds is
the counts of that sample, a few megabytes. Texts are scored where they lie, in one pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, query, table

UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def lettered(text):
    """has_letter of a text column; false for null."""

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(has_letter).astype(bool)

    return of(text)


def _bytes(text: str) -> np.ndarray:
    """The lowered text's bytes; runs of ASCII white space count as one blank."""
    return np.frombuffer(b" ".join(text.lower().encode("utf-8", "surrogatepass").split()), np.uint8)


def _counts(order: int):
    """Followers of every context of 0 to `order` bytes, counted per batch of texts."""

    def run(batches):
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for depth in range(order + 1):
                    codes = []
                    for text in rows["text"]:
                        data = np.concatenate([np.full(order, 32, np.uint8), _bytes(text)]).astype(np.int64)
                        code = np.zeros(len(data) - order, np.int64)
                        for back in range(depth, -1, -1):
                            code = code << 8 | data[order - back:len(data) - back]
                        codes.append(code)
                    value, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "depth": depth, "code": value, "n": n})

    return run


class Model:
    """Code lengths in bits: a row per context, a column per symbol, a plane per language."""

    def __init__(self, counts: pd.DataFrame, order: int):
        self.order = order
        self.langs = sorted(counts["lang"].unique())
        seen = np.unique(counts.loc[counts["depth"] == 0, "code"].to_numpy())
        #: Symbol of each byte; bytes never trained on share symbol 0.
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = width = len(seen) + 1
        size = len(self.langs)
        # the longest contexts of any language get a row; others use the row of a shorter one
        lower = np.full((1, size, width), 1.0 / 256, np.float32)
        rows_of = [np.zeros(1, np.int64)]
        for depth in range(order + 1):
            part = counts[counts["depth"] == depth]
            symbols = self._symbols(part["code"].to_numpy(), depth + 1)
            context = np.zeros(len(part), np.int64)
            for i in range(depth):
                context = context * width + symbols[i]
            known, where = np.unique(context, return_inverse=True)
            shorter = known % width ** (depth - 1) if depth else known
            table_ = lower[rows_of[-1][shorter]].copy() if depth else np.repeat(lower, len(known), axis=0)
            lang = np.searchsorted(self.langs, part["lang"].to_numpy())
            total, kinds = np.zeros((2, len(known), size), np.float32)
            np.add.at(total, (where, lang), part["n"].to_numpy())
            np.add.at(kinds, (where, lang), 1)
            mass = np.maximum(total + kinds, 1)
            table_ *= np.where(total > 0, kinds / mass, 1)[:, :, None]
            table_[where, lang, symbols[depth]] = part["n"].to_numpy() / mass[where, lang]
            rows = np.full(width ** depth, -1, np.int64)
            rows[known] = np.arange(len(known))
            if depth:  # contexts not seen point at the shorter context, kept behind the new rows
                alone = np.flatnonzero(rows < 0)
                rows[alone] = len(known) + rows_of[-1][alone % width ** (depth - 1)]
                table_ = np.concatenate([table_, lower])
            lower, rows_of = table_, [rows]
        self.rows = rows_of[-1].astype(np.int32)
        self.bits = np.ascontiguousarray((-np.log2(lower)).transpose(0, 2, 1).reshape(-1, size).astype(np.float32))

    def _symbols(self, code: np.ndarray, n: int) -> list[np.ndarray]:
        return [self.symbol[code >> 8 * (n - 1 - i) & 255] for i in range(n)]

    def lengths(self, batch: list[str], together: int = 1 << 20) -> np.ndarray:
        """Code length of every text in every language, in bits; long texts go in parts."""
        out = np.zeros((len(batch), len(self.langs)))
        order, run, held = self.order, [], 0
        for i, text in enumerate(batch):
            data = np.concatenate([np.full(order, 32, np.uint8), _bytes(text)])
            for start in range(order, len(data), together):
                part = data[start - order:start + together]
                if held + len(part) > together + order and run:
                    self._add(out, run)
                    run, held = [], 0
                run.append((i, part))
                held += len(part)
        if run:
            self._add(out, run)
        return out

    def _add(self, out: np.ndarray, run: list[tuple[int, np.ndarray]]) -> None:
        order = self.order
        data = self.symbol[np.concatenate([part for _, part in run])]
        context = np.zeros(len(data) - order, np.int64)
        for back in range(order, 0, -1):
            context = context * self.width + data[order - back:len(data) - back]
        bits = self.bits[self.rows[context].astype(np.int64) * self.width + data[order:]]
        at = 0
        for i, part in run:
            out[i] += bits[at:at + len(part) - order].sum(axis=0, dtype=np.float64)
            at += len(part)


def fit(labelled: DataFrame, per_language: int = 1000, order: int = 3, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model | None:
    """A model of the languages of `labelled`; None if no row has both a language and a text.

    Rows with a null language or text teach nothing. `per_language` bounds the sample; texts
    are taken whole. Memory: about 4 * contexts * symbols bytes a language.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    counts = (
        bounded_sample(rows, "lang", per_language, "doc_id").select("lang", "text").repartition(F.xxhash64("text")).mapInPandas(_counts(order), "lang string, depth int, code long, n long")
        .groupBy("lang", "depth", "code").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = counts[counts["n"] > 0]
    return Model(counts, order) if len(counts) else None


def judge(spark: SparkSession, model: Model | None):
    """A function of a text column: struct of lang_pred and score, from the text alone.

    Null texts and texts without a letter are `und` with score 0, as is everything without a
    model. score is the share of the best language when every language weighs 2 to the minus
    its code length; ties go to the first language in order.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    @F.pandas_udf("lang_pred string, score double")
    def of(text: pd.Series) -> pd.DataFrame:
        book = shared.value
        pred, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        told = [i for i, t in enumerate(text) if book is not None and has_letter(t)]
        if told:
            bits = book.lengths([text.iloc[i] for i in told])
            best = bits.argmin(axis=1)
            weight = np.exp2(bits.min(axis=1, keepdims=True) - bits)
            pred[told] = np.array(book.langs, object)[best]
            score[told] = 1 / weight.sum(axis=1)
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return of


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; repeated rows repeat, other columns are left out."""
    found = docs.select(F.col(id_col).alias("id"), judge(docs.sparkSession, model)(F.col(text_col)).alias("j"))
    return found.select(F.col("id").alias(id_col), "j.lang_pred", "j.score")


@query("op8_ppm_language_id")
def op8_ppm_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = fit(docs.where(~out))
    found = classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
