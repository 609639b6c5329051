"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector is turned by a fixed random rotation into `bits` dimensions and kept as the signs
of its coordinates, packed, with two scalars: the vector's length and the correction, the inner
product of the vector with its own code. For a query, rotated alike and rounded to four-bit
coordinates, adding these up where a code has its bits gives its inner product with a code; divided by the
correction it estimates that with the vector, with an error of about
sqrt(1/correction^2 - 1) / sqrt(bits - 1). The bound, `width` times that plus what rounding the
query adds, says which vectors could be among the nearest: all whose upper bound reaches the
k-th best lower bound are compared exactly, on the original vectors in double precision.

Every row is in the index. Index and queries are cut into blocks of bounded size; each block of
queries meets each block of the index once, and only the k best of a block go on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import query, stored, table

PLANES = 4
#: Queries compared with a block at once.
TOGETHER = 64


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """`dim` orthonormal rows of length `bits`."""
    turned, upper = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (turned * np.sign(np.diag(upper)))[:dim]


def width_of(dim: int) -> int:
    """Bits of a code: at least twice the dimensions, in whole words of 64."""
    return 64 * max(2, -(-2 * dim // 64))


def encode(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, lengths, corrections) of the rows."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / lengths[:, None]) @ rotation(vectors.shape[1], bits)
    codes = np.packbits(turned > 0, axis=1).view(np.uint64)
    return codes, lengths, np.abs(turned).sum(axis=1) / np.sqrt(bits)


def estimate(queries: np.ndarray, codes: np.ndarray, lengths: np.ndarray, corrections: np.ndarray, bits: int, width: float):
    """(estimated inner products, their error bounds) of all queries with all codes."""
    norms = np.sqrt((queries * queries).sum(axis=1))
    turned = (queries / norms[:, None]) @ rotation(queries.shape[1], bits)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-12)
    rounded = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    # all four planes at once: sums of small whole numbers, exact in single precision
    bits_set = np.unpackbits(codes.view(np.uint8), axis=1)
    total = rounded.astype(np.float32) @ bits_set.T.astype(np.float32)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    whole = low * bits + step * rounded.sum(axis=1, dtype=np.int64)
    inner = (2 * (low[:, None] * ones[None, :] + step[:, None] * total) - whole[:, None]) / np.sqrt(bits)
    scale = norms[:, None] * lengths[None, :]
    spread = np.sqrt(np.maximum(1 / corrections**2 - 1, 0)) / np.sqrt(bits - 1)
    error = width * (spread[None, :] + step[:, None] / np.sqrt(12) / corrections[None, :])
    return inner / corrections[None, :] * scale, error * scale


def sums(queries: np.ndarray, vectors: np.ndarray, who: np.ndarray, what: np.ndarray) -> np.ndarray:
    """Inner products of queries[who] with vectors[what], component by component."""
    score = np.empty(len(who))
    for i in range(0, len(who), 1 << 16):
        s = slice(i, i + (1 << 16))
        score[s] = (queries[who[s]] * vectors[what[s]]).sum(axis=1)
    return score


def nearest(query_ids, queries, ids, vectors, codes, lengths, corrections, k: int, width: float) -> pd.DataFrame:
    """The k best of a block for every query: (query_id, vec_id, score)."""
    out = []
    bits = codes.shape[1] * 64
    for start in range(0, len(queries), TOGETHER):
        part, names = queries[start:start + TOGETHER], query_ids[start:start + TOGETHER]
        guess, error = estimate(part, codes, lengths, corrections, bits, width)
        other = names[:, None] != ids[None, :]
        lower = np.where(other, guess - error, -np.inf)
        at = max(len(ids) - k - 1, 0)  # one place more, for the query itself
        bar = np.partition(lower, at, axis=1)[:, at]
        close = other & (guess + error >= bar[:, None])
        # many pairs pass on scattered vectors: their products come first all at once, and the final
        # sums, component by component, only for those that rounding may put among the k best
        product = np.where(close, part @ vectors.T, -np.inf)
        at = max(len(ids) - k, 0)
        floor = np.partition(product, at, axis=1)[:, at] - 1e-11 * np.sqrt((part * part).sum(axis=1)) * lengths.max()
        who, what = np.nonzero(close & ~(product < floor[:, None]))
        score = sums(part, vectors, who, what)
        order = np.lexsort((ids[what], -score, who))
        who, what, score = who[order], what[order], score[order]
        first = np.searchsorted(who, np.arange(len(part)))
        keep = np.arange(len(who)) - first[who] < k
        out.append(pd.DataFrame({"query_id": names[who[keep]], "vec_id": ids[what[keep]], "score": score[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>, dim) of the rows that take part: not null, not zero, all
    components finite."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and vector is not null").where(~bad).where(F.exists("vector", lambda x: x != 0))
    return rows.withColumn("dim", F.size("vector"))


def _blocks(rows: DataFrame, block_rows: int, with_codes: bool) -> tuple[DataFrame, int]:
    """(rows in blocks as packed binaries, number of blocks). Rows are dealt out evenly; those of
    one block and different lengths are packed apart."""
    number = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(number)).cast("int"))
    schema = "block int, dim int, ids binary, vectors binary" + (", codes binary, lengths binary, corrections binary" if with_codes else "")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy())
        out = {"block": rows["block"].iloc[:1], "dim": vectors.shape[1], "ids": ids.tobytes(), "vectors": vectors.tobytes()}
        if with_codes:
            codes, lengths, corrections = encode(vectors, width_of(vectors.shape[1]))
            out |= {"codes": codes.tobytes(), "lengths": lengths.tobytes(), "corrections": corrections.tobytes()}
        return pd.DataFrame(out)

    return dealt.groupBy("dim", "block").applyInPandas(pack, schema), number


def search(
    rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    width: float = 2.5, block_rows: int = 8192, query_rows: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with every query.

    A row is never its own neighbour (rows of the query's id are left out). Nearest first, ties
    to the smaller id; repeated rows are found once each. A query meets the vectors of its own
    length, for which alone there is an inner product. Queries and rows that cannot take part give
    nothing; so do empty tables. Blocks have `block_rows` rows, whatever the size of the table.
    """
    index, blocks = _blocks(usable(rows, id_col, vector_col), block_rows, True)
    index = stored(index, "codes")
    asked, _ = _blocks(usable(queries, id_col, vector_col), query_rows, False)
    asked = asked.select("dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = index.join(asked, ["dim", "block"])

    def compare(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                of = lambda raw, kind=np.float64: np.frombuffer(raw, kind)
                ids, dim = of(row.ids, np.int64), row.dim
                yield nearest(
                    of(row.query_ids, np.int64), of(row.queries).reshape(-1, dim), ids, of(row.vectors).reshape(-1, dim),
                    of(row.codes, np.uint64).reshape(len(ids), -1), of(row.lengths), of(row.corrections), k, width,
                )

    best = pairs.repartition("query_ids", "block").mapInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op4_one_bit_codes")
def op4_one_bit_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))
