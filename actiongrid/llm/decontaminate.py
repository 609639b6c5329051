"""Benchmark decontamination by winnowing.

Items (test texts) are cut into windows of `window` words; an item of fewer words is one window.
Of the k-grams inside a window the one with the smallest hash is its fingerprint, so equal
windows have equal fingerprints: with k = `gram` and windows of `window - gram + 1` k-grams every
shared span of `window` words or more is found, wherever it lies. Windows shorter than that keep
the guarantee with their own length (k shrinks to the length where it must).

1. The fingerprints of the items are put into a bounded bit table (`grams.bit_table`).
2. One pass over the documents slides the same windows. Where the fingerprint of a window may be
   an item's, the hit is extended to the words of all windows that chose it; the other windows
   are never written anywhere.
3. These windows are joined with the distinct windows of the items by their words. The item side
   has one row a window, so a passage that many documents and many items share makes no pairs.
4. Windows that touch are folded into spans, document by document. Which items a document met is
   kept as a set of sets: each window stands for the set of items that have it, and a combination
   of such sets is turned into a list of items once, however many documents share it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import arrow_runs
from .common import query, stored, table
from .grams import WordHashes, bit_table, gram_hashes, lowest, may_hold, mixed

#: Windows of one document that travel in one row.
CHUNK = 4096

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words of ASCII letters, digits and all that is not ASCII; A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def fingerprints(codes: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The fingerprint of the `size` words from every place on, given the hashes of all words."""
    k = min(gram, size)
    smallest = lowest(gram_hashes(codes, k), size - k + 1) if len(codes) >= size else np.zeros(0, np.uint64)
    return mixed(smallest + np.uint64(size))


def item_windows(items: DataFrame, window: int = 10, gram: int = 5, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, fp, window) of all windows of the items; `item` is the id as text (null: empty)."""

    def run(batches):
        hashes = WordHashes()
        for rows, run_texts in arrow_runs(batches):
            owner, size, code, found = [], [], [], []
            for number, text in enumerate(run_texts):
                words = words_of(text)
                if not words:
                    continue
                n = min(window, len(words))
                code.append(fingerprints(hashes.of(words), n, gram))
                found += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
                owner += [number] * len(code[-1])
                size += [n] * len(code[-1])
            fp = np.concatenate(code).view(np.int64) if code else np.zeros(0, np.int64)
            columns = [rows.column(0).take(pa.array(owner, pa.int64())), pa.array(size, pa.int32()), pa.array(fp), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "size", "fp", "window"])

    rows = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, "item string, size int, fp long, window binary")


def candidates(docs: DataFrame, sizes: list[int], bits: np.ndarray, gram: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, starts, sizes, windows): windows whose fingerprint may be an item's.

    Each document has one row that carries n_words, and further rows of at most CHUNK windows
    where it has more. `row` numbers the rows of `docs`; it means something once this is stored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        hashes, sieve = WordHashes(), shared.value
        for rows, run_texts in arrow_runs(batches):
            lists = [words_of(t) for t in run_texts]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            words = [w for one in lists for w in one]
            ends = np.cumsum(counts)
            codes = hashes.of(words)
            left = np.repeat(ends, counts) - np.arange(len(words))
            place, length = [], []
            for size in sizes:
                fp = fingerprints(codes, size, gram)
                hit = np.flatnonzero(may_hold(sieve, fp) & (left[:len(fp)] >= size))
                place.append(hit)
                length.append(np.full(len(hit), size))
            place, length = np.concatenate(place), np.concatenate(length)
            order = np.argsort(place, kind="stable")
            place, length = place[order], length[order]
            firsts = ends - counts
            cuts = np.searchsorted(place, np.append(firsts, ends[-1]))
            owner, n_words, offsets, starts = [], [], [0], np.empty(len(place), np.int64)
            for number, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                starts[a:b] = place[a:b] - firsts[number]
                for low in range(a, max(b, a + 1), CHUNK):
                    owner.append(number)
                    n_words.append(int(counts[number]) if low == a else None)
                    offsets.append(min(low + CHUNK, b))
            found = [b" ".join(words[i:i + n]) for i, n in zip(place.tolist(), length.tolist())]
            at = pa.array(offsets, pa.int32())
            of = lambda values: pa.ListArray.from_arrays(at, values)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(owner)), rows.column(1).take(pa.array(owner)), pa.array(n_words, pa.int64()),
                 of(pa.array(starts)), of(pa.array(length.astype(np.int64))), of(pa.array(found, pa.binary()))],
                ["row", "doc_id", "n_words", "starts", "sizes", "windows"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    schema = T.StructType(rows.schema.fields[:2]).add("n_words", T.LongType())
    for name, kind in (("starts", T.LongType()), ("sizes", T.LongType()), ("windows", T.BinaryType())):
        schema = schema.add(name, T.ArrayType(kind))
    return rows.mapInArrow(run, schema)


@dataclass
class Contamination:
    """documents: (doc_id, n_words, n_hit, spans, met), one row for each row of the input.

    spans are (start, end) word ranges inside item windows, in order, none touching the next.
    met names a combination of items, null if there is none; items: (met, item), one row an item.
    """

    documents: DataFrame
    items: DataFrame


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> Contamination:
    """Words of `docs` that lie inside a window of an item, and the items met.

    Null and empty texts have no words. Repeated rows of `docs` each keep their row, null ids stay
    null; items of equal id count once, a null item id counts as the empty text. A text may be of
    any length. Other columns are left out, whatever their names. Without items nothing is hit.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram lies between 1 and window")
    made = stored(item_windows(items, window, gram, item_id, item_text), "item-windows")
    sizes = sorted(r[0] for r in made.select("size").distinct().collect())  # at most `window` numbers
    sieve = bit_table(made.select("fp").distinct(), "fp")
    seen = stored(candidates(docs, sizes or [window], sieve, gram, id_col, text_col), "candidates")

    held = made.select("window", "item").distinct()
    mark = lambda seed: F.expr(f"bit_xor(xxhash64(item, {seed}))")
    sets = stored(held.groupBy("window").agg(F.struct(F.count(F.lit(1)).alias("n"), mark(1).alias("x"), mark(2).alias("y")).alias("set")), "item-sets")
    hits = seen.where(F.size("starts") > 0).select("row", F.explode(F.arrays_zip("starts", "sizes", "windows")).alias("h"))
    hits = hits.select("row", F.col("h.starts").alias("start"), (F.col("h.starts") + F.col("h.sizes")).alias("end"), F.col("h.windows").alias("window"))
    hits = hits.join(sets, "window")

    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached >= F.col("start"), 0).otherwise(1)
    runs = hits.select("row", "start", "end", "set", fresh.alias("fresh"))
    runs = runs.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("set").alias("sets"))
    spans = F.sort_array(F.collect_list(F.struct("start", "end")))
    rows = runs.groupBy("row").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), spans.alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"),
    )
    rows = stored(rows.withColumn("met", F.sha2(F.to_json("sets"), 256)), "spans")

    combinations = rows.groupBy("met").agg(F.any_value("sets").alias("sets")).select("met", F.explode("sets").alias("set"))
    named = sets.groupBy("set").agg(F.min("window").alias("window")).join(held, "window").select("set", "item")
    met = combinations.join(named, "set").select("met", "item").distinct()
    documents = seen.where("n_words IS NOT NULL").select("row", "doc_id", "n_words").join(rows.drop("sets"), "row", "left")
    return Contamination(
        documents.select(
            F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("spans", F.array().cast(rows.schema["spans"].dataType)).alias("spans"), "met",
        ),
        met,
    )


@query("op11_winnowing_decontamination", """
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM documents),
    i AS (
        SELECT coalesce(item_id::VARCHAR, '') AS item,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM benchmark),
    iw AS (
        SELECT DISTINCT item, size, array_to_string(w[s : s + size - 1], ' ') AS win
        FROM (SELECT item, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
              FROM (SELECT item, w, least(len(w), 10) AS size FROM i WHERE len(w) > 0))),
    dw AS (
        SELECT r, s, size, array_to_string(w[s : s + size - 1], ' ') AS win
        FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
              FROM d CROSS JOIN (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
    h AS (SELECT r, s, dw.size, item FROM dw JOIN iw USING (win) WHERE dw.size = iw.size),
    n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(s, s + size - 1)) AS p FROM h) GROUP BY r),
    m AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
""")
def op11_winnowing_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sort_array(F.collect_list("item"))
    digests = found.items.groupBy("met").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256")
    )
    return found.documents.join(digests, "met", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
