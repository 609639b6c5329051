"""Exact dedup through an extendible-hash index on shared files.

Texts are keyed by a 64-bit hash. The directory starts with one bucket; every bucket that holds
more than `bucket_bytes` splits on the next hash bit and the directory doubles where that needs
it, down to `max_depth` bits, where a bucket may run over. Each bucket is owned by one task: it
gets the texts of its key range, chains the different texts of one key and tells them apart by
their bytes. What the owners find is the index, written to the shared folder.

A text whose copies alone would fill a bucket is hot. Copies of hot texts are folded before
the shuffle, one row a task, and only ids and digests of its rows travel afterwards. At most
`HOT_SHARE` texts can be hot, because each holds over 1/HOT_SHARE of all bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import query, stored, table

HOT_SHARE = 100_000


def _keyed(docs: DataFrame, text_col: str, hash_bits: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_text", text)
    return rows.withColumn("_key", F.shiftleft(F.shiftrightunsigned(F.xxhash64("_text"), 64 - hash_bits), 64 - hash_bits))


def directory(keys: DataFrame, bucket_bytes: int, max_depth: int) -> DataFrame:
    """(slot, depth, bucket) of every slot in use, from keys(_key, load).

    A slot is the first `max_depth` bits of a key. Doubling stops for a slot at the first depth
    whose bucket holds at most `bucket_bytes`; this is what splitting one bucket after another
    ends in. Both tables have at most 2**(max_depth + 1) rows, whatever the input.
    """
    slot = F.shiftrightunsigned("_key", 64 - max_depth).cast("int")
    slots = keys.groupBy(slot.alias("slot")).agg(F.sum("load").alias("load"))
    levels = slots.select("slot", "load", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    held = levels.groupBy("depth", "prefix").agg(F.sum("load").alias("held"))
    fits = (F.col("held") <= bucket_bytes) | (F.col("depth") == max_depth)
    return (
        levels.join(F.broadcast(held.where(fits)), ["depth", "prefix"])
        .groupBy("slot").agg(F.min("depth").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(1, depth) + shiftright(slot, {max_depth} - depth)"))
    )


def _owners(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, max_depth: int, hash_bits: int):
    """(rows that owners judge, hot rows, whether there are hot rows)."""
    rows = _keyed(docs, text_col, hash_bits)
    keys = stored(
        rows.groupBy("_key").agg(F.sum(F.octet_length("_text") + 16).alias("load"), F.count(F.lit(1)).alias("rows")), "keys"
    )
    total = keys.agg(F.sum("load")).first()[0] or 0
    heavy = max(bucket_bytes, total // HOT_SHARE)
    hot = keys.where((F.col("load") > heavy) & (F.col("rows") > 1))
    book = stored(directory(keys.join(F.broadcast(hot.select("_key")), "_key", "left_anti"), bucket_bytes, max_depth), "directory")
    some = not hot.isEmpty()
    cold = rows
    if some:
        hot = F.broadcast(stored(hot.select("_key"), "hot"))
        cold, rows = rows.join(hot, "_key", "left_anti"), rows.join(hot, "_key", "left_semi")
    cold = cold.withColumn("_slot", F.shiftrightunsigned("_key", 64 - max_depth).cast("int"))
    book = book.select(F.col("slot").alias("_slot"), F.col("bucket").alias("_bucket"))
    owned = cold.join(F.broadcast(book), "_slot").repartition("_bucket")
    same = Window.partitionBy("_bucket", "_key", "_text")
    owned = owned.withColumn("_size", F.count(F.lit(1)).over(same)).withColumn(
        "_rank", F.row_number().over(same.orderBy(F.col(id_col).desc_nulls_last()))
    ).withColumn("_keep", F.first(id_col).over(same.orderBy(F.col(id_col).desc_nulls_last())))
    return owned, rows, some


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 1 << 20,
    max_depth: int = 16, hash_bits: int = 64,
) -> DataFrame:
    """One row per row of `docs`: id, bucket, chain, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and equal the empty text. Of equal texts the row with the largest
    id stays; null ids rank last; of rows that repeat the largest id exactly one stays. Other
    columns are left out, whatever their names. `hash_bits` shortens keys, so that tests meet
    collisions; `chain` counts the texts of a key in byte order (hot rows: in digest order).
    An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_in"))
    owned, hot, some = _owners(docs, "_id", "_in", bucket_bytes, max_depth, hash_bits)
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    chain = (F.dense_rank().over(Window.partitionBy("_bucket", "_key").orderBy("_text")) - 1).alias("chain")
    index = owned.select(
        F.col("_bucket").alias("bucket"), "_key", chain, "_id", F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"), (F.col("_rank") == 1).alias("kept"), digest.alias("text_sha256"),
    )
    if some:
        index = index.unionByName(_hot_index(hot, digest))
    return stored(index, "index").select(
        F.col("_id").alias(id_col), "bucket", "chain", "keep_id", "group_size", "kept", "text_sha256"
    )


def _hot_index(hot: DataFrame, digest) -> DataFrame:
    """Index rows of hot texts: classes are folded by their bytes, then found by (key, digest).

    Two texts of one class key differ in their digests; rows are matched to a class by digest.
    """
    classes = hot.groupBy("_key", "_text").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("_key", digest.alias("text_sha256"), "keep_id", "group_size")
    chain = F.row_number().over(Window.partitionBy("_key").orderBy("text_sha256")) - 1
    classes = stored(classes.withColumn("chain", chain), "hot-classes")
    rows = hot.select("_key", "_id", digest.alias("text_sha256")).join(classes, ["_key", "text_sha256"])
    first = Window.partitionBy("_key", "text_sha256").orderBy("_id")
    best = F.col("_id").eqNullSafe(F.col("keep_id"))
    winners = rows.where(best).withColumn("kept", F.row_number().over(first) == 1)
    return winners.unionByName(rows.where(~best).withColumn("kept", F.lit(False))).withColumn("bucket", F.lit(0))


def unique_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 1 << 20,
    max_depth: int = 16, hash_bits: int = 64,
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; whole rows travel to the owners."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    owned, hot, some = _owners(inner, key, text, bucket_bytes, max_depth, hash_bits)
    kept = owned.where("_rank = 1").select(*names)
    if some:
        best = F.max_by(F.struct(*names), F.struct(key))
        kept = kept.unionByName(hot.groupBy("_key", "_text").agg(best.alias("best")).select("best.*"))
    return kept.toDF(*docs.columns)


@query("op9_exact_dedup", """
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
           row_number() OVER w = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
""")
def op9_exact_dedup(spark, sf_dir):
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
