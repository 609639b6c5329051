"""Packing pieces into windows by minimum bin slack.

A document's ids are cut every `capacity` ids; what is left over is a piece of 1 to capacity - 1
ids. Pieces of one length are alike for the packing, so all it needs is how many there are of
each length: a table of at most `capacity` rows, whatever the input. From it a plan is made. The
longest piece left opens a window; bitset dynamic programming over the other lengths, each with
its count, gives every sum that can be reached, the largest one that fits is taken, and walking
the bitsets back gives the lengths and counts that make it up. The same multiset fills as many
windows as the counts allow. Spark then ranks the pieces of each length and hands them out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import arrow_runs, codec, vocabulary_path
from .common import query, stored, table, texts

#: Ranks within a length are counted in so many parts.
PARTS = 64


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Copies of each length whose sum comes closest to `room` from below."""
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        steps.append((length, reach))
        left, size = min(counts[length], room // length), 1
        while left and not reach & goal:
            size = min(size, left)
            reach |= (reach << (length * size)) & mask
            left -= size
            size *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    taken = {}
    for length, before in reversed(steps):
        while not before >> total & 1:
            taken[length] = taken.get(length, 0) + 1
            total -= length
    return taken


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(copies of each length in a window, number of such windows), one after the other."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths lie between 1 and the capacity")
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        window = fill(left, capacity - longest)
        left[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(left[n] // c for n, c in window.items())
        out.append((window, times))
        for n, c in window.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return out


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """`pieces` with sequence_id and offset; pieces has a column `length` from 1 to capacity.

    Every row gets one place; places of a sequence follow each other without gaps from 0.
    `order` names columns that tell rows apart; rows alike in them and in length are
    exchangeable. An empty table gives no rows; rows of null length are refused.
    """
    spark = pieces.sparkSession
    names = [f"c{i}" for i in range(len(pieces.columns))]
    keys = [names[pieces.columns.index(c)] for c in order]
    rows = pieces.toDF(*names).withColumn("_length", F.col(names[pieces.columns.index("length")]).cast("int"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
    parts = stored(rows.groupBy("_length", "_part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {n: c for n, c in parts.groupBy("_length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    ranges, first = [], 0
    used: dict[int, int] = {}
    for window, times in plan(counts, capacity):
        at = 0
        for length, copies in sorted(window.items(), reverse=True):
            start = used.get(length, 0)
            used[length] = start + copies * times
            ranges.append((length, start, used[length], first, copies, at))
            at += length * copies
        first += times
    schema = "_length int, _from long, _to long, _first long, _copies long, _at long"
    places = spark.createDataFrame(ranges, schema)
    before = F.sum("n").over(Window.partitionBy("_length").orderBy("_part")) - F.col("n")
    parts = parts.select("_length", "_part", before.alias("_before"))  # at most capacity * PARTS rows
    within = Window.partitionBy("_length", "_part").orderBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(within)).join(F.broadcast(parts), ["_length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    placed = ranked.join(F.broadcast(places), "_length").where("_rank >= _from AND _rank < _to")
    turn = F.col("_rank") - F.col("_from")
    return placed.select(
        *names,
        (F.col("_first") + F.floor(turn / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_at") + turn % F.col("_copies") * F.col("_length")).cast("long").alias("offset"),
    ).toDF(*pieces.columns, "sequence_id", "offset")


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): each document's ids and `end_id`, cut every `capacity`.

    ids are little-endian unsigned 32-bit numbers. Null and empty texts are the end alone.
    """

    def run(batches):
        book = codec(vocabulary)
        for rows, run_texts in arrow_runs(batches):
            ids, at = book.encode(run_texts)
            sizes = np.diff(at) + 1
            whole = np.insert(ids, at[1:], end_id).astype("<u4")
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            first = (np.cumsum(sizes) - sizes)[owner] + start
            raw = [whole[a:a + n].tobytes() for a, n in zip(first.tolist(), length.tolist())]
            columns = [rows.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(raw, pa.binary()), pa.array(sizes[owner])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens"])

    rows = texts(docs, id_col, text_col)
    schema = T.StructType([rows.schema["doc_id"]])
    for name, kind in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces that carry their ids.

    Sequences are padded to `capacity`, except those whose length is a power of two.
    """
    held = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p")  # at most `capacity` pieces
    )
    joined = F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda all_, x: all_ + x["length"])
    pad = F.lit(int(pad_id).to_bytes(4, "little").hex())
    missing = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(capacity - F.col("n_tokens")).cast("int")
    return held.select("sequence_id", n.alias("n_tokens"), joined.alias("ids")).withColumn(
        "ids", F.concat("ids", F.unhex(F.repeat(pad, missing)))
    )


def packed_digests(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048) -> DataFrame:
    """Pieces of `docs` with their places; of the ids only the checksum is kept."""
    pieces = token_pieces(docs, vocabulary or vocabulary_path(), capacity)
    narrow = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(stored(narrow, "pieces"), capacity, ("doc_id", "start", "ids_crc32"))


@query("op7_pack_minimum_bin_slack")
def op7_pack_minimum_bin_slack(spark, sf_dir):
    return packed_digests(table(spark, sf_dir, "documents"))
