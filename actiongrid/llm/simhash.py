"""SimHash near-duplicates: a self-join over binary tries of 64-bit fingerprints.

Pairs of trie nodes are walked together. A pair carries the number of bits in which its two
prefixes differ and is left as soon as that exceeds the error budget; a pair whose remaining
bits cannot exceed it is linked whole. To share the walk out, the 64 bits are cut into `blocks`
runs. Two fingerprints that differ in at most `radius` bits agree in at least `blocks - radius`
runs, so one trie is kept for every choice of so many runs, with these bits on top. In that trie
the budget of the top levels is zero: only a node and itself are walked, and these nodes are the
units that Spark deals out. Larger corpora want more blocks: tops get longer, tries more.

A top node with more than `node_rows` fingerprints is walked further by joins of node tables,
`STEP` levels at a time, until every pair left is small; no group is ever one task's whole load.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, query, stored, table, texts

STEP = 6
CHUNK = 1 << 16


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash of one text as a signed 64-bit number (words by ASCII white space, A-Z lowered)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start:start + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty and has fingerprint 0."""

    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in text], dtype="int64")

    return texts(docs, id_col, text_col).select("doc_id", of("text").alias("fp"))


def _runs(blocks: int) -> list[tuple[int, int]]:
    """(first bit from the top, length) of each run."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def tries(radius: int, blocks: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(runs in trie order, bits of the top) of every trie."""
    runs = _runs(blocks)
    out = []
    for top in combinations(range(blocks), blocks - radius):
        rest = [i for i in range(blocks) if i not in top]
        out.append(([runs[i] for i in (*top, *rest)], sum(runs[i][1] for i in top)))
    return out


def _codes(points: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(trie, top, code, fp): every fingerprint with its bits in the order of every trie."""
    structs = []
    for number, (order, top) in enumerate(tries(radius, blocks)):
        code, at = F.lit(0).cast("long"), 0
        for start, length in order:
            run = F.shiftrightunsigned(F.shiftleft("fp", start), 64 - length)
            code = code.bitwiseOR(F.shiftleft(run, 64 - at - length))
            at += length
        structs.append(F.struct(F.lit(number).alias("trie"), F.lit(top).alias("top"), code.alias("code")))
    return points.select("fp", F.explode(F.array(*structs)).alias("s")).select("s.*", "fp")


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; the label of a class is its smallest index."""
    while len(a):
        la, lb = label[a], label[b]
        live = la != lb
        if not live.any():
            break
        a, b, la, lb = a[live], b[live], la[live], lb[live]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def walk(codes: np.ndarray, roots: tuple[np.ndarray, ...], radius: int) -> np.ndarray:
    """Smallest index linked with each of the sorted unsigned `codes`.

    roots: ranges (lo_a, hi_a, lo_b, hi_b) of node pairs, the depth of both nodes and the bits
    in which their prefixes differ. Pairs wait on a stack in chunks, so memory stays bounded.
    """
    label = np.arange(len(codes))
    n = len(roots[0])
    stack = [tuple(r[i:i + CHUNK] for r in roots) for i in range(0, n, CHUNK)]
    while stack:
        la, ha, lb, hb, depth, diff = stack.pop()
        own = la == lb
        na, nb = ha - la, hb - lb
        whole = diff + 64 - depth <= radius
        if whole.any():
            for a0, a1, b0, b1 in zip(la[whole], ha[whole], lb[whole], hb[whole]):
                span = np.concatenate([np.arange(a0, a1), np.arange(b0, b1)])
                label = _union(label, np.full(len(span), a0), span)
        small = ~whole & (na * nb <= 64)
        if small.any():
            a0, b0, wa, wb = la[small], lb[small], na[small], nb[small]
            count = wa * wb
            pair = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            i, j = a0[pair] + step // wb[pair], b0[pair] + step % wb[pair]
            near = (np.bitwise_count(codes[i] ^ codes[j]) <= radius) & (i != j)
            label = _union(label, i[near], j[near])
        rest = ~whole & ~small
        if not rest.any():
            continue
        la, ha, lb, hb, depth, diff, own = (x[rest] for x in (la, ha, lb, hb, depth, diff, own))
        bit = (np.uint64(1) << (63 - depth).astype(np.uint64)).astype(np.uint64)
        ma = np.searchsorted(codes, (codes[la] & ~(bit | (bit - np.uint64(1)))) | bit)
        mb = np.searchsorted(codes, (codes[lb] & ~(bit | (bit - np.uint64(1)))) | bit)
        ma, mb = np.clip(ma, la, ha), np.clip(mb, lb, hb)
        kids = [np.concatenate(x) for x in zip(
            (la, ma, lb, mb, diff), (ma, ha, mb, hb, diff), (la, ma, mb, hb, diff + 1),
            *([tuple(x[~own] for x in (ma, ha, lb, mb, diff + 1))]),
        )]
        deeper = np.concatenate([depth, depth, depth, depth[~own]]) + 1
        keep = (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= radius)
        keep &= ~((kids[0] == kids[2]) & (kids[1] - kids[0] == 1))
        a0, a1, b0, b1, diff = (x[keep] for x in kids)
        deeper = deeper[keep]
        for i in range(0, len(a0), CHUNK):
            s = slice(i, i + CHUNK)
            stack.append((a0[s], a1[s], b0[s], b1[s], deeper[s], diff[s]))
    return label


def _joined(radius: int, together: bool):
    """Walks the node pairs of a partition; gives each linked fingerprint with one it reaches.

    together: every task is a top node against itself, and all of a trie are walked at once.
    """

    def run(batches):
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        for _, one in rows.groupby("trie" if together else ["trie", "task"], sort=True):
            codes = one["code"].to_numpy().view(np.uint64)
            order = np.argsort(codes, kind="stable")
            codes, fp = codes[order], one["fp"].to_numpy()[order]
            depth, diff = int(one["depth"].iloc[0]), int(one["diff"].iloc[0])
            if together:
                lead = codes >> np.uint64(64 - depth)
                lo = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
                hi = np.r_[lo[1:], len(lead)]
                roots = (lo, hi, lo, hi)
            else:
                side = one["side"].to_numpy()[order]
                n, cut = len(side), int((side == side[0]).sum())
                roots = tuple(np.array([x]) for x in ((0, n, 0, n) if cut == n else (0, cut, cut, n)))
            fill = np.ones(len(roots[0]), np.int64)
            label = walk(codes, (*roots, fill * depth, fill * diff), radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield pd.DataFrame({"a": fp[label[moved]], "b": fp[moved]})

    return run


def links(points: DataFrame, radius: int = 4, blocks: int = 6, node_rows: int = 100_000) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `points`(fp).

    They are as few as needed: fingerprints reach each other over them exactly if they do so
    over all pairs at most `radius` bits apart.
    """
    if not 0 <= radius < blocks <= 16:
        raise ValueError("0 <= radius < blocks <= 16")
    codes = _codes(points, radius, blocks).withColumn("node", F.expr("shiftrightunsigned(code, 64 - top)"))
    counts = codes.groupBy("trie", "top", "node").count()
    sizes = counts.where("count > 1").select("trie", "node", "count")
    plain = codes.join(sizes.where(F.col("count") <= node_rows).select("trie", "node"), ["trie", "node"]).select(
        "trie", F.col("node").alias("task"), F.lit(0).alias("side"), "code", "fp", F.col("top").alias("depth"), F.lit(0).alias("diff")
    )
    schema = "a long, b long"
    found = plain.repartition("trie", "task").mapInPandas(_joined(radius, True), schema)
    large = counts.where(F.col("count") > node_rows)
    if large.isEmpty():
        return found
    return found.unionByName(_large(codes, large, radius, node_rows).mapInPandas(_joined(radius, False), schema))


def _large(codes: DataFrame, large: DataFrame, radius: int, node_rows: int) -> DataFrame:
    """Fingerprints of crowded nodes, dealt out by node pairs small enough for one task."""
    pairs = stored(large.select(
        "trie", F.col("node").alias("a"), F.col("node").alias("b"), F.col("top").alias("depth"), F.lit(0).alias("diff")
    ), "node-pairs")
    crowd = stored(codes.join(large.select("trie", "node"), ["trie", "node"], "left_semi").select("trie", "top", "code", "fp"), "crowd")
    ready = []
    while True:
        depth = F.least(F.col("depth") + STEP, F.lit(64))
        open_nodes = pairs.select("trie", F.col("a").alias("node"), "depth").unionByName(
            pairs.select("trie", F.col("b").alias("node"), "depth")).distinct()
        tops = open_nodes.select("trie", "depth").distinct()
        kids = crowd.join(F.broadcast(tops), "trie").withColumn("node", F.expr("shiftrightunsigned(code, 64 - depth)"))
        kids = kids.join(open_nodes, ["trie", "depth", "node"], "left_semi")
        kids = kids.withColumn("kid", F.expr(f"case when depth + {STEP} >= 64 then code else shiftrightunsigned(code, 64 - (depth + {STEP})) end"))
        kids = stored(kids.groupBy("trie", "depth", "node", "kid").count(), "nodes")
        a = kids.select("trie", "depth", F.col("node").alias("a"), F.col("kid").alias("ka"), F.col("count").alias("na"))
        b = kids.select("trie", "depth", F.col("node").alias("b"), F.col("kid").alias("kb"), F.col("count").alias("nb"))
        next_pairs = (
            pairs.join(a, ["trie", "depth", "a"]).join(b, ["trie", "depth", "b"])
            .where("a <> b OR ka <= kb")
            .withColumn("diff", F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))))
            .where(F.col("diff") <= radius)
            .select("trie", F.col("ka").alias("a"), F.col("kb").alias("b"), depth.alias("depth"), "diff", "na", "nb")
        )
        next_pairs = stored(next_pairs, "node-pairs")
        done = (F.col("na") + F.col("nb") <= 2 * node_rows) | (F.col("depth") == 64)
        ready.append(next_pairs.where(done))
        pairs = next_pairs.where(~done).select("trie", "a", "b", "depth", "diff")
        if pairs.isEmpty():
            break
    parts = []
    for part in ready:
        sides = part.withColumn("task", F.xxhash64("trie", "depth", "a", "b")).select(
            "trie", "depth", "diff", "task",
            F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node"))))
                      .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")),
                                         F.struct(F.lit(1).alias("side"), F.col("b").alias("node"))))).alias("s"),
        ).select("trie", "depth", "diff", "task", "s.*")
        depths = sides.select("trie", "depth").distinct()
        members = crowd.join(F.broadcast(depths), "trie").withColumn(
            "node", F.expr("case when depth = 64 then code else shiftrightunsigned(code, 64 - depth) end"))
        parts.append(members.join(sides, ["trie", "depth", "node"]).select("trie", "task", "side", "code", "fp", "depth", "diff"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.repartition("trie", "task")


def _classes(points: DataFrame, radius: int, blocks: int, node_rows: int) -> DataFrame:
    """(fp, root, least) of points(fp, least): root names the component, least is its smallest id."""
    near = stored(links(points.select("fp"), radius, blocks, node_rows), "links")
    alone = points.select("fp", F.col("fp").alias("root"), "least")
    if near.isEmpty():
        return alone
    linked = stored(components(near), "components").select(F.col("node").alias("fp"), "root")
    linked = points.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    shared = linked.groupBy("root").agg(F.min("least").alias("least"))
    return stored(linked.select("fp", "root").join(shared, "root"), "classes")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4,
    blocks: int = 6, node_rows: int = 100_000,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Rows whose fingerprints are linked by steps of at most `radius` differing bits share a
    component, named by its smallest id (null if all its ids are null). Null and empty texts
    have fingerprint 0. Repeated rows each give a row; other columns are left out; an empty
    table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    classes = _classes(points, radius, blocks, node_rows).select("fp", "least")
    return prints.join(classes, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4,
    blocks: int = 6, node_rows: int = 100_000,
) -> DataFrame:
    """The row of each component with the smallest id, with all its columns.

    Null ids rank last; among equal ids the text with the smallest hash stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = docs.toDF(*names).withColumn("k1", F.xxhash64(key)).withColumn("k2", F.xxhash64(text, F.lit(3)))
    identity = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", F.xxhash64("doc_id").alias("k1"), "k2")
    whole = rows.select(F.struct(key, "k2").alias("doc_id"), F.col(text).alias("text"))
    prints = stored(fingerprints(whole, width=width).select(F.col(f"doc_id.{key}").alias("doc_id"), "doc_id.k2", "fp"), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    classes = _classes(points, radius, blocks, node_rows).select("fp", "root")
    best = prints.join(classes, "fp").groupBy("root").agg(F.min(identity).alias("best")).select("best.k1", "best.k2")
    first = Window.partitionBy("k1", "k2").orderBy(key)
    kept = rows.join(best, ["k1", "k2"], "left_semi").withColumn("rank", F.row_number().over(first)).where("rank = 1")
    return kept.select(*names).toDF(*docs.columns)


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
