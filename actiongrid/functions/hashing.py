"""Content identities.

A row hash is SHA-256 over ordered JSON. A *set* of rows is identified by a Merkle tree: its
leaves are the distinct digests with their counts, and every node is the SHA-256 of what lies
below it in order: of `digest:count` items for the nodes of four hex digits, of the digests of
their children for those of two digits and for the root. Copies are counted before the shuffle,
so a list has at most the distinct digests of one prefix (150,000 of 10^10), whatever the copies.

The tree is a table and can be kept: a change recomputes only the nodes above it, and two trees
are compared from the root downwards, so only what differs is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Hex digits that the digests below a node share, from the lowest nodes to the root.
STEPS = (4, 2, 0)
#: The depth of the leaves: whole digests.
LEAF = 64


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the named columns in name order; absent values stay visible."""
    fields = [F.col(c).cast("string").alias(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def _leaves(rows: DataFrame, digest: str, groups: Sequence[str]) -> DataFrame:
    """(groups.., depth, prefix, n, sha256): distinct digests and how often each occurs."""
    counted = rows.groupBy(*groups, F.col(digest).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*groups, F.lit(LEAF).alias("depth"), "prefix", "n", F.col("prefix").alias("sha256"))


def _above(level: DataFrame, groups: Sequence[str], depth: int) -> DataFrame:
    """The nodes of `depth` over the nodes (or leaves) below them. Null digests count, and that
    is all; a node of nothing else has a null hash."""
    item = F.when(F.col("depth") == LEAF, F.concat("prefix", F.lit(":"), F.col("n").cast("string"))).otherwise(F.col("sha256"))
    items = F.array_sort(F.collect_list(F.when(F.col("sha256").isNotNull(), F.struct("prefix", item.alias("item")))))
    joined = F.sha2(F.concat_ws("", F.transform(items, lambda e: e["item"])), 256)
    return level.groupBy(*groups, F.coalesce(F.substring("prefix", 1, depth), F.lit("")).alias("__to")).agg(
        F.sum("n").alias("n"), F.when(F.max("sha256").isNotNull(), joined).alias("sha256")
    ).select(*groups, F.lit(depth).alias("depth"), F.col("__to").alias("prefix"), "n", "sha256")


def merkle_tree(rows: DataFrame, digest: str, groups: Sequence[str] = ()) -> DataFrame:
    """All nodes (groups.., depth, prefix, n, sha256) over the hex digests of `rows`."""
    level = _leaves(rows, digest, groups)
    tree = level
    for depth in STEPS:
        level = _above(level, groups, depth)
        tree = tree.unionByName(level)
    return tree


def _up(prefix: Column | str, depth: int) -> Column:
    """The node of `depth` above a node; null digests lie under the empty one."""
    return F.coalesce(F.substring(prefix, 1, depth), F.lit(""))


def updated_tree(tree: DataFrame, added: DataFrame, removed: DataFrame, digest: str) -> DataFrame:
    """The stored `tree` (without groups) after rows were added and removed.

    Only the nodes above a changed digest are built again, level by level (each stored), from
    their stored neighbours; all others are taken over. A digest removed more often than it occurs keeps a negative count.
    """
    side = lambda rows, sign: rows.select(F.col(digest).alias("prefix"), F.lit(sign).cast("long").alias("n"))
    delta = side(added, 1).unionByName(side(removed, -1)).groupBy("prefix").agg(F.sum("n").alias("n")).where("n <> 0")
    delta = durable(delta)
    touched = durable(delta.select(_up("prefix", STEPS[0]).alias("p")).distinct())

    def at(depth: int) -> DataFrame:
        return tree.where(F.col("depth") == depth)

    def beside(level: DataFrame, depth: int, how: str) -> DataFrame:
        """Rows of `level` under (or, as anti join, not under) a touched node of `depth`."""
        nodes = touched.select(_up("p", depth).alias("o")).distinct()
        return level.join(nodes, _up("prefix", depth) == F.col("o"), how)

    near = beside(at(LEAF), STEPS[0], "left_semi").select("prefix", "n").unionByName(delta)
    near = near.groupBy("prefix").agg(F.sum("n").alias("n")).where("n <> 0")
    level = near.select(F.lit(LEAF).alias("depth"), "prefix", "n", F.col("prefix").alias("sha256"))
    out = beside(at(LEAF), STEPS[0], "left_anti").unionByName(level)
    for lower, depth in zip((LEAF, *STEPS), STEPS):
        if lower != LEAF:  # neighbours below the same node that did not change
            level = level.unionByName(beside(beside(at(lower), depth, "left_semi"), lower, "left_anti"))
        level = durable(_above(level, (), depth))
        out = out.unionByName(beside(at(depth), depth, "left_anti")).unionByName(level)
    return out


def drifted(old: DataFrame, new: DataFrame) -> DataFrame:
    """(digest, old_count, new_count) of the digests whose counts differ between two trees
    (without groups). From the root down, only children of differing nodes are compared; what
    differs on a level is stored. Both trees should be stored as well."""
    differing = None
    for depth in (*STEPS[::-1], LEAF):
        sides = [t.where(F.col("depth") == depth) for t in (old, new)]
        if differing is not None:
            parent = differing.select(F.col("prefix").alias("up"))
            sides = [s.join(parent, F.col("prefix").substr(1, above) == F.col("up"), "left_semi") for s in sides]
        a, b = (s.select("prefix", F.col("n").alias(f"{w}_n"), F.col("sha256").alias(f"{w}_sha")) for s, w in zip(sides, ("old", "new")))
        both = a.join(b, "prefix", "full_outer")
        same = F.col("old_sha").eqNullSafe(F.col("new_sha")) & F.col("old_n").eqNullSafe(F.col("new_n"))
        differing = durable(both.where(~same))
        above = depth
    zero = F.lit(0).cast("long")
    return differing.select(F.col("prefix").alias("digest"), F.coalesce("old_n", zero).alias("old_count"), F.coalesce("new_n", zero).alias("new_count"))


def set_hash(rows: DataFrame, digest: str, groups: Sequence[str] = (), *, count: str = "rows", out: str = "set_sha256") -> DataFrame:
    """(groups.., count, out): rows and root hash of the hex digests of each group; without
    groups one row, also for an empty table. The order of rows does not matter. Null digests
    are counted and not hashed."""
    level = _leaves(rows, digest, groups)
    for depth in STEPS:
        level = _above(level, groups, depth)
    found = level.select(*groups, F.col("n").alias(count), F.col("sha256").alias(out))
    if groups:
        return found
    one = rows.sparkSession.range(1).select(F.lit(1).alias("__one"))
    return one.join(found, F.lit(True), "left").select(
        F.coalesce(count, F.lit(0)).alias(count), F.coalesce(out, F.sha2(F.lit(""), 256)).alias(out))
