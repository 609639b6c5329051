"""Substring dedup with prefix-partitioned suffix trees.

A suffix here starts at a word and matters down to a depth of `window` words; a window repeats
exactly if its path in the suffix tree of the corpus ends below a node that another start
shares, a deep internal node. The tree is built in groups that no machine holds together:

1. Every window names an anchor, the `gram`-word sequence with the smallest hash inside it (the
   leftmost of equal ones). Equal windows name equal anchors at equal places, so the suffixes
   with one anchor form a group, and how often the anchor occurs tells which groups can hold a
   repeat at all. Only their suffixes go on.
2. Neighbouring suffixes of a document with the same anchor travel as one stretch of words.
3. The prefix that a group is keyed by is the anchor for groups of up to `group_rows` stretches.
   Larger groups are split by longer prefixes of their suffixes, at most the full window. Equal
   stretches are folded before that shuffle, so a passage that a third of all documents share
   is one row a task.
4. In a task, the subtrees of many groups are built together, level by level: two suffixes
   share a node of depth 2d if they share one of depth d at their start and at word d. The
   nodes at depth `window` with a second leaf are the repeats.

Words are compared by their bytes; hashes choose groups and match stretches with their counts.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import query, stored, table

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stretches whose subtrees are built in one go.
TOGETHER = 20_000


def _words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram at every word, place of the anchor of every window)."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(5)), np.uint64, len(words))
    grams = len(words) - gram + 1
    code = np.zeros(grams, np.uint64)
    for i in range(gram):
        code = (code ^ word[i:i + grams]) * MIX
        code ^= code >> np.uint64(29)
    # leftmost smallest of `span` neighbours, by doubling
    span, best, have = window - gram + 1, np.arange(grams), 1
    while have < span:
        step = min(have, span - have)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(code[left] <= code[right], left, right)
        have += step
    return code, best


def _anchored(batch: list[str], window: int, gram: int):
    """(number, words, code, best) of every text of at least `window` words; texts share passes."""
    number = 0
    for run in slices(batch):
        lists = [_words(t) for t in run]
        code, best = anchors([w for words in lists for w in words], window, gram)
        at = 0
        for words in lists:
            n = len(words)
            if n >= window:
                yield number, words, code[at:at + n - gram + 1], best[at:at + n - window + 1] - at
            number += 1
            at += n


def _turns(best: np.ndarray) -> np.ndarray:
    """Where a run of windows with one anchor begins."""
    return np.flatnonzero(np.r_[True, best[1:] != best[:-1]])


def _candidates(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(k1, anchor, n): every anchor of every text and how often it is one there."""

    def run(batches):
        for batch in batches:
            out = []
            for i, _, code, best in _anchored(batch["text"].tolist(), window, gram):
                kinds, n = np.unique(code[best[_turns(best)]], return_counts=True)
                out.append((np.full(len(n), i), kinds, n))
            if out:
                which, kinds, n = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({
                    "k1": batch["k1"].to_numpy()[which], "anchor": kinds.view(np.int64), "n": n.astype(np.int32),
                })

    return rows.mapInPandas(run, "k1 long, anchor long, n int")


def _stretches(named: DataFrame, live: str, window: int, gram: int) -> DataFrame:
    """(k1, k2, starts, anchor, words): every run of windows whose one anchor is in `live`.

    Runs of a document that are alike, as in repeated lines, share a row.
    """
    columns = ["k1", "k2", "starts", "anchor", "words"]

    def run(batches):
        for batch in batches:
            out = []
            k1, k2, chosen = batch["k1"].tolist(), batch["k2"].tolist(), batch[live].tolist()
            for i, words, code, best in _anchored(batch["text"].tolist(), window, gram):
                starts = _turns(best)
                ends = np.r_[starts[1:], len(best)]
                own_anchor = code[best[starts]].view(np.int64)
                take = np.isin(own_anchor, chosen[i])
                anchor = own_anchor[take].tolist()
                own: dict[bytes, list] = {}
                for a, b, c in zip(starts[take].tolist(), ends[take].tolist(), anchor):
                    joined = b" ".join(words[a:b + window - 1])
                    if joined in own:
                        own[joined][2].append(a)
                    else:
                        own[joined] = [k1[i], k2[i], [a], c, joined]
                out += own.values()
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    return named.where(F.size(live) > 0).mapInPandas(run, "k1 long, k2 long, starts array<int>, anchor long, words binary")


def deep_nodes(stretches: list[list[bytes]], weights: np.ndarray, window: int) -> list[np.ndarray]:
    """For every stretch, which of its windows start a repeat; weights: how often it occurs.

    Names the nodes of depth 1, 2, 4, ... of the joint suffix tree by ranking pairs of names,
    then those of depth `window`.
    """
    sizes = np.array([len(s) for s in stretches])
    flat = [w for s in stretches for w in s]
    book: dict[bytes, int] = {}
    node = np.fromiter((book.setdefault(w, len(book)) for w in flat), np.int64, len(flat))
    start = np.concatenate([[0], np.cumsum(sizes)])
    depth = 1

    def join(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first * (int(second.max()) + 1) + second
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    while depth * 2 <= window:
        node = join(node, np.concatenate([node[depth:], np.zeros(depth, np.int64)]))
        depth *= 2
    if depth < window:
        step = window - depth
        node = join(node, np.concatenate([node[step:], np.zeros(step, np.int64)]))
    # only starts whose whole window lies in their stretch are leaves
    owner = np.repeat(np.arange(len(stretches)), sizes)
    leaf = np.arange(len(flat)) + window <= start[owner + 1]
    leaves = np.zeros(int(node.max()) + 1, np.int64)
    np.add.at(leaves, node[leaf], weights[owner[leaf]])
    twice = leaves[node] > 1
    return [twice[a:b - window + 1] for a, b in zip(start, start[1:])]


def _subtrees(window: int):
    """Marks the repeats of whole groups; rows come sorted by anchor."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        marks = deep_nodes([w.split(b" ") for w in rows["words"]], rows["starts"].map(len).to_numpy(), window)
        bits = np.array([sum(1 << i for i in np.flatnonzero(m).tolist()) for m in marks], np.int64)
        out = rows[["k1", "k2", "starts"]].assign(bits=bits)
        return out[bits != 0]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= TOGETHER:
                rows = pd.concat(held, ignore_index=True)
                other = np.flatnonzero(rows["anchor"].to_numpy() != rows["anchor"].iloc[-1])
                cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
                if cut:
                    yield grow(rows.iloc[:cut])
                held, size = [rows.iloc[cut:]], len(rows) - cut
        if size:
            yield grow(pd.concat(held, ignore_index=True))

    return run


def _crowded(stretches: DataFrame, window: int) -> DataFrame:
    """(k1, k2, starts, bits) for groups too large for one task, suffix by suffix.

    Stretches are folded first. The key of a suffix is then its whole window, the longest prefix
    there is; leaves are counted by partial aggregation.
    """
    folded = stretches.groupBy("words").agg(F.sum(F.size("starts")).alias("n"))
    words = F.split(F.decode("words", "UTF-8"), " ")
    suffix = folded.select(F.sha2("words", 256).alias("stretch"), "n", words.alias("w")).select(
        "stretch", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (window - 1))).alias("at"))
    suffix = suffix.select("stretch", "n", "at", F.array_join(F.slice("w", F.col("at"), window), " ").alias("prefix"))
    deep = suffix.groupBy("prefix").agg(F.sum("n").alias("leaves")).where("leaves > 1").select("prefix")
    marks = suffix.join(deep, "prefix").groupBy("stretch").agg(F.expr("bit_or(shiftleft(1L, at - 1))").alias("bits"))
    places = stretches.select("k1", "k2", "starts", F.sha2("words", 256).alias("stretch"))
    return places.join(marks, "stretch").select("k1", "k2", "starts", "bits")


def repeats(rows: DataFrame, window: int, gram: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their repeated anchors, repeats) of rows(k1, k2, doc, text).

    A repeat is (k1, k2, starts, bits): bit i of bits is set if repeated windows start i words
    after each of starts. Both belong to one plan, in which texts are dealt out by k1 once.
    """
    if not 1 <= gram <= window or window - gram > 61:
        raise ValueError("1 <= gram <= window <= gram + 61")
    found = _candidates(rows.select("k1", "text"), window, gram)
    again = found.groupBy("anchor").agg(F.sum("n").alias("all")).where("all > 1")
    again = again.select((F.col("anchor") + F.lit(0)).alias("seen"), (F.col("all") > group_rows).alias("crowd"))
    live = stored(found.join(again, found["anchor"] == again["seen"]).groupBy("k1").agg(
        F.collect_list(F.when(~F.col("crowd"), F.col("anchor"))).alias("few"),
        F.collect_list(F.when(F.col("crowd"), F.col("anchor"))).alias("crowded"),
    ), "anchors")
    named = rows.join(live, "k1", "left")
    few = _stretches(named, "few", window, gram)
    few = few.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_subtrees(window), "k1 long, k2 long, starts array<int>, bits long")
    if live.where(F.size("crowded") > 0).isEmpty():
        return named, few
    return named, few.unionByName(_crowded(_stretches(named, "crowded", window, gram), window))


def without_repeats(
    docs: DataFrame, window: int = 35, gram: int = 5, group_rows: int = TOGETHER, text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """`docs` with n_words, n_removed and kept, what stays of the text.

    Every word that lies in a `window`-word sequence which also starts elsewhere is removed, all
    occurrences alike; kept words are joined by one blank. A null text has no words, and so
    shares nothing. Repeated rows are documents of their own and repeat each other. Ids may be
    null or repeated; other columns pass through. An empty table gives no rows.

    Rows are matched with what was found in them by two hashes of id and text. Rows alike in
    both are the same text of the same document, for which the same is found.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = docs.toDF(*names).select(
        F.xxhash64(key, text).alias("k1"), F.xxhash64(text, F.lit(3)).alias("k2"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.struct(*[n for n in names if n != text], F.col(text).isNull().alias("void")).alias("doc"),
    )
    named, found = repeats(rows, window, gram, group_rows)
    spans = found.groupBy("k1").agg(F.collect_set(F.struct("k2", "starts", "bits")).alias("spans"))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def strip(text: pd.Series, k2: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, own, marked in zip(text, k2, spans):
            words = _words(t)
            gone = np.zeros(len(words) + 1, np.int64)
            for span in marked if marked is not None else ():
                if span["k2"] != own:
                    continue
                at = np.add.outer(span["starts"], np.flatnonzero([span["bits"] >> i & 1 for i in range(62)])).ravel()
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            keep = np.cumsum(gone[:len(words)]) == 0
            kept = [w for w, k in zip(words, keep.tolist()) if k]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    out = named.join(spans, "k1", "left").select("doc", "text", strip("text", "k2", "spans").alias("s"))
    original = F.when(~F.col("doc.void"), F.col("text"))
    return out.select(
        *[original.alias(n) if n == text else F.col(f"doc.{n}").alias(n) for n in names], "s.n_words", "s.n_removed", "s.kept"
    ).toDF(*docs.columns, "n_words", "n_removed", "kept")


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
