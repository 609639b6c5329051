"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A text's words are hashed to rows of an embedding table; filters of several widths slide over
them; each keeps its largest response, and a linear layer turns these into one logit. The first
embedding coordinate starts as the smoothed log-odds of a word's hash cell, everything else at
random; all of it is trained by Adam on minibatches, the gradient flowing through the windows
that won the pooling.

Training takes all labelled rows. Their words are stored once, in blocks of bounded size; in an
epoch every block is trained on by itself from the same network, and the steps are averaged: of a
table row, over the blocks that moved it. What goes to the driver is one network an epoch.

Thresholds are calibrated by language on all labelled rows kept from training, by running sums over
their ordered logits. The language that picks a threshold is read off the text by the same hashed
words, never taken from a column; the score is shifted so that each language's threshold lies at one half.
"""

from __future__ import annotations

import copy

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import Running, order_by_key
from .bpe import slices
from .common import held_out, query, stored, table, texts
from .grams import bit_table, may_hold

CELLS = 1 << 16
EDGE = b".,;:!?\"'()[]{}<>*#$%&-_"
#: Words of a part; longer texts go in parts that share their largest responses. Words in one run of the network.
PART, RUN = 50_000, 500_000
#: Labelled rows and bytes of words (two a word) in a block of training, about.
BLOCK_ROWS, BLOCK_BYTES = 8192, 16_000_000
#: Table rows that are averaged together.
PIECE = 1024
REMEMBERED = 500_000
_cell: dict[bytes, int] = {}


def cells(text: str | None) -> np.ndarray:
    """Table rows of a text's words (lowered, edge punctuation off); row 0 is padding."""
    words = [] if text is None else text.lower().encode("utf-8", "surrogatepass").split()
    if len(_cell) > REMEMBERED:
        _cell.clear()
    for w in {w for w in words if w not in _cell}:
        _cell[w] = 1 + xxhash.xxh64_intdigest(w.strip(EDGE)) % (CELLS - 1)
    return np.fromiter(map(_cell.__getitem__, words), np.int32, len(words))


class Net:
    """widths: words a filter spans; filters: how many there are of each width."""

    def __init__(self, widths=(1, 2, 3), filters: int = 16, dim: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.table = rng.normal(0, 0.1, (CELLS, dim)).astype(np.float32)
        self.table[0] = 0
        self.kernels = [rng.normal(0, 0.3 / np.sqrt(w), (w, dim, filters)).astype(np.float32) for w in widths]
        for kernel in self.kernels:
            kernel[:, 0, :filters // 4] = 1.0
        self.shift = [np.zeros(filters, np.float32) for _ in widths]
        self.out = rng.normal(0, 0.1, len(widths) * filters).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.langs: list[str] = []
        self.lang_table = np.zeros((CELLS, 0), np.float32)
        self.cuts = np.zeros(1)
        self.first: list[np.ndarray] = []
        self.second: list[np.ndarray] = []
        self.squares, self.step = np.full(CELLS, 1e-4, np.float32), 0

    def _lay(self, docs: list[np.ndarray]):
        """Runs of parts of different texts: all words in a row, each part followed by padding; which
        of them start a window of their part; where parts start; whose they are."""
        gap = max(self.widths)
        pad, parts, starts_window, owner, size = np.zeros(gap, np.int32), [], [], [], 0
        for i, doc in enumerate(docs):
            for start in range(0, max(len(doc), 1), PART):
                if size >= RUN or owner and owner[-1] == i:
                    yield self._run(parts, starts_window, owner)
                    parts, starts_window, owner, size = [], [], [], 0
                parts.append(np.concatenate([doc[start:start + PART + gap - 1], pad]))
                starts_window.append(np.arange(len(parts[-1])) < min(PART, len(doc) - start))
                owner.append(i)
                size += len(parts[-1])
        if parts:
            yield self._run(parts, starts_window, owner)

    @staticmethod
    def _run(parts, starts_window, owner):
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return np.concatenate(parts), np.concatenate(starts_window), at[:-1], np.array(owner)

    def pooled(self, docs: list[np.ndarray], where: bool = False):
        """Largest response of every filter in every text, and with `where`, by width, the words that gave it."""
        tops = [np.full((len(docs), self.filters), -np.inf, np.float32) for _ in self.widths]
        won = [np.zeros((len(docs), self.filters, width), np.int32) for width in self.widths] if where else []
        for words, valid, starts, owner in self._lay(docs):
            seen = self.table[words]
            for i, (width, kernel) in enumerate(zip(self.widths, self.kernels)):
                n = len(words) - width + 1
                response = seen[:n] @ kernel[0]
                for j in range(1, width):
                    response += seen[j:n + j] @ kernel[j]
                response[~valid[:n]] = -np.inf
                peak = np.maximum.reduceat(response, starts, axis=0)
                better = peak > tops[i][owner]
                tops[i][owner] = np.where(better, peak, tops[i][owner])
                if where:
                    ends = np.append(starts[1:], n)
                    place = np.stack([response[a:b].argmax(axis=0) + a for a, b in zip(starts, ends)])
                    at_words = words[np.minimum(place[:, :, None] + np.arange(width), len(words) - 1)]
                    won[i][owner] = np.where(better[:, :, None], at_words, won[i][owner])
        return np.concatenate([np.maximum(top + shift, 0) for top, shift in zip(tops, self.shift)], axis=1), won

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.pooled(docs)[0] @ self.out + self.bias[0]

    def dense(self) -> list[np.ndarray]:
        """All arrays but the table that training changes, the state of Adam included."""
        own = [*self.kernels, *self.shift, self.out, self.bias]
        if not self.first:
            self.first, self.second = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        return [*own, *self.first, *self.second]

    def epoch(self, docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 0.01) -> np.ndarray:
        """Adam on the logistic loss, every text once; which table rows were moved."""
        arrays = self.dense()
        count, moved = len(arrays) // 3, np.zeros(CELLS, bool)
        dense, first, second = arrays[:count], arrays[count:2 * count], arrays[2 * count:]
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            h, won = self.pooled([docs[i] for i in chosen], where=True)
            p = 1 / (1 + np.exp(-(h @ self.out + self.bias[0])))
            d = ((p - y[chosen]) / len(chosen)).astype(np.float32)
            grads_k, grads_s, rows, pulls = [], [], [], []
            for i, kernel in enumerate(self.kernels):
                part = slice(i * self.filters, (i + 1) * self.filters)
                pull = d[:, None] * self.out[part] * (h[:, part] > 0)
                grads_k.append(np.einsum("bfwd,bf->wdf", self.table[won[i]], pull, optimize=True))
                grads_s.append(pull.sum(axis=0))
                rows.append(won[i].ravel())
                pulls.append(np.einsum("bf,wdf->bfwd", pull, kernel, optimize=True).reshape(-1, self.table.shape[1]))
            self.step += 1
            for k, (p_, g) in enumerate(zip(dense, [*grads_k, *grads_s, h.T @ d, d.sum(keepdims=True)])):
                first[k][...] = 0.9 * first[k] + 0.1 * g
                second[k][...] = 0.999 * second[k] + 0.001 * g * g
                p_ -= rate * (first[k] / (1 - 0.9**self.step)) / (np.sqrt(second[k] / (1 - 0.999**self.step)) + 1e-8)
            row, place = np.unique(np.concatenate(rows), return_inverse=True)
            pull = np.zeros((len(row), self.table.shape[1]), np.float32)
            np.add.at(pull, place, np.concatenate(pulls))
            self.squares[row] += (pull * pull).mean(axis=1)
            self.table[row] -= rate * pull / np.sqrt(self.squares[row])[:, None]
            self.table[0] = 0
            moved[row] = True
        return moved

    def start_table(self, seen: np.ndarray, rows: np.ndarray) -> None:
        """From the clean and toxic texts that hold each cell, and how many there are of both."""
        share = (seen + 2) / (rows[:, None] + 4)
        self.table[:, 0] = np.log(share[1] / share[0]) / 2
        self.table[0] = 0

    def learn_languages(self, counts: dict[str, np.ndarray]) -> None:
        """Hash-cell log-probabilities per language, to tell languages apart by text."""
        self.langs = sorted(counts)
        held = np.array([counts[x] for x in self.langs]).reshape(-1, CELLS) + 0.1
        self.lang_table = np.log(held / held.sum(axis=1, keepdims=True)).T.astype(np.float32)

    def language(self, docs: list[np.ndarray]) -> np.ndarray:
        if not self.langs:
            return np.zeros(len(docs), np.int64)
        return np.stack([self.lang_table[d].sum(axis=0) for d in docs]).argmax(axis=1)

    def scores(self, batch: list[str | None]) -> np.ndarray:
        docs = [cells(t) for t in batch]
        shifted = self.logits(docs) - self.cuts[self.language(docs)]
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def best_cuts(scored: DataFrame) -> dict[int, tuple[int, float]]:
    """lang -> (toxic rows, cut) of (lang, logit, toxic) rows: halfway between the two neighbouring
    logits whose split has the best F1, the higher of equal ones; above all logits without toxic rows."""
    marks = scored.groupBy("lang", (-F.col("logit")).alias("down")).agg(F.sum("toxic").alias("hit"), F.count(F.lit(1)).alias("n"))
    marks = stored(marks, "logits")
    whole = marks.groupBy("lang").agg(F.sum("hit").alias("hits"), F.min("down").alias("top"), F.max("down").alias("end"), F.sum("n").alias("rows"))
    ordered = order_by_key(marks, ("lang",), ("down",)).scan(
        lag={"before": "down"}, running={"hit_before": Running("sum", F.col("hit"), True), "n_before": Running("sum", F.col("n"), True)}).rows()
    f1 = lambda hit, n: 2 * hit / (n + F.col("hits"))
    splits = ordered.where("before is not null").join(whole, "lang").select(
        "lang", f1(F.col("hit_before"), F.col("n_before")).alias("f1"), (-(F.col("before") + F.col("down")) / 2).alias("cut"))
    every = whole.select("lang", f1(F.col("hits"), F.col("rows")).alias("f1"), (-F.col("end") - 0.5).alias("cut"))
    best = splits.unionByName(every).groupBy("lang").agg(F.max(F.struct("f1", "cut")).alias("best"))
    found = best.join(whole, "lang").select("lang", "hits", F.when(F.col("hits") > 0, F.col("best.cut")).otherwise(1 - F.col("top")).alias("cut"))
    return {r["lang"]: (r["hits"], float(r["cut"])) for r in found.collect()}  # a row a language


def _counts(batches):
    """(name, n, cells): texts of each label and cells of the texts that hold them; words of each language."""
    held: dict[str, list] = {}
    for rows in batches:
        for y, lang, raw in zip(rows["toxic"], rows["lang"], rows["words"]):
            words = np.frombuffer(raw, np.uint16)
            names = [(f"label {y}", np.unique(words))] + ([("lang " + lang, words)] if isinstance(lang, str) else [])
            for name, at in names:
                entry = held.setdefault(name, [0, np.zeros(CELLS, np.int64)])
                entry[0] += 1
                np.add.at(entry[1], at, 1)
    for name, (n, cells_) in held.items():
        yield pd.DataFrame({"name": [name], "n": [n], "cells": [cells_.tobytes()]})


def _add_counts(batches):
    held: dict[str, list] = {}
    for rows in batches:
        for name, n, raw in zip(rows["name"], rows["n"], rows["cells"]):
            entry = held.setdefault(name, [0, np.zeros(CELLS, np.int64)])
            entry[0] += n
            entry[1] += np.frombuffer(raw, np.int64)
    for name, (n, cells_) in held.items():
        yield pd.DataFrame({"name": [name], "n": [n], "cells": [cells_.tobytes()]})


STEPS = "piece int, rows binary, steps binary, blocks binary"


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([a.ravel() for a in net.dense()])


def _trained(shared, number: int):
    """Sums, over the blocks of a partition, of the steps that an epoch makes from the shared network."""

    def run(batches):
        given = shared.value
        flat, dim = _flat(given), given.table.shape[1]
        steps, blocks = np.zeros((CELLS, dim + 1), np.float32), np.zeros(CELLS, np.int32)
        dense, trained, longest = np.zeros(len(flat)), 0, 0
        for block, docs, y in _blocks(batches):
            net = copy.deepcopy(given)
            moved = net.epoch(docs, y, np.random.default_rng([number, block]))
            steps[moved, :dim] += net.table[moved] - given.table[moved]
            steps[moved, dim] += net.squares[moved] - given.squares[moved]
            blocks += moved
            dense += _flat(net) - flat
            trained, longest = trained + 1, max(longest, net.step)
        if not trained:
            return
        tail = np.append(dense, longest).astype(np.float64)
        yield pd.DataFrame({"piece": [-1], "rows": [b""], "steps": [tail.tobytes()], "blocks": [np.int32(trained).tobytes()]})
        for piece in range(0, CELLS, PIECE):
            rows = np.flatnonzero(blocks[piece:piece + PIECE]) + piece
            if len(rows):
                yield pd.DataFrame({"piece": [piece], "rows": [rows.astype(np.int32).tobytes()], "steps": [steps[rows].tobytes()], "blocks": [blocks[rows].tobytes()]})

    return run


def _blocks(batches):
    """(block, words of its texts, labels); the rows of a block lie together."""
    held: list[pd.DataFrame] = []

    def whole():
        rows = pd.concat(held)
        docs = [np.frombuffer(raw, np.uint16).astype(np.int32) for raw in rows["words"]]
        return int(rows["block"].iloc[0]), docs, rows["toxic"].to_numpy(np.float32)

    for batch in batches:
        for block, rows in batch.groupby("block", sort=True):
            if held and held[0]["block"].iloc[0] != block:
                yield whole()
                held = []
            held.append(rows)
    if held:
        yield whole()


def _add_steps(batches):
    """One row a piece: all steps added up, as those of one partition are."""
    held: dict[int, list] = {}
    for batch in batches:
        for piece, rows, steps, blocks in zip(batch["piece"], batch["rows"], batch["steps"], batch["blocks"]):
            if piece < 0:
                steps, blocks = np.frombuffer(steps), np.frombuffer(blocks, np.int32)
                if piece in held:
                    longest = max(held[piece][0][-1], steps[-1])
                    held[piece] = [held[piece][0] + steps, held[piece][1] + blocks]
                    held[piece][0][-1] = longest
                else:
                    held[piece] = [steps.copy(), blocks.copy()]
                continue
            at = np.frombuffer(rows, np.int32) - piece
            steps = np.frombuffer(steps, np.float32).reshape(len(at), -1)
            entry = held.setdefault(piece, [np.zeros((PIECE, steps.shape[1]), np.float32), np.zeros(PIECE, np.int32)])
            entry[0][at] += steps
            entry[1][at] += np.frombuffer(blocks, np.int32)
    for piece, (steps, blocks) in held.items():
        rows = b""
        if piece >= 0:
            at = np.flatnonzero(blocks)
            rows, steps, blocks = (at + piece).astype(np.int32).tobytes(), steps[at], blocks[at]
        yield pd.DataFrame({"piece": [piece], "rows": [rows], "steps": [steps.tobytes()], "blocks": [blocks.tobytes()]})


def _train(net: Net, rows: DataFrame, epochs: int) -> None:
    """Epochs over the stored blocks; the driver gets one network's size of steps an epoch."""
    context = rows.sparkSession.sparkContext
    for number in range(epochs):
        net.dense()
        shared = context.broadcast(net)
        done = rows.mapInPandas(_trained(shared, number), STEPS).repartition("piece").mapInPandas(_add_steps, STEPS)
        for r in done.collect():
            blocks = np.frombuffer(r["blocks"], np.int32)
            if r["piece"] < 0:
                steps = np.frombuffer(r["steps"])
                net.step, at = int(steps[-1]), 0
                for array in net.dense():
                    array += (steps[at:at + array.size] / blocks[0]).reshape(array.shape).astype(np.float32)
                    at += array.size
                continue
            at, steps = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["steps"], np.float32).reshape(len(blocks), -1)
            net.table[at] += steps[:, :-1] / blocks[:, None]
            net.squares[at] += steps[:, -1] / blocks
        shared.unpersist()


def fit(docs: DataFrame, labels: DataFrame, epochs: int = 8, least: int = 20, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Net | None:
    """A network from all labelled rows of `docs`; None unless both labels occur.

    Four fifths by a hash of the id train, the others calibrate; a language with fewer than `least`
    toxic rows there uses the cut of all. Labels other than 0 and 1 and null ids teach nothing; a
    document labelled both ways counts as toxic.
    """
    kind, spark = docs.schema[id_col].dataType, docs.sparkSession
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast(kind).alias("doc_id"), F.col(label_col).alias("toxic"))
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sieve = spark.sparkContext.broadcast(bit_table(marks.select(F.xxhash64("doc_id").alias("code")), "code"))

    def chosen(batches):
        """Words of the texts that may be labelled; the others never enter the join."""
        for batch in batches:
            own = batch[may_hold(sieve.value, batch["code"].to_numpy().view(np.uint64))]
            yield own[["doc_id", "lang"]].assign(words=[cells(t).astype(np.uint16).tobytes() for t in own["text"]])

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text, F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("code"))
    named = named.mapInPandas(chosen, f"doc_id {kind.simpleString()}, lang {docs.schema[lang_col].dataType.simpleString()}, words binary")
    rows = named.join(marks.hint("merge"), "doc_id").withColumn("kept", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0)
    rows = stored(rows.withColumn("place", F.xxhash64("doc_id", "words")).drop("doc_id"), "labelled")
    n, labels_, size = rows.agg(F.count(F.lit(1)), F.count_distinct("toxic"), F.sum(F.octet_length("words"))).first()
    if labels_ < 2:
        return None
    number = max(1, -(-n // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    train = rows.where("not kept").select(F.pmod("place", F.lit(number)).cast("int").alias("block"), "place", "toxic", "lang", "words")
    train = stored(train.repartitionById(number, "block").sortWithinPartitions("block", "place", "toxic"), "training")
    net, seen, of_label, langs = Net(), np.zeros((2, CELLS)), np.zeros(2), {}
    schema = "name string, n long, cells binary"
    for r in train.mapInPandas(_counts, schema).repartition("name").mapInPandas(_add_counts, schema).collect():
        kind, name = r["name"].split(" ", 1)
        if kind == "label":
            seen[int(name)], of_label[int(name)] = np.frombuffer(r["cells"], np.int64), r["n"]
        else:
            langs[name] = np.frombuffer(r["cells"], np.int64)
    net.start_table(seen, of_label)
    net.learn_languages(langs)
    _train(net, train.select("block", "toxic", "words"), epochs)
    net.first, net.second = [], []

    shared = spark.sparkContext.broadcast(net)

    def judged(batches):
        for batch in batches:
            at = 0
            for run in slices(batch["words"].tolist()):
                words = [np.frombuffer(raw, np.uint16).astype(np.int32) for raw in run]
                toxic = batch["toxic"].to_numpy()[at:at + len(run)]
                yield pd.DataFrame({"lang": shared.value.language(words).astype(np.int32), "logit": shared.value.logits(words).astype(float), "toxic": toxic})
                at += len(run)

    scored = stored(rows.where("kept").select("words", "toxic").mapInPandas(judged, "lang int, logit double, toxic int"), "calibration")
    both = scored.unionByName(scored.withColumn("lang", F.lit(-1)))
    cuts = best_cuts(both)
    net.cuts = np.full(max(len(net.langs), 1), cuts.get(-1, (0, 0.0))[1])
    for i, (hits, cut) in cuts.items():
        if i >= 0 and hits >= least:
            net.cuts[i] = cut
    return net


def scorer(spark: SparkSession, net: Net | None):
    """A function of a text column: the score, 0 where there is no network."""
    shared = spark.sparkContext.broadcast(net)  # a fixed number of table rows

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        if shared.value is None or not len(text):
            return pd.Series(np.zeros(len(text)))
        return pd.Series(np.concatenate([shared.value.scores(run) for run in slices(text.tolist())]))

    return of


def classify(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, from the text alone; a null text counts as empty.

    Repeated rows repeat and other columns are left out.
    """
    found = texts(docs, id_col, text_col).select("doc_id", scorer(docs.sparkSession, net)("text").alias("score"))
    return found.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_cnn_toxicity")
def op6_cnn_toxicity(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    net = fit(docs, table(spark, sf_dir, "labels").where(~out))
    return classify(docs, net).select("doc_id", out.alias("held_out"), "score", "predicted")
