"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that occur side by side in no vocabulary token can never end up in one
token, so the text may be cut there: merges never reach over the cut, and none of the merges on
one side depends on the other. Between such cuts a text falls into short fragments, few of them
new; a fragment is encoded when a worker first meets it, and the ids of a text are those of its
fragments, one after the other.

The tokenizer also splits text by a pattern before it merges. A cut must leave that split as it
is, which narrows the pairs taken: the left byte is printable ASCII other than the apostrophe
(no cut follows white space, whose split looks ahead), and the right byte starts a character and
is no apostrophe (a fragment that began with one could be read as a contraction).
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import query, table, texts

#: Distinct fragments that a worker remembers before it starts anew.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, all other bytes for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encodes and decodes with one tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, decoder = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") \
                or decoder.get("type") != "ByteLevel" or not before.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_letters()
        added = {a["content"] for a in spec.get("added_tokens", ())}
        self.bytes_of: dict[int, bytes] = {
            number: bytes(letters[c] for c in token) for token, number in spec["model"]["vocab"].items()
            if token not in added and all(c in letters for c in token)
        }
        joint = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:]):
                joint[a, b] = True
        self.specials: dict[bytes, int] = {}
        for token in spec.get("added_tokens", ()):
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"{path} has an added token with options")
            content = token["content"].encode()
            self.specials[content] = token["id"]
            self.bytes_of[token["id"]] = content
        self.encode_fragment = self._ranked(spec["model"]["merges"], letters)
        cuts = ~joint
        left = np.zeros(256, bool)
        left[0x21:0x7F] = True
        left[0x27] = False
        cuts[~left] = False
        cuts[:, 0x80:0xC0] = False
        cuts[:, 0x27] = False
        self.cuts = cuts.ravel()
        self._forget()

    def _ranked(self, merges: list, letters: dict[str, int]):
        """An encoder of plain fragments by token rank, where tokens are numbered in merge order.

        It gives the ids of the tokenizers library at a fraction of the cost per call; None for
        other vocabularies.
        """
        import public_tokenizers
        import tiktoken

        plain = {token: number for number, token in self.bytes_of.items() if token not in self.specials}
        for rank, merge in enumerate(merges):
            pair = merge.split(" ") if isinstance(merge, str) else merge
            if plain.get(bytes(letters[c] for c in "".join(pair))) != 256 + rank:
                return None
        if len(plain) != 256 + len(merges):
            return None
        ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={})
        return ranked._core_bpe.encode_ordinary  # the public method only adds a guard for broken text

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, fragments: set[bytes]) -> None:
        fresh = list(fragments)
        plain = [f.decode("utf-8") for f in fresh]
        if self.encode_fragment:
            special = self.specials
            ids = [[special[f]] if f in special else self.encode_fragment(t) for f, t in zip(fresh, plain)]
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch(plain, add_special_tokens=False)]
        first = len(self.place)
        self.place.update(zip(fresh, range(first, first + len(fresh))))
        ends = np.cumsum([len(i) for i in ids]) + self.starts[-1]
        self.starts = np.concatenate([self.starts, ends])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1] - len(self.ids)))])

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and the last ends)."""
        raw = [t.encode("utf-8") for t in batch]
        buffer = b"".join(raw)
        edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(buffer, np.uint8)
        cut = np.flatnonzero(self.cuts[(data[:-1].astype(np.int32) << 8) | data[1:]]) + 1
        inside = []
        for special in self.specials:
            at = buffer.find(special)
            while at >= 0:
                text = np.searchsorted(edges, at, side="right") - 1
                if at + len(special) <= edges[text + 1]:
                    inside.append((at, at + len(special)))
                    at = buffer.find(special, at + len(special))
                else:  # half of it belongs to the next text
                    at = buffer.find(special, at + 1)
        for a, b in inside:
            cut = cut[(cut <= a) | (cut >= b)]
        points = np.sort(np.concatenate([edges, cut, np.array(inside, np.int64).ravel()]), kind="stable")
        points = points[np.append(True, points[1:] != points[:-1])]
        bounds = points.tolist()
        fragments = [buffer[a:b] for a, b in zip(bounds, bounds[1:])]
        known = self.place
        fresh = {f for f in fragments if f not in known}
        if fresh:
            if len(known) + len(fresh) > REMEMBERED and known:
                self._forget()
                fresh = set(fragments)
            self._learn(fresh)
        place = np.fromiter(map(self.place.__getitem__, fragments), np.int64, len(fragments))
        begin, size = self.starts[place], self.starts[place + 1] - self.starts[place]
        total = np.concatenate([[0], np.cumsum(size)])
        gather = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return self.ids[gather], total[np.searchsorted(points, edges)]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


#: Texts handled together in a worker; bounds its memory whatever the batches of Spark hold.
TOGETHER = 1 << 20


def slices(batch: list, together: int = TOGETHER):
    """Runs of texts of about `together` characters; a longer text is a run of its own."""
    run, held = [], 0
    for text in batch:
        if run and held + len(text) > together:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def arrow_runs(batches, column: str = "text", rows: int = 256):
    """(rows of the batch, texts) run by run; only one run's texts are Python objects at a time."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            at = 0
            for run in slices(part.column(place).to_pylist()):
                yield part.slice(at, len(run)), run
                at += len(run)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies; every machine of the cluster has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _mapped(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    def run(batches):
        book = codec(vocabulary)
        for rows, run_texts in arrow_runs(batches):
            ids, at = book.encode(run_texts)
            columns = [rows.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))]
            if decoded:
                whole = ids.tolist()
                columns.append(pa.array([book.decode(whole[a:b]) for a, b in zip(at, at[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names[:len(columns)])

    names = ["doc_id", "ids", "decoded"]
    rows = texts(docs, id_col, text_col)
    fields = [rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("doc_id", id_col)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; null and empty texts have no ids.

    Every row is encoded where it lies, without a shuffle. Repeated rows repeat, other columns
    are left out, and an empty table gives no rows.
    """
    return _mapped(docs, vocabulary, id_col, text_col, False)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode`, with `decoded`, the text that the ids give back, in the same pass."""
    return _mapped(docs, vocabulary, id_col, text_col, True)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give the empty text."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        book = codec(vocabulary)
        return pd.Series([book.decode([] if i is None else i.tolist()) for i in ids], dtype=object)

    return encoded.select(F.col(id_col), text_of(F.col(ids_col)).alias("text"))


@query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark, sf_dir):
    found = round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"),
    )
