"""Tokens, packing and repeated passages against the library and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiongrid.llm.bpe import Codec, decode, encode, round_trip, vocabulary_path
from actiongrid.llm.packing import fill, pack, plan, sequences, token_pieces
from actiongrid.llm.substring_dedup import without_repeats

PIECES = ["a", "b", "q", "x", "X", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'s", "'t", "'re", "'", "%", "!", "19", "é", "漢", "😀",
          "<|endoftext|>", "<|", "|>", "\r\n", "\x1c", "\x85", ".", "_", "'ll", "\u0301", "the", " of", "zq"]


@pytest.fixture(scope="module")
def book():
    return Codec(vocabulary_path())


def texts_of(n, seed=1):
    rng = random.Random(seed)
    return ["", " ", "x" * 30_000, "<|endoftext|>" * 3] + ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(n)]


def test_ids_are_the_library_s(book):
    texts = texts_of(20_000)
    expect = [e.ids for e in book.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for start in range(0, len(texts), 997):
        ids, at = book.encode(texts[start:start + 997])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == expect[start:start + 997]
    for ids in expect[:500]:
        cut = ids[:len(ids) // 2]
        assert book.decode(cut) == book.tokenizer.decode(cut, skip_special_tokens=False)


def test_ids_without_rank_encoder(book):
    plain = Codec(vocabulary_path())
    assert plain.encode_fragment is not None
    plain.encode_fragment = None
    texts = texts_of(300, 2)
    assert all(np.array_equal(a, b) for a, b in zip(plain.encode(texts), book.encode(texts)))


def test_encode_and_decode(spark):
    rows = [(1, "It's the zqxj\nof", "n"), (None, None, "n"), (2, "", "n"), (1, "It's the zqxj\nof", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    both = round_trip(docs, vocabulary_path())
    assert sorted((r.doc_id or 0, r.decoded) for r in both.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    back = decode(encode(docs, vocabulary_path()), vocabulary_path())
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert round_trip(docs.limit(0), vocabulary_path()).count() == 0


def reachable(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    return max(sums)


def test_fill_comes_closest():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(0, 7))}
        room = rng.randint(0, 100)
        taken = fill(counts, room)
        assert all(taken[n] <= counts[n] for n in taken)
        assert sum(n * c for n, c in taken.items()) == reachable(counts, room)


def test_plan_uses_every_piece():
    rng = random.Random(6)
    counts = Counter(rng.randint(1, 100) for _ in range(5000))
    used = Counter()
    for window, times in plan(counts, 100):
        assert sum(n * c for n, c in window.items()) <= 100
        for n, c in window.items():
            used[n] += c * times
    assert used == counts
    with pytest.raises(ValueError):
        plan({101: 1}, 100)


def test_packed_sequences(spark, book):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "zq"], k=rng.randint(0, 70))), 0) for i in range(200)]
    rows += [(500, None, 0), (501, "", 0), (None, "a b", 0), (507, "a b", 0), (507, "a b", 0), (502, "long " * 900, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    pieces = token_pieces(docs, vocabulary_path(), 64)
    packed = pack(pieces, 64)
    placed = packed.collect()
    by_sequence = {}
    for r in placed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    texts = {i: t for i, t, _ in rows}
    for r in placed:
        ids = np.append(book.encode([texts[r.doc_id] or ""])[0], 1).astype("<u4")
        assert bytes(r.ids) == ids[r.start:r.start + r.length].tobytes() and r.doc_tokens == len(ids)
    whole = Counter((r.doc_id, r.start, r.length) for r in placed)
    expect = Counter()
    for i, t, _ in rows:
        n = len(book.encode([t or ""])[0]) + 1
        expect.update((i, s, min(64, n - s)) for s in range(0, n, 64))
    assert whole == expect
    bins = []  # first fit, longest first
    for n in sorted((r.length for r in placed), reverse=True):
        at = next((i for i, b in enumerate(bins) if b + n <= 64), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert len(by_sequence) <= len(bins)
    for r in sequences(packed, 64, pad_id=9).collect():
        n = sum(length for _, length in by_sequence[r.sequence_id])
        assert r.n_tokens == n and len(r.ids) == 4 * (n if n & (n - 1) == 0 else 64)
    assert pack(pieces.limit(0), 64).count() == 0
    sums = pieces.select("ids", F.crc32("ids").alias("c")).limit(5).collect()
    assert all(r.c == zlib.crc32(bytes(r.ids)) for r in sums)


def brute_repeats(texts, window):
    lists = [[] if t is None else t.encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window,gram,group_rows", [(5, 2, 5000), (5, 2, 1), (5, 5, 3), (1, 1, 2), (35, 8, 4)])
def test_without_repeats(spark, window, gram, group_rows):
    rng = random.Random(4)
    passage = " ".join(rng.choices("opqrst", k=50))
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "é"], k=rng.randint(0, 40))), "x") for i in range(40)]
    rows += [(100 + i, f"{i} start {passage}\tend\u00a0{i} \n", "x") for i in range(6)]
    rows += [(None, None, None), (None, "", None), (3, "a b c a b c a b c a b c", "z"), (3, "a b c a b c a b c a b c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    got = without_repeats(docs, window, gram, group_rows)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    found = sorted(((r.doc_id, r.text, r.k1, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=repr)
    assert found == sorted(((*r, *b) for r, b in zip(rows, brute_repeats([t for _, t, _ in rows], window))), key=repr)


def test_without_repeats_of_nothing(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
