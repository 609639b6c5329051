"""Exact and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from actiongrid.llm.common import components
from actiongrid.llm.exact_dedup import directory, exact_duplicates, unique_rows
from actiongrid.llm.simhash import fingerprint, links, near_duplicates, representatives, walk

SCHEMA = "doc_id long, text string, _text string, _key long, kept string"


def rows_of(pairs):
    return [(i, t, "x", 1, "y") for i, t in pairs]


PAIRS = [(i, f"text {i % 7} " + "w" * (i % 3)) for i in range(40)] + [
    (100, None), (101, ""), (None, ""), (None, None), (7, "twice"), (7, "twice"), (8, "x" * 5000), (9, "x" * 5000), (200, "only"),
]


def expected(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stayed = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not stayed, hashlib.sha256(text.encode()).hexdigest()))
            stayed |= i == keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_bytes,bits", [(1 << 20, 64), (200, 64), (200, 3), (1, 2)])
def test_exact_duplicates(spark, bucket_bytes, bits):
    docs = spark.createDataFrame(rows_of(PAIRS), SCHEMA)
    found = exact_duplicates(docs, bucket_bytes=bucket_bytes, max_depth=6, hash_bits=bits)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()]
    assert sorted(got, key=repr) == expected(PAIRS)
    stayed = unique_rows(docs, bucket_bytes=bucket_bytes, max_depth=6, hash_bits=bits)
    assert stayed.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in stayed.collect()), key=repr) == sorted(
        {(max((i for i, u in PAIRS if (u or "") == (t or "") and i is not None), default=None), t or "") for _, t in PAIRS}, key=repr)


def test_exact_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(docs).count() == 0
    assert unique_rows(docs).count() == 0


def test_directory_splits_only_full_buckets(spark):
    keys = spark.createDataFrame([((i << 60) - (1 << 63), 10) for i in range(16)] + [(5, 100)], "_key long, load long")
    slots = {r.slot: (r.depth, r.bucket) for r in directory(keys, 40, 8).collect()}
    for slot, (depth, bucket) in slots.items():
        same = [s for s in slots if s >> (8 - depth) == slot >> (8 - depth)]
        assert {slots[s] for s in same} == {(depth, bucket)}


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))
    while True:
        new = [min(root[j] for j in range(len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 4) for i in range(len(prints))]
        if new == root:
            return root
        root = new


def test_fingerprint():
    for text in ("", " \t", "a", "A b C", "one two three four five six seven", "É é ß " * 9, "a\u2003b c\x1fd e f"):
        assert fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("node_rows", [100_000, 3])
def test_near_duplicates(spark, node_rows):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    base = [rng.choices(words, k=120) for _ in range(12)]
    pairs = [(None, None), (500, ""), (501, " \n"), (3, "tie tie"), (3, "tie tie")]
    for i in range(60):
        text = list(base[i % 12])
        for _ in range(i // 12):
            text[rng.randrange(120)] = rng.choice(words)
        pairs.append((1000 + i, " ".join(text)))
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs, node_rows=node_rows).collect()), key=repr)
    prints = [plain_fingerprint(t or "") for _, t in pairs]
    root = plain_components(prints)
    least = {r: min((i for (i, _), q in zip(pairs, root) if q == r and i is not None), default=None) for r in root}
    assert got == sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(pairs, prints, root)), key=repr)
    stayed = [r.doc_id for r in representatives(docs, node_rows=node_rows).collect()]
    assert sorted(stayed) == sorted({least[r] for r in root})
    assert len(set(root)) < len(pairs) - 3


@pytest.mark.parametrize("node_rows,blocks", [(2, 6), (2, 5), (100_000, 8)])
def test_links_reach_what_all_pairs_reach(spark, node_rows, blocks):
    rng = np.random.default_rng(1)
    prints = np.repeat(rng.integers(0, 1 << 63, 6), 25)
    for _ in range(3):
        prints = prints ^ (np.int64(1) << rng.integers(0, 64, len(prints)))
    prints = np.unique(np.concatenate([prints, rng.integers(0, 1 << 63, 40)]))
    points = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    found = {r.node: r.root for r in components(links(points, 4, blocks, node_rows)).collect()}
    unsigned = [int(p) & (1 << 64) - 1 for p in prints]
    root = plain_components(unsigned)
    for i, p in enumerate(prints):
        same = {int(q) for q, r in zip(prints, root) if r == root[i]}
        assert {int(q) for q in prints if found.get(int(q), int(q)) == found.get(int(p), int(p))} == same


def test_walk_of_two_nodes():
    codes = np.array([0b0001, 0b0011, (1 << 63) | 0b0001, (1 << 63) | 0xFFFF], np.uint64)
    root = tuple(np.array([x]) for x in (0, 2, 2, 4, 1, 1))
    assert walk(codes, root, 4).tolist() == [0, 0, 0, 3]


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0
    assert representatives(docs).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(30)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys((1, 2, 3, 9), 1), **dict.fromkeys((20, 21), 20), **dict.fromkeys(range(100, 131), 100)}
