"""The pipeline stage by stage against brute force, and every query against its SQL twin."""

import os
import random

import pytest

import corpus_pipeline
from actiongrid.llm.bpe import Codec, vocabulary_path
from actiongrid.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    from test_dedup import plain_components, plain_fingerprint
    from test_tokens import brute_repeats

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    passage = " ".join(rng.choices(words, k=60))
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90)))) for i in range(50)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(9)]
    rows += [(200 + i, " ".join(rng.choices(words, k=30)) + " " + passage + f" tail{i}") for i in range(5)]
    rows += [(300, None), (301, ""), (302, "12 34"), (303, "one"), (304, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    expect = {i: t for i, t in rows if t and any(map(str.isalpha, t))}
    folder = "unused"
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["language_id"](spark, docs, folder).cache()
    assert {r.doc_id: r.text for r in docs.collect()} == expect
    docs = stages["exact_dedup"](spark, docs, folder).cache()
    expect = {i: t for i, t in expect.items() if i == max(j for j, u in expect.items() if u == t)}
    assert {r.doc_id: r.text for r in docs.collect()} == expect
    docs = stages["near_dedup"](spark, docs, folder).cache()
    ids = sorted(expect)
    root = plain_components([plain_fingerprint(expect[i]) for i in ids])
    expect = {i: expect[i] for n, i in enumerate(ids) if root[n] == n}
    assert {r.doc_id: r.text for r in docs.collect()} == expect
    docs = stages["substring_dedup"](spark, docs, folder).cache()
    found = brute_repeats(list(expect.values()), 35)
    expect = {i: k if gone else t for (i, t), (_, gone, k) in zip(expect.items(), found)}
    assert any(gone for _, gone, _ in found)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in expect.items()}
    book = Codec(vocabulary_path())
    got = {}
    for r in stages["packing"](spark, docs, folder).collect():
        assert r.offset + r.length <= 2048
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(book.encode([t])[0]) + 1 for i, t in expect.items()}


def test_language_id_without_labels(spark):
    rows = [(1, "some words"), (2, "12 34"), (3, ""), (4, None), (5, "é"), (5, "é")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, docs, "unused").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in kept) == [(1, "some words", None), (5, "é", None), (5, "é", None)]


def test_stages_with_clashing_columns(spark):
    """Columns named like those the stages add, null and repeated ids: all columns come out as they went in."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"start {passage} end", "en", 1, "x"), (None, f"begin {passage} stop", "en", 2, "y"), (1, "one more text", None, 3, "z"), (None, None, "en", 4, "n")]
    docs = spark.createDataFrame([(*r, *["k"] * 5) for r in rows], "doc_id long, text string, lang string, n_removed int, kept string, "
                                 "n_words string, component_id string, fingerprint string, lang_pred string, n_chars string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "unused")
        assert docs.columns[:4] == ["doc_id", "text", "lang", "n_removed"] and len(docs.columns) == 10, name
    found = sorted((r.n_removed, r.kept, r.text, r.doc_id) for r in docs.collect())
    assert found == [(1, "x", "start end", 1), (2, "y", "begin stop", None), (3, "z", "one more text", 1)]
    assert corpus_pipeline.packing(spark, docs, "unused").count() == 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and len({(r.doc_id, r.start) for r in rows}) == len(rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_every_query(spark):
    from workload.check import compare, connection

    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in QUERIES) != 1] == []
    con = connection(FOLDER)
    for name, function in QUERIES.items():
        problem, rows = compare(spark, con, name, function, ORACLES.get(name), FOLDER)
        assert problem is None and rows > 0, name
