"""Decontamination, fill-in-middle and collocations against brute force."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiongrid.llm import decontaminate, grams
from actiongrid.llm.collocations import Vocabulary, collocations, occurrences, portions
from actiongrid.llm.decontaminate import contamination, words_of
from actiongrid.llm.fill_middle import BlockTree, fill_in_middle, restored
from actiongrid.llm.queries import QUERIES

CLASH = "row long, n_words string, starts string, item string, set string, met string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_hits(docs, items, window):
    """(n_words, spans, items) of each text by trying every window of every item everywhere."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = {}
    for item, text in items:
        words = pattern.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            cut.setdefault(tuple(words[i:i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in cut}
    out = []
    for text in docs:
        words = pattern.findall(lower(text))
        hit, met = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in cut:
                    hit |= set(range(i, i + size))
                    met |= cut[tuple(words[i:i + size])]
        edges = sorted(hit)
        starts = [p for p in edges if p - 1 not in hit]
        ends = [p + 1 for p in edges if p + 1 not in hit]
        # windows that only touch are one span too, which positions cannot tell apart
        out.append((len(words), list(zip(starts, ends)), met))
    return out


def collected(found):
    met = {}
    for r in found.items.collect():
        met.setdefault(r.met, []).append(r.item)
    assert all(len(v) == len(set(v)) for v in met.values())
    return sorted(
        ((r.doc_id, r.n_words, [tuple(s) for s in r.spans], set(met.get(r.met, []))) for r in found.documents.collect()),
        key=repr,
    )


def test_words():
    assert words_of("A-bÉ éx1\x7f_Z9\n") == ["a".encode(), "bÉ".encode(), "éx1".encode(), b"z9"]


@pytest.mark.parametrize("window,gram", [(10, 5), (4, 4), (3, 1)])
def test_contamination(spark, window, gram, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 7)
    rng = random.Random(window)
    vocabulary = ["the", "of", "Alpha", "b", "c9", "été", "zz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 14)))) for i in range(30)]
    items += [(None, "of of the of zz b the the of c9 b"), (3, items[3][1]), (40, None), (41, ""), (42, ";"), (43, items[5][1])]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(7, None), (None, ""), (None, items[4][1]), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(100 + i, "zz " + items[i % 3][1] + " zz") for i in range(40)]
    rows = spark.createDataFrame([(*d, 1, *["n"] * 5) for d in docs], f"doc_id long, text string, {CLASH}")
    tests = spark.createDataFrame([(*t, "n") for t in items], "item_id long, text string, doc_id string")
    found = collected(contamination(rows.repartition(3), tests, window, gram))
    expect = sorted(((d[0], *e) for d, e in zip(docs, brute_hits([d[1] for d in docs], items, window))), key=repr)
    assert found == expect
    assert any(e[2] for e in expect) and any(not e[2] for e in expect)


def test_long_text_and_full_table(spark, monkeypatch):
    """One very long text between short ones; a bit table without room passes everything and stays right."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(20)]
    long = rng.choices(words, k=60_000)
    for i in range(0, 60_000, 9000):
        long[i:i + 12] = items[i // 9000][1].split()[5:17]
    docs = [(1, "w1 w2"), (2, " ".join(long)), (3, items[0][1])]
    monkeypatch.setattr(grams, "MOST_BITS", 7)
    found = collected(contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert found == sorted(((d[0], *e) for d, e in zip(docs, brute_hits([d[1] for d in docs], items, 10))), key=repr)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs.limit(0), items).documents.count() == 0
    none = contamination(docs, items.limit(0))
    assert [(r.n_words, r.n_hit, r.spans, r.met) for r in none.documents.collect()] == [(3, 0, [], None)]
    assert none.items.count() == 0
    with pytest.raises(ValueError):
        contamination(docs, items, 3, 4)


TEXTS = ["", "a", "é", "a b", " lead  word\ttwo\n", "\n\n", "x\ny\n", "\U0001f600éa " * 50, "tail ", "<P> no", "a<S", "<<M>", "\r\n\x0b x"]


@pytest.mark.parametrize("block", [1, 3, 64])
@pytest.mark.parametrize("unit", ["codepoint", "word", "line"])
def test_cuts(unit, block):
    for text in TEXTS:
        if unit == "codepoint":
            ends = list(range(len(text) + 1))
        elif unit == "line":
            ends = [0] + [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
        else:
            starts = [m.start() for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text)]
            ends = [0] + starts[1:] + [len(text)] if text else [0]
        tree = BlockTree(text.encode(), unit, block)
        assert tree.n == len(ends) - 1
        assert [tree.cut(k) for k in range(len(ends))] == [(len(text[:e].encode()), e) for e in ends]


def plain_form(doc_id, text, percent=90, spm=20):
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    text, n = text or "", len(text or "")
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(200)] + [(None, "some words"), (None, None), (5, "same"), (5, "same"), (9, "é" * 300_000)]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, output string, _h0 long")
    made = fill_in_middle(docs.repartition(3)).withColumn("back", restored())
    found = made.collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter(plain_form(*r) for r in rows)
    assert Counter((r.doc_id, r.back) for r in found) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    lines = fill_in_middle(docs, "line", 100, 50, "z", ("[a]", "[b]", "[c]"), 16)
    assert lines.withColumn("back", restored(sentinels=("[a]", "[b]", "[c]"))).where("back <> output AND form = 'plain'").count() == 0
    assert Counter(r.back for r in lines.withColumn("back", restored(sentinels=("[a]", "[b]", "[c]"))).collect()) == Counter(t or "" for _, t in rows)
    assert fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, "page")


def brute_collocations(rows, least, most, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i:i + k]))
                    counts[key] = counts.get(key, 0) + 1
    chosen = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in chosen.items():
        longer = [b for (other, q), b in chosen.items() if other == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def test_pieces():
    ((words, own),) = portions(["A b\tC.d e;; f\x0b\n\rg\x00h!", "i"], 2)
    assert words == b"a b c . d e . . f . . . g\x00h . . i .".split() and own == len(words)


@pytest.mark.parametrize("least,most,top,share", [(3, 4, 2000, 2000), (2, 3, 5, 3), (30, 4, 10, 7)])
def test_collocations(spark, monkeypatch, least, most, top, share):
    from actiongrid.llm import collocations as module

    monkeypatch.setattr(module, "SHARE", share)
    monkeypatch.setattr(module, "HELD", 50)
    monkeypatch.setattr(module, "WORDS", 20 if least == 2 else 400_000)
    monkeypatch.setattr(module, "BATCH", 3)
    rng = random.Random(most)
    words = ["new", "York", "city", "of", "the", "Éa", "a", "b ", "\x00q"]
    rows = [(rng.choice(["en", "fr", None, "und"]), rng.choice([" ", "\t", "  "]).join(rng.choices(words, [4, 4, 2, 3, 3, 1, 1, 1, 1], k=rng.randint(0, 40)))) for _ in range(60)]
    rows += [("en", "New York City. the new york city, of\nthe new york city!")] * 40 + [("en", None), (None, ""), ("de", "one two"), ("fr", "a " * 500)]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "lang string, text string, phrase string, total long").repartition(3)
    found = collocations(docs, least, most, top)
    assert sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_collocations(rows, least, most, top)
    assert collocations(docs.limit(0)).count() == 0


def test_score_past_64_bits(spark):
    """The score's product is wider than a long: exact arithmetic, no overflow error."""
    a, side = 5_000_000_000_000_007, 9_000_000_000_000_001
    expr = f"cast({a}L as decimal(20,0)) * 2000000 div (cast({side}L as decimal(20,0)) + cast({side}L as decimal(20,0)))"
    assert spark.range(1).select(F.expr(expr)).first()[0] == 2_000_000 * a // (2 * side)


def test_bit_table(spark):
    codes = np.random.default_rng(1).integers(0, 1 << 63, 5000)
    table = grams.bit_table(spark.createDataFrame([(int(c),) for c in codes], "code long"), "code")
    assert grams.may_hold(table, codes.astype(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert grams.may_hold(table, others).mean() < 0.02
    one = grams.Sieve(table)
    some = np.concatenate([codes[:200].astype(np.uint64), others[:2000]])
    assert [one.may_hold(int(c)) for c in some] == grams.may_hold(table, some).tolist()
    assert [one.mixed(int(c)) for c in some] == grams.mixed(some).tolist()


def test_contract_columns(spark, tmp_path):
    """Each wrapper's whole result on a small folder of its own."""
    rng = random.Random(3)
    words = ["red", "Green", "blue", "up", "down", "left"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80))), rng.choice(["en", None])) for i in range(120)] + [(500, None, "en"), (501, "", None)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 11)))) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits = QUERIES["op11_winnowing_decontamination"](spark, str(tmp_path)).collect()
    expect = {}
    for (i, _, _), (n, spans, met) in zip(docs, brute_hits([d[1] for d in docs], items, 10)):
        digest = sha256(",".join(sorted(met)).encode()).hexdigest()
        expect[i] = (i, n, sum(b - a for a, b in spans), len(met), digest, bool(spans))
    assert {r.doc_id: tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in hits} == expect
    made = {r.doc_id: r for r in QUERIES["op12_fill_in_middle"](spark, str(tmp_path)).collect()}
    for i, text, _ in docs:
        _, n, form, a, b, out = plain_form(i, text)
        digests = [sha256(t.encode()).hexdigest() for t in (out, text or "")]
        assert [made[i][c] for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")] == [n, form, a, b, *digests]
    found = QUERIES["op13_collocations"](spark, str(tmp_path))
    assert found.dtypes == [(c, "bigint") if c not in ("lang", "phrase") else (c, "string") for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    assert sorted(map(tuple, found.collect())) == brute_collocations([(d[2], d[1]) for d in docs], 30, 4, 2000)


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_portions_count_once(monkeypatch, size):
    """Wherever portions are cut, every prefix counts once, with the word behind it."""
    from actiongrid.llm import collocations as module

    monkeypatch.setattr(module, "TOGETHER", 7)
    rng = random.Random(size)
    texts = [rng.choice([" ", ". ", "  ,"]).join(rng.choices(["a", "bb", "C"], k=rng.randint(0, 60))) for _ in range(30)]
    known, found, expect = Vocabulary(), Counter(), Counter()
    table = np.full(1 << 10, ~np.uint64(0))  # everything passes
    for words, own in portions(texts, size):
        columns = occurrences(known.of(words), own, size, known.hashes, table, module._salt("en"))
        found.update(zip(*(c.tolist() for c in columns)))
    for text in texts:
        for piece in re.split("[.,]", text.lower()):
            ids = [*known.of([w.encode() for w in piece.split()]).tolist(), 0]
            expect.update(tuple(ids[i:i + size + 1]) for i in range(len(ids) - size) if size or ids[i])
    assert found == expect


@pytest.mark.parametrize("width", [1, 3, 4])
def test_folding(width):
    rows = np.random.default_rng(width).integers(0, 5, (1000, width))
    columns, counts = collocations_module()._folded([rows[:, i].astype(np.int64) for i in range(width)])
    assert dict(zip(zip(*(c.tolist() for c in columns)), counts.tolist())) == Counter(map(tuple, rows.tolist()))


def test_folding_of_large_numbers():
    rows = np.random.default_rng(7).integers((1 << 20) - 3, 1 << 20, (500, 4))
    columns, counts = collocations_module()._folded([rows[:, i].astype(np.int64) for i in range(4)])
    assert dict(zip(zip(*(c.tolist() for c in columns)), counts.tolist())) == Counter(map(tuple, rows.tolist()))


def test_blocks_of_collocations(spark, monkeypatch):
    """Blocks follow the size of the texts, not the number of shuffle partitions."""
    rng = random.Random(11)
    rows = [("en", " ".join(rng.choices([f"w{i}" for i in range(40)], k=200))) for _ in range(30)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).localCheckpoint()
    kind, made = type(docs), []
    plain = kind.mapInArrow

    def noted(self, *args, **kw):
        found = plain(self, *args, **kw)
        if "bucket" in found.columns:
            made.append(found)
        return found

    monkeypatch.setattr(kind, "mapInArrow", noted)
    blocks = []
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("2", "32"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            made.clear()
            collocations(docs, 5, 2, 10)
            blocks.append(sum(df.count() for df in made))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert 0 < blocks[1] <= blocks[0]


def test_counted_whatever_the_table_holds(spark):
    """Phrases that pass a bit table by chance, or share a hash, do not change a count."""
    rng = random.Random(12)
    rows = [(rng.choice(["en", "fr"]), " ".join(rng.choices(["a", "b", "c", "d."], k=rng.randint(0, 30)))) for _ in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    table = np.full(1 << 10, ~np.uint64(0))  # everything passes
    found = collocations_module().counted(docs, 3, 4, 5, table, None).collect()
    expect = Counter()
    for lang, text in rows:
        for piece in text.split("."):
            words = piece.split()
            expect[lang, "", 0] += len(words)
            expect.update((lang, " ".join(words[i:i + k]), k) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert {(r.lang, r.phrase, r.size): r.f for r in found} == {k: n for k, n in expect.items() if n >= 4 or not k[2]}
    assert len(found) == len({(r.lang, r.phrase) for r in found})


def collocations_module():
    from actiongrid.llm import collocations as module

    return module
