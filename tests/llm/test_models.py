"""Trained operators against brute force and held-out rows."""

import inspect
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from actiongrid.llm import ann, language, pitman_yor, toxicity, url_filter
from actiongrid.llm.ann import search

FOLDER = "/root/testdata/sf0.01"
EDGES = [(None, None), (-1, ""), (-2, " \n"), (-3, "123 !?"), (-4, "z" * 20_000), (-5, "z"), (-5, "z")]


def brute_length(counts, order, text, lang):
    own = {(d, c): n for d, c, n in counts[counts.lang == lang][["depth", "code", "n"]].itertuples(index=False)}
    nodes = {}
    for (d, c), n in own.items():
        node = nodes.setdefault((d, c >> 8), [0, 0])
        node[0] += n
        node[1] += 1
    data = [32] * order + list(b" ".join(text.lower().encode().split()))
    bits = 0.0
    for i in range(order, len(data)):
        p = 1 / 256
        chain = []
        for d in range(order, -1, -1):
            context = int.from_bytes(bytes(data[i - d:i]), "big")
            if (d, context) not in nodes:
                continue
            n, kinds = nodes[d, context]
            seen = own.get((d, context << 8 | data[i]))
            chain.append(seen / (n + kinds) if seen else kinds / (n + kinds))
            if seen:
                p = 1
                break
        bits -= math.log2(p * math.prod(chain))
    return bits


@pytest.mark.parametrize("order", [1, 3])
def test_code_lengths(order):
    rows = pd.DataFrame({"lang": ["a", "a", "b"], "text": ["the cat sat on  the mat", "The hat", "der Hut und die Katze ß"]})
    counts = pd.concat(language._counts(order)([rows])).groupby(["lang", "depth", "code"], as_index=False)["n"].sum()
    model = language.Model(counts, order)
    texts = ["the dog", "", "ßß漢", "die hat " * 50, "q"]
    for together in (7, 1 << 20):
        got = model.lengths(texts, together)
        for text, row in zip(texts, got):
            assert np.allclose(row, [brute_length(counts, order, text, x) for x in model.langs], rtol=1e-4)


def test_language_rows(spark):
    train = [(i, "the cat and the dog %d" % i, "en") for i in range(30)] + [(i, "der Hund und die Katze", "de") for i in range(30, 60)]
    docs = spark.createDataFrame([*train, (90, None, "en"), (91, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=20)
    asked = spark.createDataFrame([*EDGES, (1, "the dog"), (2, "die Katze und")], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred) for r in language.classify(asked, model).collect()}
    assert {(None, "und"), (-1, "und"), (-2, "und"), (-3, "und"), (1, "en"), (2, "de")} <= got
    assert all(0 <= r.score <= 1 for r in language.classify(asked, model).collect())
    assert language.classify(asked.limit(0), model).count() == 0
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.classify(asked, None).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_language_held_out(spark):
    from actiongrid.llm.language import op8_ppm_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = [r for r in op8_ppm_language_id(spark, FOLDER).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.97


def brute_rule(url):
    head, mark, rest = (url or "").partition("://")
    host = path = ""
    if mark:
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.ORG/es/1?x=1", "http://example.org/en/12#t", "http://a.example.com/de/9",
        "http://a.example.com/fr/9", "http://org", "http://org/", "http://xorg/", "http://x.net?q=/org/", "ftp://com#/fr/", "a://b://c/d",
        "http://example.org/ES/1", "http://ÀB.org/x", "http://a.org\n/x"]


def test_urls(spark):
    rng = random.Random(2)
    urls = URLS + [f"http://{rng.choice('abc')}.{rng.choice(['example.com', 'example.org', 'x.net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h")], "page_id long, url string, host string")
    rows = url_filter.judge(pages, url_filter.RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.p_block >= 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("url is null"), url_filter.RULES).collect()} == {"allow"}


def test_trees_learn():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 3] > 0)).astype(float)
    trees = url_filter.Trees(x[:3000], y[:3000])
    assert ((trees.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85


def test_search(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(900, 24)) * rng.uniform(0.1, 3, size=(900, 1))
    vectors[50:90] = vectors[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    bad = [(1000, None, 1), (1020, [0.0] * 24, 1), (1040, [1.0] * 23 + [None], 1), (1060, [math.nan] * 24, 1), (1080, [math.inf] * 24, 1),
           (None, [1.0] * 24, 1), (1100, [], 1), (1120, [1.0], 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    got = search(table, table.where("vec_id % 20 = 0"), 20, block_rows=128, query_rows=16).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 20))
    hits = 0
    for q, rows_ in found.items():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21))
        exact = {i: float((vectors[q] * vectors[i]).sum()) for i in range(900) if i != q}
        assert all(s == exact[i] for _, i, s in rows_)
        assert [i for _, i, _ in rows_] == sorted((i for _, i, _ in rows_), key=lambda i: (-exact[i], i))
        hits += len({i for _, i, _ in rows_} & set(sorted(exact, key=lambda i: (-exact[i], i))[:20]))
    assert hits / (20 * len(found)) >= 0.97
    other = [(2000 + i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(14, 12)))]
    short = spark.createDataFrame(other, "vec_id long, embedding array<double>, rank int")
    mixed = search(table.where("vec_id < 200").unionByName(short), short.unionByName(table.where("vec_id < 10")), 20).collect()
    assert Counter(r.query_id for r in mixed) == Counter({**{2000 + i: 13 for i in range(14)}, **{i: 20 for i in range(10)}})
    assert all((r.query_id >= 2000) == (r.vec_id >= 2000) for r in mixed)
    few = search(table.where("vec_id < 5"), table.where("vec_id = 0"), 20).collect()
    assert len(few) == 4
    assert search(table.limit(0), table.limit(0)).count() == 0


def test_few_pairs_are_summed_by_component(monkeypatch):
    """Of scattered vectors most reach the bound; only about k of a query go on to the final sums."""
    vectors = np.random.default_rng(1).normal(size=(2000, 64))
    taken, given = [], ann.sums
    monkeypatch.setattr(ann, "sums", lambda *x: taken.append(len(x[2])) or given(*x))
    got = ann.nearest(np.arange(100), vectors[:100], np.arange(2000), vectors, *ann.encode(vectors, 128), 20, 2.5)
    assert len(got) == 2000 and sum(taken) <= 2100
    assert (got["score"].to_numpy() == (vectors[got["query_id"]] * vectors[got["vec_id"]]).sum(axis=1)).all()


def toxic_rows(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 80))
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(["zorgle", "Blint,"])
        rows.append((i, " ".join(text), "xy"[i % 2], int(i % 4 == 0)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(900, 1)
    docs = spark.createDataFrame([(*r[:3], 5) for r in rows] + [(i, t, None, 5) for i, t in EDGES], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i % 5] + [(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = {}
    for r in toxicity.classify(docs, net).collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        got[r.doc_id] = r.predicted
    assert len(got) == len(rows) + len({i for i, _ in EDGES})
    held = [i for i in range(900) if i % 5 == 0]
    assert np.mean([got[i] == (i % 4 == 0) for i in held]) > 0.95
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.classify(docs, None).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), net).count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """More toxic rows than were drawn once, in several blocks; every row trains or calibrates."""
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 1500)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=5)) + (" zorgle" if i % 2 else ""), "xy"[i % 3 == 0], i % 2) for i in range(5600)] + [(5600, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen, given = [], toxicity.Net.start_table
    monkeypatch.setattr(toxicity.Net, "start_table", lambda net, cells, n: seen.append((cells.copy(), n.copy())) or given(net, cells, n))
    cuts, best = [], toxicity.best_cuts
    monkeypatch.setattr(toxicity, "best_cuts", lambda scored: cuts.append(scored.where("lang = -1").count()) or best(scored))
    net = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), epochs=2)
    (held, of_label), zorgle = seen[0], toxicity.cells("zorgle")[0]
    assert of_label.sum() + cuts[0] == len(rows) and of_label[1] > 2000
    assert held[1, zorgle] == of_label[1] and net.langs == ["x", "y"]
    got = toxicity.classify(docs, net).join(docs, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.99


def test_best_cuts(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(12) / 4, int(rng.random() < 0.3)) for k in (0, 1, 2) for _ in range(40)] + [(3, 0.5, 0), (3, 2.0, 0), (4, 1.0, 1)]
    got = toxicity.best_cuts(spark.createDataFrame(rows, "lang int, logit double, toxic int"))
    for lang in range(5):
        own = [(x, y) for k, x, y in rows if k == lang]
        levels, hits = sorted({x for x, _ in own}, reverse=True), sum(y for _, y in own)
        f1 = [2 * sum(y for x, y in own if x >= level) / (sum(x >= level for x, _ in own) + hits) for level in levels]
        at = f1.index(max(f1))
        cut = (levels[at] + levels[at + 1]) / 2 if at + 1 < len(levels) else levels[at] - 0.5
        assert got[lang] == (hits, cut if hits else levels[0] + 1)


def test_long_texts_teach(monkeypatch):
    """A text in parts pulls the same table rows as in one."""
    rng = np.random.default_rng(0)
    docs = [rng.integers(1, 60_000, n).astype(np.int32) for n in (40, 3, 0, 17)]
    whole = toxicity.Net().pooled(docs, where=True)
    monkeypatch.setattr(toxicity, "PART", 5)
    parts = toxicity.Net().pooled(docs, where=True)
    assert np.allclose(whole[0], parts[0], atol=1e-5)
    for a, b in zip(whole[1], parts[1]):
        assert (a[:2] == b[:2]).all() and (a[3] == b[3]).all()


def test_long_texts_go_in_parts(monkeypatch):
    net = toxicity.Net()
    docs = [toxicity.cells(" ".join(map(str, range(n)))) for n in (0, 1, 7, 50)]
    whole = net.logits(docs)
    monkeypatch.setattr(toxicity, "PART", 5)
    assert np.allclose(net.logits(docs), whole, atol=1e-5)


def test_seats():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 2, 5, 64, 1000, 100_000])
    tables = pitman_yor.seat(counts, np.full(7, 0.5), 0.5, rng)
    assert (tables <= counts).all() and (tables[counts > 0] >= 1).all()
    # without new mass a dish keeps its one table; with a huge one everybody sits alone
    assert pitman_yor.seat(counts, np.zeros(7), 0.5, rng).tolist() == [0, 1, 1, 1, 1, 1, 1]
    assert (pitman_yor.seat(counts, np.full(7, 1e12), 0.5, rng) == counts).all()


def seatings(customers):
    """All ways to seat customers, as lists of table sizes."""
    if not customers:
        yield []
        return
    for sizes in seatings(customers - 1):
        yield [*sizes, 1]
        for i in range(len(sizes)):
            yield [*sizes[:i], sizes[i] + 1, *sizes[i + 1:]]


@pytest.mark.parametrize("discount,mass", [(0.8, 0.1), (0.5, 1.0), (0.2, 3.0), (0.8, 10.0)])
def test_tables_follow_their_conditional_distribution(discount, mass):
    """Against all seatings of up to 8 customers, and against the recursion for more."""
    rng = np.random.default_rng(1)
    for c in range(1, 9):
        weight = np.zeros(c + 1)
        for sizes in seatings(c):
            weight[len(sizes)] += mass ** len(sizes) * math.prod(math.gamma(n - discount) / math.gamma(1 - discount) for n in sizes)
        drawn = np.bincount(pitman_yor.seat(np.full(20_000, c), np.full(20_000, mass), discount, rng), minlength=c + 1) / 20_000
        assert np.abs(drawn - weight / weight.sum()).max() < 0.02
    logs = pitman_yor.partition_weights(600, discount)
    for c in (12, 60, 200, 513, 600):
        t = np.arange(1, c + 1)
        p = np.exp(logs[c, 1:c + 1] + t * math.log(mass) - (logs[c, 1:c + 1] + t * math.log(mass)).max())
        p /= p.sum()
        mean, deviation = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
        tables = pitman_yor.seat(np.full(20_000, c), np.full(20_000, mass), discount, rng)
        near = c <= pitman_yor.SINGLE
        assert abs(tables.mean() / mean - 1) < (0.02 if near else 0.05)
        assert abs(tables.std() - deviation) < 0.05 * deviation + 0.02


def last_weights(customers, tables, discount):
    """log weights of up to `tables` tables, by the recursion over customers."""
    row, t = np.full(tables + 1, -np.inf), np.arange(tables + 1)
    row[0] = 0
    with np.errstate(divide="ignore"):
        for c in range(customers):
            stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + row
            row = np.logaddexp(stay, np.concatenate([[-np.inf], row[:-1]]))
    return row[1:]


@pytest.mark.parametrize("discount", [0.05, 0.8, 0.95])
def test_tables_of_many_customers_are_exact(discount, monkeypatch):
    """The whole distribution beside the recursion: few tables, many, nearly one a customer."""
    seen, given = [], pitman_yor.further_tables
    monkeypatch.setattr(pitman_yor, "further_tables", lambda *x: seen.append((x[3], given(*x))) or seen[-1][1])
    for customers, most, masses in [(513, 513, [0, 0.1, 10, 1e3, 1e4, 1e12]), (1000, 1000, [1, 300, 1e5]), (5000, 200, [1e-3, 5, 30 * discount + 5])]:
        logs = last_weights(customers, most, discount)
        for mass in masses:
            p = logs + np.arange(most) * math.log(max(mass, 1e-300))
            p = np.exp(p - p.max())
            pitman_yor.seat(np.array([customers]), np.array([mass]), discount, np.random.default_rng(0))
            (first, weights), got = seen[-1], np.zeros(most)
            part = weights[0][:most - first[0]]
            got[first[0]:first[0] + len(part)] = part / weights.sum()
            assert np.abs(got - p / p.sum()).max() < 1e-7
    counts = np.array([600, 10**6, 10**9])
    for mass in (0.0, 1.0, 1e5, 1e9):
        tables = pitman_yor.seat(counts, np.full(3, mass), discount, np.random.default_rng(0))
        assert (tables >= 1).all() and (tables <= counts).all()


def test_tokens():
    batch = ["", " \n", "Ab  c\td\x0b", "é", "x" * 50 + " \x1cy\x85", "\ud800 z"]
    ids, contexts, at = pitman_yor.tokens(batch)
    words = [w for t in batch for w in [*t.encode("utf-8", "surrogatepass").lower().split(), b""]]
    assert ids.tolist() == [pitman_yor.xxhash.xxh64_intdigest(w, 17) >> 8 for w in words]
    assert bytes(contexts) == (b" " + b"".join(w[-1:] or b" " for w in words))[:-1]
    assert np.diff(at).tolist() == [len(t.encode("utf-8", "surrogatepass").split()) + 1 for t in batch]
    assert at[0] == 0 and pitman_yor.tokens([])[2].tolist() == [0]


def test_rows_of_a_hot_word_are_folded():
    import pyarrow as pa

    codes = np.sort(np.random.default_rng(0).integers(0, 3, 50_000).astype(np.uint64) | np.uint64(7 << 8))
    batches = [pa.RecordBatch.from_arrays([pa.array(codes[i:i + 500].view(np.int64)), pa.array(np.ones(len(codes[i:i + 500]), np.int64))], ["code", "n"])
               for i in range(0, len(codes), 500)]
    ((kinds, n),) = pitman_yor._by_word(batches)
    assert len(kinds) <= 6 and n.sum() == len(codes)


def test_pitman_yor_sweeps():
    """Three rounds and a last pass of two burnt sweeps each, four more kept: 12 a word."""
    given = {k: v.default for k, v in inspect.signature(pitman_yor.fit).parameters.items()}
    assert (given["rounds"], given["burn"], given["keep"]) == (3, 2, 4)


def test_pitman_yor(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(60)]
    pairs = [(i, " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(0, 30))).title()) for i in range(150)]
    pairs += [(i, t) for i, t in EDGES if i != -4] + [(-4, "never seen words " * 50)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in pairs], "doc_id long, text string, score double")
    train = [t or "" for i, t in pairs if i is None or i >= 0]
    model, totals = pitman_yor.fit(docs.where("doc_id is null or doc_id >= 0"))
    lists = [[*t.encode().lower().split(), b""] for t in train]
    counts = Counter(w for x in lists for w in x)
    n, v = sum(counts.values()), len(counts)
    assert (totals.tokens, totals.words) == (n, v)
    for block_bytes in (1 << 24, 200):
        rows = {}
        for r in pitman_yor.score(docs, model, totals, block_bytes=block_bytes).collect():
            rows.setdefault(r.doc_id, []).append(r)
        assert sum(map(len, rows.values())) == len(pairs)
        for i, t in pairs:
            mine = [*(t or "").encode().lower().split(), b""]
            r = rows[i][0]
            assert (r.n_tokens, r.n_known) == (len(mine), sum(w in counts for w in mine))
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in mine), rel_tol=1e-9)
            assert r.score < 0
    # in every context, the known words and the unknown one share all of the probability
    held = model.collect()
    passed = totals.pass_on()
    for context in (32, ord("a"), ord("b"), 200):
        total = passed[context] * totals.parent(0, 0)
        for r in held:
            shares = np.frombuffer(bytes(r.shares), np.float32)[np.frombuffer(bytes(r.contexts), np.uint8) == context].sum()
            total += shares + passed[context] * r.parent
        assert abs(total - 1) < 0.05
    assert pitman_yor.score(docs.limit(0), model, totals).count() == 0
    nothing, zero = pitman_yor.fit(docs.limit(0))
    assert all(r.n_known == 0 for r in pitman_yor.score(docs, nothing, zero).collect())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_pitman_yor_held_out(spark):
    rows = [r for r in pitman_yor.op1_pitman_yor(spark, FOLDER).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.1
