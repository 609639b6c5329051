"""Phrase collocations from counted hashes.

Phrases grow by one word a pass, from single words. A phrase can only reach `least` occurrences if
both its parts without the first or last word do; these are put into a bounded bit table
(`grams.bit_table`), and only phrases whose parts it holds are counted in the next pass. A pass
counts 64-bit hashes: tasks fold theirs by sorting and emit one block for each bucket (a range of
hashes), and a bucket's blocks are merged in arrays. Phrases that share a hash share its count, so
no phrase of `least` occurrences is missed, and only hashes of `least` occurrences leave a pass.

A last pass counts phrases by their words, exactly: those whose hashes are in the table of all
lengths. The table may let rarer phrases pass; the counts decide. The number of buckets follows
from the length of the texts, so a bucket has about as many entries in a large table as in a small one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import arrow_runs
from .common import query, stored, table
from .grams import Sieve, bit_table, may_hold, mixed

#: Occurrences that a task holds before it folds and emits them, and words that it numbers.
HELD = 3_000_000
WORDS = 400_000
#: Bits of a word's number in the key of an occurrence.
BITS = 20
#: The number of all words that are not frequent, and how many of them are remembered as such.
RARE, RARE_WORDS = 1, 200_000
#: Words looked at in one go.
TOGETHER = 100_000
#: Blocks of an Arrow batch.
BATCH = 256
#: Kilobytes of text for each bucket of a merge.
SHARE = 8000

#: The end of a piece, a byte that no word has.
END = b"."
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))


def portions(texts: list[str], size: int):
    """(words, how many of them begin prefixes) of the texts in portions of about TOGETHER words.

    Words are ended by spaces and tabs, A-Z lowered; END stands behind each piece, and `.,;:!?`
    and line ends part pieces. A portion ends with the `size` words that the next begins with.
    """
    raw = b".".join([t.encode("utf-8", "surrogatepass") for t in texts]).translate(_LETTERS)
    words: list[bytes] = []
    at, step = 0, 8 * TOGETHER
    while at < len(raw):
        end = at + step
        while end < len(raw) and raw[end] not in b" .":
            end += 1
        words += raw[at:end].replace(b".", b" . ").split()
        at = end
        if len(words) > TOGETHER and at < len(raw):
            yield words, len(words) - size
            words = words[len(words) - size:]
    words.append(END)
    yield words, len(words)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 9))


class Vocabulary(dict):
    """Numbers of the words of a language as they come, with their hashes. 0 is a piece's end.

    With a sieve of frequent words all others are the word of number RARE, and forgotten again.
    """

    def __init__(self, frequent: np.ndarray | None = None, salt: int = 0):
        super().__init__({END: 0})
        self.sieve = None if frequent is None else Sieve(frequent)
        self.salt, self.forgettable = int(salt), 0
        self.words = [b"", b""]
        self.hashes = np.zeros(1 << 10, np.uint64)

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word, 5)
        if self.sieve is not None and not self.sieve.may_hold(self.sieve.mixed(self.sieve.mixed(code) ^ self.salt)):
            self.forgettable += 1
            if self.forgettable > RARE_WORDS:
                self.clear()
                self.update(zip(self.words[2:], range(2, len(self.words))))
                self[END], self.forgettable = 0, 0
            self[word] = RARE
            return RARE
        number = self[word] = len(self.words)
        self.words.append(word)
        if number == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(number, np.uint64)])
        self.hashes[number] = code
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def occurrences(ids: np.ndarray, own: int, size: int, hashes: np.ndarray, sieve: np.ndarray, salt: np.uint64) -> list[np.ndarray]:
    """Columns (prefix words, next word) of the prefixes of `size` words that begin with one of
    the first `own` ids; 0 ends pieces.

    Prefixes that are not frequent are left out. Where the words behind the first of a prefix are
    not frequent, or the piece ends, the next word is 0.
    """
    if not size:
        return [ids[ids > 0]]
    places = max(len(ids) - size + 1, 0)
    whole = ids[:places] > RARE
    for i in range(1, size):
        whole &= ids[i:places + i] > RARE
    at = np.flatnonzero(whole)
    code = np.zeros(len(at), np.uint64)
    for i in range(size):
        code = mixed(code ^ hashes[ids[at + i]])
    at = at[may_hold(sieve, mixed(code ^ salt))]
    frequent = np.zeros(len(ids) + 1, bool)
    frequent[at] = True
    at = at[at < own]
    following = np.append(ids, np.zeros(size, np.int64))[at + size]
    following[following == RARE] = 0
    return [*(ids[at + i] for i in range(size)), np.where(frequent[at + 1], following, 0)]


def _keys(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """One number for each row of word numbers, if they fit."""
    key = columns[0]
    for column in columns[1:]:
        key = key << bits | column
    return key


def _folded(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct rows in order, how often each occurs)."""
    if len(columns) * BITS <= 63:
        key = np.sort(_keys(columns, BITS))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        counts = np.diff(np.append(first, len(key)))
        key, out = key[first], []
        for _ in columns:
            out.append(key & ((1 << BITS) - 1))
            key = key >> BITS
        return out[::-1], counts
    if len(columns) == 4:  # the first two become one number
        pairs, pair = np.unique(_keys(columns[:2], BITS), return_inverse=True)
        if len(pairs) < 1 << 63 - 2 * BITS:
            key = np.sort(_keys([pair, *columns[2:]], BITS))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            counts = np.diff(np.append(first, len(key)))
            key, low = key[first], (1 << BITS) - 1
            pair = pairs[key >> 2 * BITS]
            return [pair >> BITS, pair & low, key >> BITS & low, key & low], counts
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    turn = np.zeros(len(order), bool)
    turn[:1] = True
    for column in columns:
        turn[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(turn)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _codes(columns: list[np.ndarray], hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    """The hash of each row's words, in its language."""
    code = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        code = mixed(code ^ hashes[column])
    return mixed(code ^ salt)


def _phrases(ids: np.ndarray, own: int, size: int, hashes: np.ndarray, sieve: np.ndarray, salt: np.uint64) -> list[np.ndarray]:
    """Columns of the words of phrases of `size` words whose parts are frequent."""
    columns = occurrences(ids, own, size - 1, hashes, sieve, salt)
    whole = columns[-1] > RARE
    return [c[whole] for c in columns]


def _homes(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; a bucket is a range of hashes."""
    return ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _edges(sorted_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[:len(sorted_)]), len(sorted_))


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of each run of values."""
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _sliced(batch: pa.RecordBatch):
    for low in range(0, len(batch), BATCH):
        yield batch.slice(low, BATCH)


def _read(rows: pa.RecordBatch, run_texts: list[str], size: int, known: dict[str, Vocabulary], frequent):
    """(lang, its vocabulary, ids of a portion, how many of them begin phrases) of a run of texts."""
    by_lang: dict[str, list] = {}
    for lang, text in zip(rows.column(0).to_pylist(), run_texts):
        by_lang.setdefault(lang, []).append(text)
    for lang, texts in by_lang.items():
        own = known.get(lang)
        if own is None:
            own = known[lang] = Vocabulary(frequent, _salt(lang))
        for words, first in portions(texts, size - 1):
            yield lang, own, own.of(words), first


def _full(known: dict[str, Vocabulary]) -> bool:
    return sum(len(v.words) for v in known.values()) > WORDS


def frequent_codes(rows: DataFrame, size: int, least: int, buckets: int, bits, words) -> DataFrame:
    """(code) of all phrases of `size` words with `least` occurrences, and of no hash with fewer.

    A block has the hashes of a task that belong to one bucket, sorted, and their counts, as bytes.
    """
    sieve, frequent = (rows.sparkSession.sparkContext.broadcast(x) for x in (bits, words))

    def emitted(held):
        codes = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        turns = _edges(codes)
        codes, counts = codes[turns[:-1]], np.diff(turns).astype(np.uint32)
        home = _homes(codes, buckets)
        edges = _edges(home)
        yield from _sliced(pa.RecordBatch.from_arrays(
            [pa.array(home[edges[:-1]]), _packed(codes, edges), _packed(counts, edges)], ["bucket", "codes", "counts"]))

    def run(batches):
        known: dict[str, Vocabulary] = {}
        held, n = [], 0
        for part in arrow_runs(batches):
            for lang, own, ids, first in _read(*part, size, known, frequent.value):
                salt = _salt(lang)
                held.append(_codes(_phrases(ids, first, size, own.hashes, sieve.value, salt), own.hashes, salt))
                n += len(held[-1])
                if n > HELD:
                    yield from emitted(held)
                    held, n = [], 0
            if _full(known):
                known = {}
        yield from emitted(held)

    def merged(blocks):
        codes, counts = _unpacked(blocks.column("codes"), np.uint64), _unpacked(blocks.column("counts"), np.uint32)
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(np.int64)
        first = _edges(codes)[:-1]
        codes = codes[first][np.add.reduceat(counts, first) >= least]
        return pa.table([pa.array(codes.view(np.int64))], ["code"])

    blocks = rows.mapInArrow(run, "bucket int, codes binary, counts binary")
    return blocks.groupBy("bucket").applyInArrow(merged, "code long")


def counted(rows: DataFrame, most_words: int, least: int, buckets: int, bits, words) -> DataFrame:
    """(lang, phrase, size, f) of the phrases of 1 to `most_words` words with f >= least, counted by
    their words; the empty phrase of size 0 counts all words of its language.

    A block has the phrases of a task and a language that belong to one bucket, one a line (no word
    has a line end), and their counts as bytes.
    """
    sieve, frequent = (rows.sparkSession.sparkContext.broadcast(x) for x in (bits, words))

    def emitted(held, known, n_words):
        for lang, by_size in held.items():
            own, salt = known[lang], _salt(lang)
            words = pa.array(own.words, pa.binary())
            phrases, counts, codes = [pa.array([b""], pa.binary())], [[n_words[lang]]], [[salt]]
            for found in by_size.values():
                columns, often = _folded([np.concatenate(c).astype(np.int64) for c in zip(*found)])
                text = words.take(pa.array(columns[0]))
                for column in columns[1:]:
                    text = pc.binary_join_element_wise(text, words.take(pa.array(column)), pa.scalar(b" ", pa.binary()))
                phrases.append(text)
                counts.append(often)
                codes.append(_codes(columns, own.hashes, salt))
            home = _homes(np.concatenate(codes), buckets)
            order = np.argsort(home, kind="stable")
            edges = _edges(home[order])
            lines = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.concat_arrays(phrases).take(pa.array(order)))
            block = pc.binary_join(lines, pa.scalar(b"\n", pa.binary())).cast(pa.string())
            yield from _sliced(pa.RecordBatch.from_arrays(
                [pa.array(home[order][edges[:-1]]), pa.array([lang] * len(block), pa.string()), block,
                 _packed(np.concatenate(counts).astype(np.int64)[order], edges)], ["bucket", "lang", "block", "counts"]))

    def run(batches):
        known: dict[str, Vocabulary] = {}
        held, n_words, n = {}, {}, 0
        for part in arrow_runs(batches):
            for lang, own, ids, first in _read(*part, most_words, known, frequent.value):
                salt, by_size = _salt(lang), held.setdefault(lang, {})
                n_words[lang] = n_words.get(lang, 0) + int(np.count_nonzero(ids[:first]))
                for size in range(1, most_words + 1):
                    columns = _phrases(ids[:first] if size == 1 else ids, first, size, own.hashes, sieve.value, salt)
                    if size > 1:
                        kept = may_hold(sieve.value, _codes(columns, own.hashes, salt))
                        columns = [c[kept] for c in columns]
                    by_size.setdefault(size, []).append([c.astype(np.int32) for c in columns])
                    n += len(columns[0])
                if n > 2 * HELD:
                    yield from emitted(held, known, n_words)
                    held, n_words, n = {}, {}, 0
            if _full(known):
                yield from emitted(held, known, n_words)
                known, held, n_words, n = {}, {}, {}, 0
        yield from emitted(held, known, n_words)

    def merged(blocks):
        lines = pc.split_pattern(blocks.column("block").combine_chunks(), "\n")
        lang = blocks.column("lang").combine_chunks().take(pc.list_parent_indices(lines))
        table = pa.table([lang, pc.list_flatten(lines), pa.array(_unpacked(blocks.column("counts"), np.int64))], ["lang", "phrase", "f"])
        summed = table.group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        phrase, f = summed.column("phrase"), summed.column("f_sum")
        size = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
        found = pa.table([summed.column("lang"), phrase, size, f], ["lang", "phrase", "size", "f"])
        return found.filter(pc.or_(pc.greater_equal(f, least), pc.equal(size, 0)))

    blocks = rows.mapInArrow(run, "bucket int, lang string, block string, counts binary")
    return blocks.groupBy("bucket").applyInArrow(merged, "lang string, phrase string, size int, f long")


def collocations(
    docs: DataFrame, least: int = 30, most_words: int = 4, top: int = 2000, scale: int = 2_000_000,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `most_words` words of each language.

    a, l, r are occurrences of the phrase and of the two sides of its weakest cut, n all words of
    the language; score is floor(scale * a / (l + r)). Null languages count as `und`, null and
    empty texts have no words, repeated rows count again, ties are broken by a and the phrase's
    bytes. Texts may be of any length. Other columns are left out, whatever their names. An empty
    table, or one without a phrase of `least` occurrences, gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + length // (1000 * SHARE)
    bits, words, codes = np.zeros(1, np.uint64), None, None
    for size in range(1, most_words + 1):
        level = stored(frequent_codes(rows, size, least, buckets, bits, words), f"codes-{size}")
        codes = level if codes is None else codes.unionByName(level)
        if size < most_words:
            bits = bit_table(level, "code")
            words = bits if words is None else words
    every = stored(counted(rows, most_words, least, buckets, bit_table(codes, "code"), words), "phrases")
    known = {size: every.where(F.col("size") == size).select("lang", "phrase", "f") for size in range(most_words + 1)}
    scored = []
    for size in range(2, most_words + 1):
        found = known[size].withColumnRenamed("f", "a")
        cuts = []
        for k in range(1, size):
            left = F.substring_index("phrase", " ", k)
            right = F.substring_index("phrase", " ", k - size)
            one = found.withColumn("left", left).withColumn("right", right)
            one = one.join(known[k].select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            one = one.join(known[size - k].select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
            score = F.expr(f"cast(a as decimal(20,0)) * {scale} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
            cuts.append(one.select("lang", "phrase", "a", F.struct(score.alias("score"), F.lit(k).alias("k"), "l", "r").alias("cut")))
        joined = cuts[0]
        for one in cuts[1:]:
            joined = joined.unionByName(one)
        best = joined.groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), F.min("cut").alias("cut"))
        if size < most_words:
            part = lambda n: known[size + 1].select("lang", F.substring_index("phrase", " ", n).alias("phrase"), F.col("f").alias("m"))  # noqa: B023, E731
            longer = part(size).unionByName(part(-size)).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
            best = best.join(longer, ["lang", "phrase"], "left").where("m IS NULL OR cast(m as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80")
            best = best.drop("m")
        scored.append(best)
    every = scored[0]
    for one in scored[1:]:
        every = every.unionByName(one)
    ranked = every.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = known[0].select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op13_collocations", """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    grams AS (
        SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase
        FROM (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS s FROM w CROSS JOIN range(1, 5) AS t(k) WHERE len(w) >= k)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k >= 2),
    cut AS (SELECT lang, size, phrase, a, j, array_to_string(p[1 : j], ' ') AS lp, array_to_string(p[j + 1 : size], ' ') AS rp
            FROM (SELECT *, unnest(generate_series(1, size - 1)) AS j FROM c)),
    s AS (SELECT cut.lang, size, cut.phrase, a, j, lf.f AS l, rf.f AS r, (2000000::HUGEINT * a // (lf.f + rf.f))::BIGINT AS score
          FROM cut JOIN f lf ON lf.lang = cut.lang AND lf.phrase = lp AND lf.k = j JOIN f rf ON rf.lang = cut.lang AND rf.phrase = rp AND rf.k = size - j),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inside AS (SELECT lang, array_to_string(p[b : b + m - 1], ' ') AS phrase, max(a) AS m
               FROM (SELECT lang, a, p, size, m, unnest(generate_series(1, size - m + 1)) AS b FROM c CROSS JOIN range(2, 4) AS t(m) WHERE m < size)
               GROUP BY 1, 2),
    kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE inside.m IS NULL OR 100 * inside.m < 80 * best.a)
    SELECT lang, rank, phrase, a, l, r, n, score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
    WHERE rank <= 2000
""")
def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
