"""Fill-in-middle transformation with a Fenwick tree over blocks of the text.

A text is UTF-8 bytes in fixed blocks. A Fenwick tree over the blocks holds how many units and
how many code points begin in each. Walking it down by binary lifting finds the block in which
the k-th unit begins; only that block is then searched for the place itself. Cuts of any unit
therefore never cut a code point, and the code points before a cut come with it.

A prefix P, middle M and suffix S are written as `psm` (P, S, M) or `spm` (S, P, M), each behind
its sentinel. Texts that are empty, hold a sentinel themselves or are not drawn stay `plain`.
All draws depend on the id and the seed alone, so a recomputed task makes the same choices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import arrow_runs
from .common import query, table

SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("codepoint", "word", "line")


def beginnings(data: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(where a unit begins, where a code point begins) for the bytes of a text.

    Units cover the text: a word takes the white space behind it (the first also what is before
    it), a line its line feed.
    """
    point = (data & 0xC0) != 0x80
    if unit == "codepoint" or not len(data):
        return point, point
    if unit == "line":
        first = np.concatenate(([True], data[:-1] == 10))
    else:
        space = (data == 32) | ((data >= 9) & (data <= 13))
        first = ~space & np.concatenate(([True], space[:-1]))
        if space[0]:
            first[np.flatnonzero(first)[:1]] = False
            first[0] = True
    return first, point


class BlockTree:
    """Unit and code point counts of blocks of `block` bytes; k-th beginnings by descent."""

    def __init__(self, raw: bytes, unit: str = "codepoint", block: int = 1024):
        self.block, self.length = block, len(raw)
        self.first, self.point = beginnings(np.frombuffer(raw, np.uint8), unit)
        edges = np.arange(0, len(raw), block)
        units = np.add.reduceat(self.first, edges, dtype=np.int64).tolist() if len(raw) else []
        points = np.add.reduceat(self.point, edges, dtype=np.int64).tolist() if len(raw) else []
        self.n, self.points = sum(units), sum(points)
        self.units, self.codes = [0, *units], [0, *points]
        for i in range(1, len(self.units)):
            up = i + (i & -i)
            if up < len(self.units):
                self.units[up] += self.units[i]
                self.codes[up] += self.codes[i]

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code points before it) of the place after the first k units."""
        if k >= self.n:
            return self.length, self.points
        place, left, before = 0, k, 0
        step = 1 << (len(self.units) - 1).bit_length()
        while step:
            if place + step < len(self.units) and self.units[place + step] <= left:
                place += step
                left -= self.units[place]
                before += self.codes[place]
            step >>= 1
        start = place * self.block
        byte = start + int(np.flatnonzero(self.first[start:start + self.block])[left])
        return byte, before + int(np.count_nonzero(self.point[start:byte]))


def draws(id_col: str, seed: str = "1") -> list[Column]:
    """Four numbers below 2 ** 32 from SHA-256 of the seed and the decimal id (null: no digits)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, unit: str = "codepoint", percent: int = 90, spm_percent: int = 20, seed: str = "1",
    sentinels: tuple[str, str, str] = SENTINELS, block: int = 1024, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n units, form, prefix_chars, middle_chars, output) of every row.

    Null and empty texts are plain, with n 0 and an empty output. Repeated rows get equal results,
    rows of null id one common draw. A text may be of any length and is never shortened. Other
    columns are left out, whatever their names; an empty table gives no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")

    def run(batches):
        marks = [s.encode() for s in sentinels]
        p, s, m = marks
        for rows, run_texts in arrow_runs(batches):
            h = [rows.column(i).to_pylist() for i in range(1, 5)]
            out = []
            for text, h1, h2, h3, h4 in zip(run_texts, *h):
                raw = text.encode("utf-8", "surrogatepass")
                tree = BlockTree(raw, unit, block)
                if not raw or any(mark in raw for mark in marks) or h3 % 100 >= percent:
                    out.append((tree.n, "plain", None, None, raw))
                    continue
                low, high = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
                (a, points_a), (b, points_b) = tree.cut(low), tree.cut(high)
                if h4 % 100 < spm_percent:
                    form, cut = "spm", (s, raw[b:], p, raw[:a], m, raw[a:b])
                else:
                    form, cut = "psm", (p, raw[:a], s, raw[b:], m, raw[a:b])
                out.append((tree.n, form, points_a, points_b - points_a, b"".join(cut)))
            n, form, prefix, middle, made = zip(*out)
            columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                       pa.array(middle, pa.int64()), pa.array(made, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(
        F.col(id_col).alias("doc_id"), *draws(id_col, seed), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    schema = T.StructType([rows.schema["doc_id"]])
    for name, kind in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of; sentinels cannot overlap, so its parts are certain."""
    either = "|".join("\\Q" + s + "\\E" for s in sentinels)
    part = F.split(output, either, -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


@query("op12_fill_in_middle", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
""")
def op12_fill_in_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"),
    )
