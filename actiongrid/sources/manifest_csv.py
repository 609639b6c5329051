"""Lossless scan of annotation manifests, many tasks to a file.

All cells stay text and are bound by header name. Files are cut into byte ranges (see `ranges`).
Whether a range begins inside a quoted cell depends on all quotes before it: the first scan
gives, for both answers, how the range ends and how many records begin in it. Composed in the
order of the paths, which is the order a writer gives its parts, this yields the true state and
the first `record_index` of every range; the second scan parses. No rows are shuffled, and
nothing is parsed twice.

A quote opens a cell only where the cell begins; doubled quotes inside stand for one. LF, CR LF
and CR end records outside quotes; empty lines are no records. Every file has a header line.
"""

from __future__ import annotations

import csv
import io
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..domain import ManifestError, ReviewError
from .ranges import RANGE_BYTES, Range, cut, cut_into_ranges, listing, open_file, read_at, read_ranges

PROVENANCE = ("source_file", "record_index", "extra_cells")
QUOTE = 34
BOM = b"\xef\xbb\xbf"
ROWS = 4096


def toggles(data: bytes, before: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """(places where quoting begins or ends, whether it is on at the end)."""
    marks = np.flatnonzero(np.frombuffer(data, np.uint8) == QUOTE).tolist()
    out, i = [], 0
    while i < len(marks):
        place = marks[i]
        if inside and i + 1 < len(marks) and marks[i + 1] == place + 1:
            i += 2
            continue
        if inside or (data[place - 1:place] if place else before) in (b",", b"\n", b"\r", b""):
            out.append(place)
            inside = not inside
        i += 1
    return np.array(out, np.int64), inside


def record_ends(data: bytes, following: bytes, places: np.ndarray, inside: bool) -> np.ndarray:
    """Places of the last byte of line ends outside quotes; `inside` holds at the first byte."""
    raw = np.frombuffer(data, np.uint8)
    after = np.append(raw[1:], following[0] if following else 0)
    ends = np.flatnonzero((raw == 10) | ((raw == 13) & (after != 10)))
    return ends[(np.searchsorted(places, ends) + inside) % 2 == 0]


class _Slice:
    """The bytes of a range between clean cuts, with what is around them."""

    def __init__(self, file, piece: Range):
        self.file, self.size = file, piece.size
        self.start, self.end = (cut(file, piece.size, at, QUOTE) for at in (piece.start, piece.end))
        if piece.start == 0 and read_at(file, 0, 3) == BOM:
            self.start = 3
            self.end = max(self.end, 3)
        self.first = piece.start == 0
        self.data = read_at(file, self.start, self.end)
        self.before = b"" if self.first else read_at(file, self.start - 1, self.start)
        self.following = read_at(file, self.end, min(self.end + 1, piece.size))

    def begins(self, inside: bool) -> tuple[np.ndarray, bool]:
        """(places where non-empty records begin, whether the range ends inside quotes)."""
        places, at_end = toggles(self.data, self.before, inside)
        starts = record_ends(self.data, self.following, places, inside) + 1
        line_end = self.before == b"\n" or (self.before == b"\r" and self.data[:1] != b"\n")
        if self.first or (not inside and line_end):
            starts = np.insert(starts, 0, 0)
        raw = np.frombuffer(self.data, np.uint8)
        starts = starts[starts < len(raw)]
        return starts[(raw[starts] != 10) & (raw[starts] != 13)], at_end

    def rest(self, inside: bool, step: int = 1 << 14) -> bytes:
        """What follows the range up to the end of the record that runs over its edge, read in
        steps that double: most records are short."""
        out, at, before = [], self.end, self.data[-1:]
        while at < self.size:
            end = cut(self.file, self.size, at + step, QUOTE)
            data = read_at(self.file, at, end)
            places, at_end = toggles(data, before, inside)
            ends = record_ends(data, read_at(self.file, end, min(end + 1, self.size)), places, inside)
            if len(ends):
                out.append(data[:ends[0] + 1])
                break
            out.append(data)
            at, inside, before, step = end, at_end, data[-1:], min(2 * step, 1 << 20)
        return b"".join(out)

    def records(self, inside: bool) -> Iterator[list[str]]:
        """Cells of the records that begin here; a CR LF in a cell is read as LF."""
        starts, at_end = self.begins(inside)
        if not len(starts):
            return
        csv.field_size_limit(sys.maxsize)
        text = self.data[starts[0]:]
        raw_end = record_ends(text[-1:], self.following, np.zeros(0, np.int64), at_end)
        if not len(raw_end):  # the last record does not end with the range
            text += self.rest(at_end)
        lines = io.StringIO(text.replace(b"\r\n", b"\n").decode("utf-8", "replace"), newline="")
        yield from (row for row in csv.reader(lines) if row)


def summarise(piece: Range):
    """One row: how the range ends and how many records begin in it, by how it begins."""
    with open_file(piece.path) as file:
        part = _Slice(file, piece)
        (plain, plain_end), (quoted, quoted_end) = part.begins(False), part.begins(True)
        header = None
        if part.first:
            header = next(part.records(False), [])
    yield pa.RecordBatch.from_pydict(
        {
            "path": [piece.path], "start": [piece.start],
            "records": [[len(plain), len(quoted)]], "ends_inside": [[plain_end, quoted_end]], "header": [header],
        },
        schema=pa.schema([
            ("path", pa.string()), ("start", pa.int64()), ("records", pa.list_(pa.int64())),
            ("ends_inside", pa.list_(pa.bool_())), ("header", pa.list_(pa.string())),
        ]),
    )


SUMMARY = "path string, start long, records array<long>, ends_inside array<boolean>, header array<string>"


def parse(piece: Range):
    """The cells of the range as columns of all names; state: inside, index, header, names, place."""
    names, header, index, place = (piece.state[k] for k in ("names", "header", "index", "place"))
    with open_file(piece.path) as file:
        part = _Slice(file, piece)
        rows = part.records(piece.state["inside"])
        if part.first:
            next(rows, None)
        cell = {name: i for i, name in enumerate(header)}
        while some := list(itertools.islice(rows, ROWS)):
            columns = []
            for name in names:
                i = cell.get(name, sys.maxsize)
                columns.append(pa.array([(row[i] or None) if i < len(row) else None for row in some], pa.string()))
            columns += [
                pa.array([piece.path] * len(some), pa.string()),
                pa.array(range(index, index + len(some)), pa.int64()),
                pa.array([len(row) > len(header) for row in some], pa.bool_()),
            ]
            index += len(some)
            yield pa.RecordBatch.from_arrays(columns, [*names, "source_file", place, "extra_cells"])


def planned(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[list[str], list[Range]]:
    """(header names, ranges with the state they begin in and the index of their first record)."""
    ranges = cut_into_ranges(listing(spark, path), range_bytes)
    here = f"{__name__}:"
    seen = {(r.path, r.start): r for r in read_ranges(spark, ranges, here + "summarise", SUMMARY).collect()}
    names, out, inside, index, header = [], [], False, 1, []
    for one in ranges:
        found = seen[one.path, one.start]
        if one.start == 0:
            inside, header = False, found.header or []
            for name in header:
                if name not in names:
                    names.append(name)
        count = found.records[inside] - (1 if one.start == 0 and header else 0)
        out.append((one, {"inside": inside, "index": index, "header": header}))
        index += count
        inside = found.ends_inside[inside]
    return names, [one._replace(state={**state, "names": names}) for one, state in out]


def header_names(spark: SparkSession, path: str) -> list[str]:
    """The names of the manifest, in the order in which its files have them."""
    first = [Range(p, size, 0, min(size, 1 << 16)) for p, size in listing(spark, path)]
    names: list[str] = []
    for row in read_ranges(spark, first, f"{__name__}:summarise", SUMMARY).orderBy("path").collect():
        names += [n for n in row.header or [] if n not in names]
    return names


def scan_csv(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, place: str = "record_index") -> DataFrame:
    """Text columns of the header plus source_file, `place` (from 1, without gaps over all
    files) and extra_cells. An empty cell is null."""
    names, ranges = planned(spark, path, range_bytes)
    if not names:
        raise ManifestError("missing_columns", f"{path} has no header")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    schema = schema.add("source_file", T.StringType()).add(place, T.LongType()).add("extra_cells", T.BooleanType())
    ranges = [one._replace(state={**one.state, "place": place}) for one in ranges]
    return read_ranges(spark, ranges, f"{__name__}:parse", schema)


def scan_manifest(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A manifest's cells with their record_index."""
    return scan_csv(spark, path, range_bytes)


def require_unique_index(rows: DataFrame) -> DataFrame:
    """Joins on record_index need one row per index."""
    twice = rows.groupBy("record_index").count().where("count > 1").agg(F.min("record_index")).first()[0]
    if twice is not None:
        raise ReviewError("index_not_unique", "record_index names several rows", twice)
    return rows


def require_no_extra_cells(rows: DataFrame) -> DataFrame:
    bad = rows.where("extra_cells").agg(F.min("record_index")).first()[0]
    if bad is not None:
        raise ReviewError("extra_cells", "more cells than header names", bad + 1)
    return rows
