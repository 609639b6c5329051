"""Review and match documents: JSON read as VARIANT, so that missing, null, boolean,
integer and real values stay distinguishable.

A document is one object in one file, and one of its lists may be very long. The file is cut
into byte ranges (see `ranges`). The first scan gives for each range whether it flips "inside a
text", how it moves the bracket depth, and how many commas it has at every relative depth;
composed over the ranges these are true depths and item numbers. The few ranges that touch the
outermost object give its plain fields and where its lists lie; the last scan cuts the items.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import DOCUMENT_FORMAT_VERSION, ReviewError
from ..session import durable, scratch_path
from .ranges import RANGE_BYTES, Range, cut, cut_into_ranges, listing, open_file, read_at, read_ranges

BACKSLASH = 92
ROWS = 4096
#: A document's fields outside its lists are read by the driver, up to so many bytes.
MOST_OUTLINE = 1 << 22

# The fields each document may have.
SPEC_FIELDS = ("format_version", "manifest", "target_team", "requests")
REQUEST_FIELDS = (
    "record_index", "reason", "suggested_operation", "suggested_action",
    "suggested_start_seconds", "suggested_end_seconds",
)
RESULT_FIELDS = ("format_version", "manifest", "spec", "time_precision_seconds", "confirmations")
CONFIRMATION_FIELDS = (
    "record_index", "source_video_path", "source_start_seconds", "source_end_seconds",
    "source_action", "source_split", "source_team_side", "source_player_number",
    "source_crop", "source_notes", "operation", "confirmed_action",
    "confirmed_start_seconds", "confirmed_end_seconds", "confirmation_note",
)

# SQL types of the fields once they are columns.
FIELD_TYPES = {
    "record_index": "long",
    "suggested_start_seconds": "double", "suggested_end_seconds": "double",
    "source_start_seconds": "double", "source_end_seconds": "double",
    "confirmed_start_seconds": "double", "confirmed_end_seconds": "double",
}


def kind_of(variant: Column) -> Column:
    """absent, null, bool, int, number, text, array or object."""
    name = F.schema_of_variant(variant)
    return (
        F.when(variant.isNull(), "absent")
        .when(name == "VOID", "null")
        .when(name == "BOOLEAN", "bool")
        .when(name == "BIGINT", "int")
        .when(name == "STRING", "text")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("number")
    )


#: How a byte outside texts moves the depth.
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def _structure(data: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places of brackets and commas outside texts, depth before each, depth after each,
    whether the bytes end inside a text). The byte before `data` is no backslash."""
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == 34)
    plain = np.maximum.accumulate(np.where(raw != 92, np.arange(len(raw)), -1))
    run = np.where(quotes > 0, quotes - 1 - np.where(quotes > 0, plain[quotes - 1], -1), 0)
    quotes = quotes[run % 2 == 0]
    step = _STEP[raw]
    places = np.flatnonzero((step != 0) | (raw == 44))
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    after = depth + np.cumsum(step[places], dtype=np.int64)
    return places, after - step[places], after, bool((len(quotes) + inside) % 2)


class _Span:
    """The bytes of a range between cuts that tear no escape."""

    def __init__(self, file, piece: Range):
        self.file, self.size = file, piece.size
        self.start, self.end = (cut(file, piece.size, at, BACKSLASH) for at in (piece.start, piece.end))
        self.data = read_at(file, self.start, self.end)


def summarise(piece: Range):
    """How a range moves depth and texts, for both ways it may begin; commas by relative depth."""
    with open_file(piece.path) as file:
        data = _Span(file, piece).data
    ends, moved, lowest, levels, commas = [], [], [], [], []
    for inside in (False, True):
        places, before, after, at_end = _structure(data, inside, 0)
        ends.append(at_end)
        moved.append(int(after[-1]) if len(after) else 0)
        lowest.append(int(min(before.min(), after.min())) if len(after) else 0)
        level, count = np.unique(after[before == after], return_counts=True)
        levels.append(level.tolist())
        commas.append(count.tolist())
    yield pa.RecordBatch.from_pydict(
        {"start": [piece.start], "ends_inside": [ends], "moved": [moved], "lowest": [lowest], "levels": [levels], "commas": [commas]},
        schema=pa.schema([
            ("start", pa.int64()), ("ends_inside", pa.list_(pa.bool_())), ("moved", pa.list_(pa.int64())), ("lowest", pa.list_(pa.int64())),
            ("levels", pa.list_(pa.list_(pa.int64()))), ("commas", pa.list_(pa.list_(pa.int64()))),
        ]),
    )


SUMMARY = "start long, ends_inside array<boolean>, moved array<long>, lowest array<long>, levels array<array<long>>, commas array<array<long>>"


def outline(piece: Range):
    """(range, start, end, kind, text, commas) of what lies outside the insides of fields.

    kind is text, or inside (with the number of item separators there), or the opening or
    closing place of an inside.
    """
    state = piece.state
    with open_file(piece.path) as file:
        span = _Span(file, piece)
    places, before, after, _ = _structure(span.data, state["inside"], state["depth"])
    separators = places[(before == 2) & (after == 2)]
    edges = (np.minimum(before, after) == 1) & (np.maximum(before, after) == 2)
    # brackets belong to the outline, whichever way they go
    turns = [(int(p) + int(a == 2), bool(a == 2)) for p, a in zip(places[edges], after[edges])]
    rows, at, deep = [], 0, state["depth"] >= 2
    for place, opening in [*turns, (len(span.data), None)]:
        if place > at:
            commas = int(np.searchsorted(separators, place) - np.searchsorted(separators, at)) if deep else 0
            text = None if deep else span.data[at:place]
            rows.append((at, place, "inside" if deep else "text", text, commas))
        if opening is not None:
            rows.append((place, place, "open" if opening else "close", None, 0))
            deep = opening
        at = place
    first, last, kind, text, commas = zip(*rows) if rows else ((),) * 5
    shift = span.start
    yield pa.RecordBatch.from_arrays(
        [pa.array([piece.start] * len(rows), pa.int64()), pa.array([x + shift for x in first], pa.int64()),
         pa.array([x + shift for x in last], pa.int64()), pa.array(kind, pa.string()), pa.array(text, pa.binary()), pa.array(commas, pa.int64())],
        ["range", "start", "end", "kind", "text", "commas"],
    )


OUTLINE = "range long, start long, end long, kind string, text binary, commas long"


def items(piece: Range):
    """(position, item): the texts of the items that begin in the range; state names the list."""
    state = piece.state
    low, high = state["list"]
    with open_file(piece.path) as file:
        span = _Span(file, piece)
        places, before, after, inside = _structure(span.data, state["inside"], state["depth"])
        commas = places[(before == 2) & (after == 2)] + span.start
        commas = commas[(commas >= low) & (commas < high)]
        starts = commas + 1
        position = state["commas"] + 2
        if span.start <= low < span.end:
            starts = np.insert(starts, 0, low)
            position -= 1
        if not len(starts):
            return
        ends = np.append(starts[1:] - 1, -1)
        data, at, depth = [span.data], span.end, int(after[-1]) if len(after) else state["depth"]
        step = 1 << 14  # most items are short
        while ends[-1] < 0:
            if high <= at:
                ends[-1] = high
                break
            end = cut(file, piece.size, at + step, BACKSLASH)
            more = read_at(file, at, end)
            places, before, after, inside = _structure(more, inside, depth)
            found = places[(before == 2) & (after == 2)] + at
            if len(found) and found[0] < high:
                ends[-1] = found[0]
            data.append(more)
            at, depth, step = end, int(after[-1]) if len(after) else depth, min(2 * step, 1 << 20)
    whole = b"".join(data)
    for first in range(0, len(starts), ROWS):
        some = range(first, min(first + ROWS, len(starts)))
        texts = [whole[starts[i] - span.start:ends[i] - span.start].decode("utf-8", "replace").strip(" \t\r\n") for i in some]
        numbers = [position + i for i in some]
        if low == starts[0] and len(starts) == 1 and ends[0] == high and not texts[0]:
            return  # an empty list
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], ["position", "item"])


class Document:
    """A JSON object in one file: its fields without the insides of lists, and its lists as tables.

    No task reads more of the file than its range and the item that runs over the end of it.
    """

    def __init__(self, spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES):
        self.spark, self.path = spark, path
        files = listing(spark, path)
        if len(files) != 1:
            raise ReviewError("document", f"{path} is {len(files)} files, not one document")
        ranges = cut_into_ranges(files, range_bytes)
        seen = {r.start: r for r in self._run(ranges, "summarise", SUMMARY).collect()}
        self.ranges, self._commas, shallow, inside, depth = [], {}, [], False, 0
        for one in ranges:
            found = seen[one.start]
            self.ranges.append(one._replace(state={"inside": inside, "depth": depth}))
            self._commas[one.start] = dict(zip(found.levels[inside], found.commas[inside])).get(2 - depth, 0)
            if depth + found.lowest[inside] < 2:
                shallow.append(self.ranges[-1])
            depth += found.moved[inside]
            inside = found.ends_inside[inside]
        if inside or depth:
            raise ReviewError("document", "the document is no JSON object")
        parts = self._run(shallow, "outline", OUTLINE)
        size = parts.agg(F.sum(F.length("text"))).first()[0] or 0
        if size > MOST_OUTLINE:
            raise ReviewError("document", f"{size} bytes outside its lists")
        rows = parts.orderBy("start", "end").collect()
        pairs = _fields(b"".join(r.text for r in rows if r.kind == "text").decode("utf-8-sig", "replace"))
        self.fields = dict(pairs)
        nested = [name for name, value in pairs if isinstance(value, (list, dict))]
        opens, closes = ([r.start for r in rows if r.kind == kind] for kind in ("open", "close"))
        self.places = dict(zip(nested, zip(opens, closes)))
        self._inside: dict[int, list] = {}
        for r in rows:
            if r.kind == "inside":
                self._inside.setdefault(r.range, []).append((r.start, r.commas))

    def _run(self, ranges, job: str, schema) -> DataFrame:
        return read_ranges(self.spark, ranges, f"{__name__}:{job}", schema)

    def kind(self, name: str) -> str:
        """absent, null, bool, int, number, text, array or object."""
        if name not in self.fields:
            return "absent"
        value = self.fields[name]
        if value is None or isinstance(value, bool):
            return "null" if value is None else "bool"
        return {int: "int", float: "number", str: "text", list: "array", dict: "object"}[type(value)]

    def items(self, name: str) -> DataFrame:
        """(position, item): the texts of the list's items; position counts from 1."""
        schema = "position long, item string"
        if self.kind(name) != "array":
            return self.spark.createDataFrame([], schema)
        low, high = self.places[name]
        pieces, commas = [], 0
        for one in self.ranges:
            if one.start <= high and one.end > low:
                pieces.append(one._replace(state={**one.state, "list": (low, high), "commas": commas}))
            if one.start in self._inside:
                commas += sum(n for start, n in self._inside[one.start] if low <= start < high)
            elif low <= one.start < high:
                commas += self._commas[one.start]
        return self._run(pieces, "items", schema)


def _fields(text: str) -> list[tuple]:
    """(name, value) of the object `text`, with insides of lists and objects left out."""
    pairs: list = []

    def keep(found):
        pairs[:] = found
        return dict(found)

    try:
        whole = json.loads(text, object_pairs_hook=keep)
    except ValueError:
        whole = None
    if not isinstance(whole, dict):
        raise ReviewError("document", "the document is no JSON object")
    return pairs


def _head(doc: Document, allowed: Sequence[str]) -> dict:
    """Header facts of a document: its plain fields as text and the kinds of all."""
    unknown = sorted(set(doc.fields) - set(allowed))
    if unknown:
        raise ReviewError("unknown_fields", ", ".join(unknown))
    head: dict = {}
    for name in allowed:
        head[f"{name}_kind"] = kind = doc.kind(name)
        if kind in ("text", "int", "number"):
            head[name] = doc.fields[name]
        elif kind in ("null", "absent", "bool"):
            head[name] = None
    version = head["format_version"] if head["format_version_kind"] in ("int", "number") else None
    if version != DOCUMENT_FORMAT_VERSION:
        raise ReviewError("format_version", f"unsupported format {doc.fields.get('format_version')}")
    return head


def _cells(doc: Document, name: str, allowed: Sequence[str]) -> DataFrame:
    """The items of a list as stored cells: the document is parsed once, however often they are used."""
    parsed = doc.items(name).withColumn("item", F.try_parse_json("item"))
    cells = durable(item_cells(parsed, "item", allowed).withColumn("__broken", F.col("is_object").isNull()))
    if not cells.where("__broken").isEmpty():
        raise ReviewError("document", f"an item of {name} is no JSON")
    return cells.drop("__broken")


def read_spec(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[dict, DataFrame]:
    """Header facts and the requests as a table (position, cells, kinds)."""
    doc = Document(spark, path, range_bytes)
    head = _head(doc, SPEC_FIELDS)
    for name in ("manifest", "target_team"):
        if head[f"{name}_kind"] != "text" or not head[name].strip():
            raise ReviewError(name, f"{name} must be non-blank text")
    requests = _cells(doc, "requests", REQUEST_FIELDS)
    if head["requests_kind"] != "array" or requests.isEmpty():
        raise ReviewError("requests", "requests must be a non-empty list")
    return head, requests


def read_results(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[dict, DataFrame]:
    doc = Document(spark, path, range_bytes)
    head = _head(doc, RESULT_FIELDS)
    precision = head["time_precision_seconds"]
    if head["time_precision_seconds_kind"] not in ("int", "number") or not 0 < float(precision) < float("inf"):
        raise ReviewError("time_precision_seconds", "must be a positive finite number")
    if head["confirmations_kind"] != "array":
        raise ReviewError("confirmations", "confirmations must be a list")
    return head, _cells(doc, "confirmations", CONFIRMATION_FIELDS)


def item_cells(rows: DataFrame, item: str, allowed: Sequence[str]) -> DataFrame:
    """VARIANT items to typed cells `f` and their kinds `f_kind`."""
    cells = F.try_variant_get(F.col(item), "$", "map<string,variant>")
    base = rows.withColumn("__cells", cells)
    allowed_array = F.array(*[F.lit(a) for a in allowed])
    out = [
        "position",
        F.when(F.col(item).isNotNull(), F.col("__cells").isNotNull()).alias("is_object"),
        F.coalesce(
            F.sort_array(F.array_except(F.map_keys("__cells"), allowed_array)),
            F.array().cast("array<string>"),
        ).alias("unknown_fields"),
    ]
    for name in allowed:
        value = F.col("__cells").getItem(name)
        out.append(F.try_variant_get(value, "$", FIELD_TYPES.get(name, "string")).alias(name))
        out.append(kind_of(value).alias(f"{name}_kind"))
    return base.select(*out)


def table_cells(rows: DataFrame, allowed: Sequence[str], *, position: str) -> DataFrame:
    """The same shape from an already typed table: null means absent."""
    out = [
        F.col(position).cast("long").alias("position"), F.lit(True).alias("is_object"),
        F.array().cast("array<string>").alias("unknown_fields"),
    ]
    for name in allowed:
        kind = {"record_index": "int"}.get(name, "number" if name in FIELD_TYPES else "text")
        value = F.col(name) if name in rows.columns else F.lit(None)
        out.append(value.cast(FIELD_TYPES.get(name, "string")).alias(name))
        out.append(F.when(value.isNull(), "absent").otherwise(kind).alias(f"{name}_kind"))
    return rows.select(*out)


def read_match(spark: SparkSession, path: str, field: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of one list of a match document, e.g. its segments or reviewed intervals.

    The items are written one to a line and read as JSON lines, so Spark infers their types.
    """
    doc = Document(spark, path, range_bytes)
    if doc.kind(field) != "array":
        raise ReviewError("document", f"{field} is no list")
    lines = scratch_path(spark, "match")
    doc.items(field).select(F.translate("item", "\n\r", "  ").alias("value")).write.text(lines)
    return spark.read.json(lines)
