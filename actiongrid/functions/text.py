"""Text expressions: cleaning, time codes, notes, crops and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import as_col, half_even_div, int_div

# The characters that count as white space around a cell.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Accepted spellings of numbers in a cell.
FLOAT_TEXT = (
    r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    r"|^[+-]?(?i:inf|infinity|nan)$"
)
INT_TEXT = r"^[+-]?\d+(_\d+)*$"
NOTE_MARKER = "reviewer note:"


def strip(value: Column | str) -> Column:
    return F.btrim(as_col(value), F.lit(WHITE_SPACE))


def stripped_or_empty(value: Column | str) -> Column:
    return F.coalesce(strip(value), F.lit(""))


def optional_text(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


def float_of_stripped(text: Column) -> Column:
    plain = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(
        text.rlike(FLOAT_TEXT),
        F.when(F.lower(plain).endswith("nan"), F.lit(float("nan"))).otherwise(
            plain.try_cast("double")
        ),
    )


def float_value(value: Column | str) -> Column:
    """Number in a text cell, null when the cell is no number."""
    return float_of_stripped(strip(value))


def int_of_stripped(text: Column) -> Column:
    return F.when(
        text.rlike(INT_TEXT), F.replace(text, F.lit("_"), F.lit("")).try_cast("long")
    )


def int_value(value: Column | str) -> Column:
    return int_of_stripped(strip(value))


def _clock(centis: Column) -> Column:
    """HH:MM:SS.cc; hours may have more digits. Null for null."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours = int_div(centis, 360_000).cast("string")
    return F.concat(
        F.when(F.length(hours) < 2, F.concat(F.lit("0"), hours)).otherwise(hours), F.lit(":"),
        two(int_div(centis, 6000) % 60), F.lit(":"), two(int_div(centis, 100) % 60), F.lit("."), two(centis % 100),
    )


def timecode(seconds: Column | str) -> Column:
    """HH:MM:SS.cc of double seconds, centiseconds rounded half to even."""
    return _clock(F.bround(as_col(seconds) * 100, 0).cast("long"))


def timecode_us(us: Column | str) -> Column:
    return _clock(half_even_div(us, 10_000))


def caption(seconds: Column | str) -> Column:
    """MM:SS.ss, minutes may exceed 59."""
    value = as_col(seconds)
    minutes = F.floor(value / 60)
    return F.when(value.isNotNull(), F.format_string("%02d:%05.2f", minutes, value - minutes * 60))


def seconds_text(seconds: Column | str) -> Column:
    """Ten decimals without trailing zeros."""
    value = as_col(seconds)
    fixed = F.when(value.isNotNull(), F.format_string("%.10f", value))
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


def seconds_text_us(us: Column | str) -> Column:
    value = as_col(us)
    fraction = F.rtrim(F.lpad((value % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    whole = int_div(value, 1_000_000).cast("string")
    return F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def reviewer_note(notes: Column | str) -> Column:
    """Text behind the last marker, '' without one."""
    # anchored: an unanchored pattern would retry at every character of a long text
    return strip(F.regexp_extract(as_col(notes), f"(?is)^.*{NOTE_MARKER}(.*)$", 1))


def audit_note(
    *, record_index, operation, prior_action, prior_start, prior_end,
    action, start, end, note,
) -> Column:
    """The sentence a review leaves behind; times are already text."""
    # The wording of the sentences.
    confirmed = F.concat(F.lit("confirmed="), action, F.lit("@"), start, F.lit("-"), end)
    added = F.concat(
        F.lit("Second-pass human-reviewed; added from source record "),
        record_index.cast("string"), F.lit("; "), confirmed,
    )
    changed = F.concat(
        F.lit("Second-pass human-reviewed; operation="), operation, F.lit("; prior="),
        prior_action, F.lit("@"), prior_start, F.lit("-"), prior_end, F.lit("; "), confirmed,
    )
    tail = F.when(note != "", F.concat(F.lit(f"; {NOTE_MARKER} "), note)).otherwise(F.lit(""))
    return F.concat(F.when(operation == "add_window", added).otherwise(changed), tail)


def append_note(existing: Column | str, sentence: Column) -> Column:
    return F.concat_ws("; ", optional_text(existing), sentence)


def crop_text(crop: Column | str) -> Column:
    """'x1,y1,x2,y2' of a crop struct, '' for null."""
    box = as_col(crop)
    return F.concat_ws(",", *[box[name] for name in ("x1", "y1", "x2", "y2")])


def once(value: Column, use) -> Column:
    """`use(value)` with the value computed a single time per row, however often `use`
    mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_crop(value: Column | str) -> Column:
    """Crop struct of 'x1,y1,x2,y2'; null when blank, incomplete or inconsistent."""
    cells = F.split(as_col(value), ",", -1)
    numbers = F.transform(cells, lambda c: once(strip(c), int_of_stripped))

    def box(n):
        x1, y1, x2, y2 = (F.get(n, F.lit(i)) for i in range(4))
        valid = (
            (F.size(n) == 4) & F.forall(n, lambda v: v.isNotNull() & (v >= 0)) & (x2 > x1) & (y2 > y1)
        )
        corners = zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))
        return F.when(valid, F.struct(*[c.try_cast("int").alias(name) for name, c in corners]))

    return once(numbers, box)


def parse_times(value: Column | str) -> Column:
    """Comma list of seconds; null when one is no number or negative, or none is given."""
    cells = F.filter(F.transform(F.split(as_col(value), ","), strip), lambda c: c != "")
    numbers = F.transform(cells, float_of_stripped)
    return once(numbers, lambda n: F.when(
        (F.size(n) > 0) & F.forall(n, lambda v: v.isNotNull() & (v >= 0)), n
    ))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), r"([^/]*)/*$", 1)


def file_stem(path: Column | str) -> Column:
    """Name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def resolve_path(path: Column | str, root: str = "") -> Column:
    """Absolute path with '.', '..' and doubled slashes folded, as one fold over its parts;
    paths that are normal already skip the fold."""
    cell = as_col(path)
    full = F.when(cell.startswith("/"), cell).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), cell))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda seen, p: F.when(
            p == "..",
            F.when(F.size(seen) > 0, F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
            .otherwise(seen),
        ).otherwise(F.concat(seen, F.array(p))),
    )
    return F.when(full.rlike(r"//|/\.{1,2}(/|$)|/$"), F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(full)


def formula_guard(value: Column | str) -> Column:
    """Keep spreadsheets from evaluating a cell."""
    cell = as_col(value)
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def decimal_ms(value: Column | str) -> tuple[Column, Column]:
    """(milliseconds, smallest unit written in ms) of decimal seconds with at most
    three decimals; null otherwise."""
    text = strip(value)
    valid = text.rlike(r"^\d+(\.\d{1,3})?$")
    ms = F.when(valid, (text.try_cast("decimal(18,3)") * 1000).cast("long"))
    decimals = F.length(F.regexp_extract(text, r"\.(\d+)$", 1))
    precision = F.when(valid, F.element_at(F.array(*[F.lit(p) for p in (1000, 100, 10, 1)]), decimals + 1))
    return ms, precision
