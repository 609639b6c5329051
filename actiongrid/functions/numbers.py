"""Exact integer time and rounding expressions.

Times are LONG microseconds inside the engine; confidences are LONG
millionths. Both are exact for values rounded to six decimals, so comparisons
and sums do not depend on evaluation order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def int_div(a: Column | str, b: Column | int) -> Column:
    """Truncating integer quotient of two whole-number columns."""
    a = as_col(a)
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)


def half_even_div(a: Column | str, b: Column | int) -> Column:
    """a / b for a >= 0, b > 0, rounded half to even, in integers only."""
    a = as_col(a)
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    q, twice = int_div(a, b), (a % b) * 2
    up = (twice > b) | ((twice == b) & (q % 2 == 1))
    return q + F.when(up, 1).otherwise(0)


def us_to_ms(us: Column | str) -> Column:
    return half_even_div(us, 1000)


def seconds_to_us(seconds: Column | str) -> Column:
    """Null when the value is not finite or beyond the LONG range."""
    return F.rint(as_col(seconds) * 1_000_000).try_cast("long")


def us_to_seconds(us: Column | str) -> Column:
    return as_col(us) / F.lit(1_000_000.0)


def duration(start: Column | str, end: Column | str) -> Column:
    return as_col(end) - as_col(start)


def ratio(numerator: Column | str, denominator: Column | str, empty: float | None = 0.0) -> Column:
    """Double quotient; `empty` where the denominator is 0."""
    n, d = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    q = n / F.nullif(d, F.lit(0.0))
    return q if empty is None else F.coalesce(q, F.lit(empty))


def rounded_ratio(numerator: Column | str, denominator: Column | str, digits: int) -> Column:
    """numerator / denominator of integers, not negative, rounded half to even at `digits`
    decimals; exact, because only integers are rounded. Null where the denominator is 0."""
    d = F.nullif(as_col(denominator).cast("long"), F.lit(0).cast("long"))
    return half_even_div(as_col(numerator).cast("long") * 10**digits, d) / F.lit(float(10**digits))
