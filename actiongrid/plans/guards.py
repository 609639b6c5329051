"""Checks done on the driver while a plan is built."""

from __future__ import annotations

import math
import posixpath
from collections.abc import Iterable
from urllib.parse import urlparse

from pyspark.sql import DataFrame


def fraction(name: str, value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must lie in [0, 1], got {value}")
    return value


def non_negative(name: str, value: float) -> float:
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"{name} must be finite and not negative, got {value}")
    return value


def positive(name: str, value: float) -> float:
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be finite and positive, got {value}")
    return value


def columns_present(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Sorted names of required columns that `df` lacks."""
    return sorted(set(required) - set(df.columns))


def normal_path(path: str) -> str:
    parsed = urlparse(str(path))
    scheme = parsed.scheme or "file"
    return f"{scheme}://{parsed.netloc}{posixpath.normpath(parsed.path or '/')}"


def output_apart_from_inputs(output: str, inputs: Iterable[str]) -> None:
    """A writer may never replace one of its own inputs."""
    target = normal_path(output)
    for path in inputs:
        source = normal_path(path)
        if target == source or source.startswith(target + "/"):
            raise ValueError(f"output {output} would replace input {path}")


def micros(name: str, seconds: float) -> int:
    return round(non_negative(name, seconds) * 1_000_000)
