"""Label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domain import COMPATIBLE_REMAP, EXTERNAL_LABELS
from ..plans.literal import mapped, remapped
from .numbers import as_col
from .text import strip


def normalize_external(label: Column | str) -> Column:
    """Internal action of an external label; null when it names no action."""
    known = {k: v for k, v in EXTERNAL_LABELS.items() if v is not None}
    return mapped(F.lower(strip(as_col(label))), known)


def class_name(names: Column | str, class_id: Column | str) -> Column:
    """Name of a class id in a map keyed by id, null when missing."""
    return F.try_element_at(as_col(names), as_col(class_id))


def compatible(label: Column | str) -> Column:
    return remapped(label, COMPATIBLE_REMAP)
