"""All queries of the package and their SQL twins."""

from . import (  # noqa: F401
    ann, bpe, collocations, decontaminate, exact_dedup, fill_middle, language, packing, pitman_yor, simhash,
    substring_dedup, toxicity, url_filter,
)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
