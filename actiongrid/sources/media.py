"""Media facts and file identities as tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import MediaError
from ..functions.text import file_stem
from .ranges import TASK_BYTES, Range, listing, open_file, read_ranges

PIECE_BYTES = 8 << 20


def media_table(facts: DataFrame, *, strict: bool = False) -> DataFrame:
    """Valid media facts with their duration; `strict` raises on an invalid row."""
    valid = F.coalesce(
        (F.col("fps") > 0) & (F.col("frame_count") > 0) & (F.col("width") > 0) & (F.col("height") > 0),
        F.lit(False),
    )
    if strict:
        bad = facts.where(~valid).first()
        if bad is not None:
            raise MediaError("media", f"invalid media facts: {bad.asDict()}")
    return facts.where(valid).withColumn(
        "duration_seconds", F.col("frame_count") / F.col("fps").cast("double")
    )


def digest(piece: Range):
    """SHA-256 of a whole file, read in pieces of bounded size."""
    running = hashlib.sha256()
    with open_file(piece.path) as file:
        while data := file.read(PIECE_BYTES):
            running.update(data)
    yield pa.RecordBatch.from_pydict({"path": [piece.path], "length": [piece.size], "sha256": [running.hexdigest()]})


def fingerprints(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """SHA-256 of the bytes of every file under `path`, whatever its size.

    A hash runs over a file from front to back, so a file is one task's work; small files share
    tasks of up to `task_bytes`. A task never holds more than PIECE_BYTES of a file.
    """
    files = [Range(name, size, 0, size) for name, size in listing(spark, path)]
    rows = read_ranges(spark, files, f"{__name__}:digest", "path string, length long, sha256 string", task_bytes)
    return rows.select("path", file_stem("path").alias("video_id"), "length", "sha256")


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Existing paths without reading contents (the column is pruned)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(path)
        .select(F.regexp_replace("path", "^file:/*", "/").alias("video_path"))
    )
