"""Files cut into byte ranges that tasks read by themselves, as a Python data source.

A format whose records may hold line breaks cannot be cut at line ends. Here a file is cut at
any byte and read twice: a first scan finds what each range does to the state of the parser for
every state it may begin in, these effects are composed range after range (one small row each),
and the second scan parses every range from its true state. A record belongs to the range it
begins in; its task reads on until it ends.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import scratch_path

#: Bytes of a range. A task holds one range at a time, and some tens of times its bytes to parse it.
RANGE_BYTES = 4 << 20
#: Bytes of neighbouring ranges that one task reads, one after another.
TASK_BYTES = 32 << 20
#: Ranges of a listing above which small ranges grow: the driver holds one row of each.
MOST_RANGES = 2048
STEP = 1 << 16


class Range(NamedTuple):
    """`state` is what the second scan has to know; the first scan has none."""

    path: str
    size: int
    start: int
    end: int
    state: dict | None = None


def open_file(path: str):
    """A file of the local or a remote file system, for reading and seeking."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def open_output(path: str):
    """A new file of the local or a remote file system, for writing."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_output_stream(re.sub("^file:/*", "/", path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner)


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written through Spark's file system classes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the data files at `path` (a file, folder or pattern), in order of paths.

    Folders are not entered below the first level; hidden files are left out, empty ones are not.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for found in files.globStatus(root) or ():
        for status in files.listStatus(found.getPath()) if found.isDirectory() else (found,):
            if status.isFile() and (not found.isDirectory() or not status.getPath().getName().startswith(("_", "."))):
                out.append((status.getPath().toString(), status.getLen()))
    if not out and not files.globStatus(root):
        raise FileNotFoundError(path)
    return sorted(out)


def cut_into_ranges(files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> list[Range]:
    """All ranges in order, of `range_bytes` or, in large listings, up to RANGE_BYTES; an empty
    file has one empty range."""
    range_bytes = max(range_bytes, min(RANGE_BYTES, sum(size for _, size in files) // MOST_RANGES))
    return [
        Range(path, size, at, min(at + range_bytes, size))
        for path, size in files for at in range(0, max(size, 1), range_bytes)
    ]


def read_at(file, start: int, end: int) -> bytes:
    file.seek(start)
    return file.read(max(end - start, 0))


def cut(file, size: int, at: int, byte: int) -> int:
    """The first place from `at` on whose byte before it is not `byte` (so no run of it is torn)."""
    if at <= 0:
        return 0
    while at < size:
        for i, b in enumerate(read_at(file, at - 1, min(at - 1 + STEP, size))):
            if b != byte:
                return at + i
        at += STEP
    return size


class RangedSource(DataSource):
    """Options: `plan`, a JSON list of tasks (lists of ranges), and `job`, what reads a task."""

    @classmethod
    def name(cls) -> str:
        return "actiongrid_ranges"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["plan"], self.options["job"])


class _Reader(DataSourceReader):
    def __init__(self, plan: str, job: str):
        self.plan, self.job = plan, job

    def partitions(self) -> list[InputPartition]:
        with open_file(self.plan) as file:
            return [InputPartition(task) for task in json.loads(file.read())]

    def read(self, partition: InputPartition) -> Iterator:
        module, _, name = self.job.partition(":")
        job = getattr(importlib.import_module(module), name)
        for piece in partition.value:
            yield from job(Range(*piece))


def read_ranges(spark: SparkSession, ranges: list[Range], job: str, schema, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows that `job` (module:function, Range -> record batches) makes of the ranges.

    Neighbouring small ranges share a task: four tasks a core, none of more than `task_bytes` unless
    a range has more.
    """
    cost = lambda one: max(one.end - one.start, STEP)  # noqa: E731 - opening a file costs something too
    task_bytes = min(task_bytes, -(-sum(map(cost, ranges)) // (4 * spark.sparkContext.defaultParallelism)))
    tasks, held = [], task_bytes
    for one in ranges:
        size = cost(one)
        if held + size > task_bytes:
            tasks.append([])
            held = 0
        tasks[-1].append(one)
        held += size
    plan = scratch_path(spark, "ranges")
    save_text(spark, plan, json.dumps(tasks))
    spark.dataSource.register(RangedSource)
    return spark.read.format(RangedSource.name()).schema(schema).option("plan", plan).option("job", job).load()
