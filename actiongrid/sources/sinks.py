"""Writers. Each takes the inputs of the run and refuses to replace one of them."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import EVALUATION_COLUMNS, EVENT_COLUMNS, REVIEW_QUEUE_COLUMNS
from ..functions.numbers import int_div, us_to_seconds
from ..plans.guards import output_apart_from_inputs
from ..plans.ordered import MAX_ROWS, in_order, order_by_key
from ..session import scratch_path
from .ranges import listing, open_file, open_output

BOM = "\ufeff"
#: Bytes held by the task that joins parts to one file.
PIECE_BYTES = 8 << 20


def write_csv(
    df: DataFrame, path: str, columns: Sequence[str], *, inputs: Iterable[str] = (),
    bom: bool = True, mode: str = "error", one_file: bool = False,
) -> str:
    """CSV parts with a fixed header; nulls and empty text are both empty cells, white space
    around a text stays. The byte order mark rides on the first header name of every part.
    `one_file` joins the parts, in the order of the partitions of `df`, under one header."""
    output_apart_from_inputs(path, inputs)
    out = df.select(*columns)
    if bom:
        out = out.withColumnRenamed(columns[0], BOM + columns[0])
    target = scratch_path(df.sparkSession, "csv") if one_file else path
    (out.write.mode(mode).option("header", not one_file).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(target))
    if one_file:
        header = io.StringIO()
        csv.writer(header, lineterminator="\n").writerow(out.columns)
        join_parts(df.sparkSession, target, path, opening=header.getvalue(), suffix=".csv", mode=mode)
    return path


def join_parts(
    spark: SparkSession, parts: str, path: str, *, opening: str = "", closing: str = "", skip: int = 0,
    suffix: str = ".txt", mode: str = "error",
) -> str:
    """The folder `path` with one file: `opening`, the files at `parts` in order of their names
    without the first `skip` bytes of all, and `closing`.

    What has to be sorted was sorted by many tasks; the task that writes the file copies bytes and
    holds PIECE_BYTES of them. Each attempt has a file of its own, the driver takes that of the last.
    """
    names = [name for name, size in listing(spark, parts) if size]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "overwrite":
        files.delete(target, True)
    place = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)

    def write(staged: str) -> None:
        files.mkdirs(place(staged))
        folder = files.getFileStatus(place(staged)).getPath().toString()

        def copy(batches):
            for batch in batches:
                for _ in range(batch.num_rows):
                    made = f"{folder}/_{uuid.uuid4().hex}"
                    with open_output(made) as out:
                        out.write(opening.encode("utf-8"))
                        left = skip
                        for name in names:
                            with open_file(name) as part:
                                left -= len(part.read(left)) if left else 0
                                while data := part.read(PIECE_BYTES):
                                    out.write(data)
                        out.write(closing.encode("utf-8"))
                    yield pa.RecordBatch.from_pydict({"made": [made]})

        made = spark.range(1).coalesce(1).mapInArrow(copy, "made string").first()["made"]
        if not files.rename(place(made), place(f"{staged}/part-00000{suffix}")):
            raise OSError(f"{made} could not be renamed")
        for status in files.listStatus(place(staged)):
            if status.getPath().getName().startswith("_"):
                files.delete(status.getPath(), True)

    publish(spark, path, write, lambda staged: None)
    files.delete(place(parts), True)
    return path


def publish(spark: SparkSession, path: str, write: Callable[[str], object], check: Callable[[str], object]):
    """`write` to a staging folder beside `path`, `check` what lies there, then rename it.

    `path` must not exist. Whatever fails, nothing new is left; returns what `check` returned.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(staged)
    try:
        write(staged)
        found = check(staged)
        if files.exists(target) or not files.rename(place, target):
            raise FileExistsError(path)
        return found
    finally:
        files.delete(place, True)


def write_events_csv(events: DataFrame, path: str, **kw) -> str:
    return write_csv(events, path, EVENT_COLUMNS, **kw)


def write_review_queue(queue: DataFrame, path: str, **kw) -> str:
    return write_csv(in_order(queue, "record_index"), path, REVIEW_QUEUE_COLUMNS, **kw)


def write_evaluation_csv(rows: DataFrame, path: str, **kw) -> str:
    """Evaluation rows with their evidence as JSON text."""
    return write_csv(rows.withColumn("evidence", F.to_json("evidence")), path, EVALUATION_COLUMNS, **kw)


def inference_documents(
    media: DataFrame, events: DataFrame, windows: DataFrame, *,
    model_version: str, settings: Mapping[str, object], part_rows: int = 100_000,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """JSON documents (video_id, part, document) with a video's events and windows. Long
    videos get several parts of bounded size instead of one unbounded list."""
    def parts(rows, order, item, name):
        numbered = order_by_key(rows, ("video_id",), order, max_rows=max_rows).scan(number="__n").rows()
        return (
            numbered.groupBy("video_id", int_div(F.col("__n") - 1, part_rows).alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct("__n", item.alias("x")))).alias("l"))
            .select("video_id", "part", F.transform("l", lambda e: e["x"]).alias(name))
        )

    event_item = F.struct(*[F.col(c) for c in EVENT_COLUMNS])
    window_item = F.struct(
        us_to_seconds("start_us").alias("start_seconds"), us_to_seconds("end_us").alias("end_seconds"),
        F.col("action"), (F.col("conf_micro") / F.lit(1e6)).alias("confidence"),
    )
    scored = parts(windows, ("start_us", "end_us", "ordinal"), window_item, "windows")
    # ids are numbers of at least six digits: the longer one is the larger
    placed = events.withColumn("__digits", F.length("event_id"))
    merged = parts(placed, ("start_ms", "__digits", "event_id"), event_item, "events")
    heads = media.select("video_id", F.struct(*[F.col(c) for c in media.columns]).alias("video"))
    body = scored.join(merged, ["video_id", "part"], "full_outer").join(heads, "video_id")
    document = F.struct(
        F.lit(1).alias("format_version"), "video", F.lit(model_version).alias("model_version"),
        F.parse_json(F.lit(json.dumps(dict(settings)))).alias("settings"),
        F.coalesce("events", F.array()).alias("events"), F.coalesce("windows", F.array()).alias("windows"),
    )
    return body.select("video_id", "part", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def write_documents(documents: DataFrame, path: str, *, inputs: Iterable[str] = (), mode: str = "error") -> str:
    output_apart_from_inputs(path, inputs)
    documents.select(F.col("document").alias("value")).write.mode(mode).text(path)
    return path


def write_list_document(
    head: Mapping[str, object], field: str, items: DataFrame, path: str, *, inputs: Iterable[str] = (), mode: str = "error",
) -> str:
    """One JSON object: the fields of `head` and the list `field` of the texts `item` of `items`,
    by `position`. Many tasks sort and write ranges of the items; a document is one file, so one
    task copies these, piece by piece (see `join_parts`)."""
    output_apart_from_inputs(path, inputs)
    opening = json.dumps(dict(head), ensure_ascii=False)[:-1] + (", " if head else "") + json.dumps(field) + ": ["
    lines = items.select(F.col("position").cast("long").alias("position"), F.concat(F.lit(","), "item").alias("value"))
    parts = scratch_path(items.sparkSession, "items")
    in_order(lines, "position").select("value").write.text(parts)
    # the first item has no comma before it
    return join_parts(items.sparkSession, parts, path, opening=opening + "\n", closing="]}\n", skip=1, mode=mode)


def write_record(spark: SparkSession, record: Mapping[str, object], path: str, *, mode: str = "error") -> str:
    """One JSON object: run settings, metrics, report heads."""
    spark.range(1).coalesce(1).select(
        F.lit(json.dumps(record, ensure_ascii=False, sort_keys=True)).alias("value")
    ).write.mode(mode).text(path)
    return path


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
