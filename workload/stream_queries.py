"""Streaming forms and model fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.operators.training import epoch_scores, fit_epochs, fit_window_classifier
from actiongrid.session import scratch_path
from actiongrid.streaming.merge import MergeSettings, closed_events, finish, start_merge_stream
from actiongrid.streaming.validate import leaks_so_far, start_leakage, start_validation

from .bindings import HOUR, WINDOWS_SQL, islands_sql, manifest_rows, manifest_sql, windows
from .registry import query, table


@query("stream_merge", islands_sql(WINDOWS_SQL, 300_000, 12 * HOUR, 60_000_000)
       + " select video_id, event_no, start_us, end_us, action, conf_sum, n_windows from merged")
def stream_merge(spark, folder):
    """All windows arrive in four steps in time order, each read by a restarted stream; the
    closed events equal batch."""
    rows = windows(spark, folder)
    source, base = scratch_path(spark, "arrivals"), scratch_path(spark, "merge")
    day = F.floor(F.col("start_us") / (24 * HOUR))
    settings = MergeSettings.of(confidence_threshold=0.3, merge_gap_seconds=12 * 3600.0, min_event_seconds=60.0)
    checkpoint = scratch_path(spark, "checkpoint")
    for step in (day < 8, (day >= 8) & (day < 16), (day >= 16) & (day < 24), day >= 24):
        rows.where(step).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(rows.schema).parquet(source)
        running = start_merge_stream(arriving, base, settings, checkpoint=checkpoint)
        running.awaitTermination()
    finish(spark, base, running.lastProgress["batchId"], settings, rows.schema)
    return closed_events(spark, base)


@query("stream_validation", f"with {manifest_sql()} select code, count(*) as n from m group by code")
def stream_validation(spark, folder):
    rows = manifest_rows(spark, folder)
    source, good, bad = (scratch_path(spark, n) for n in ("rows", "good", "bad"))
    rows.write.parquet(source)
    arriving = spark.readStream.schema(rows.schema).parquet(source)
    start_validation(arriving, good, bad, checkpoint=scratch_path(spark, "checkpoint"), video_root="/media").awaitTermination()
    broken = spark.read.parquet(bad).select(F.col("errors")[0]["code"].alias("code"))
    fine = spark.read.parquet(good).select(F.lit(None).cast("string").alias("code"))
    return broken.unionByName(fine).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("stream_split_leakage", f"""with {manifest_sql()}
select video_path, string_agg(distinct split, ',' order by split) as splits
from m where split in ('train', 'val', 'test') group by video_path having count(distinct split) > 1""")
def stream_split_leakage(spark, folder):
    """All rows arrive in four batches, each read by a restarted stream; what leaks equals batch."""
    rows = manifest_rows(spark, folder)
    source, base, checkpoint = (scratch_path(spark, n) for n in ("arrivals", "leakage", "checkpoint"))
    for part in range(4):
        rows.where(F.pmod(F.floor(F.col("record_index") / 7), F.lit(4)) == part).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(rows.schema).parquet(source)
        running = start_leakage(arriving, base, checkpoint=checkpoint, video_root="/media", compact_every=2)
        running.awaitTermination()
    return leaks_so_far(spark, base, running.lastProgress["batchId"]).withColumn("splits", F.array_join("splits", ","))


def _vectors(spark, folder):
    """(features, label, split) of every vector, and the labels."""
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, folder, "embeddings").select(
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
        F.concat(F.lit("c"), F.col("label")).alias("label"),
        F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"))
    return rows, tuple(f"c{i}" for i in range(10))


@query("train_eval", """
select case when vec_id % 5 = 0 then 'val' else 'train' end as split, count(*) as samples, 2 as epochs from embeddings group by 1""")
def train_eval(spark, folder):
    """Classify vectors with class weights: what was evaluated after each epoch. `train_scores`
    gives the scores."""
    rows, labels = _vectors(spark, folder)
    _, report = fit_window_classifier(rows, labels, max_iterations=(2, 5))
    seen = [(s, h[s]["samples"]) for h in report["history"] for s in ("train", "val")]
    return spark.createDataFrame(seen, "split string, samples long").groupBy("split", "samples").agg(
        F.count(F.lit(1)).cast("int").alias("epochs"))


@query("train_scores")
def train_scores(spark, folder):
    """Losses and scores per epoch and split of a fit that goes on from epoch to epoch, and whether
    they beat the majority class (no SQL twin: SQL fits no model)."""
    rows, labels = _vectors(spark, folder)
    _, _, report = fit_epochs(rows, labels, epochs=2, steps=4, block_rows=256)
    return epoch_scores(rows, report)
