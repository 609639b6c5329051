"""What the operators share: inputs, stored tables, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actiongrid.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this package; `sql` is its twin where SQL can express it."""

    def wrap(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of `docs`: a null text is empty, all other columns are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends at replicated files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(id_col: str, modulus: int, remainder: int):
    """True where crc32 of the id's text leaves `remainder`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def bounded_sample(rows: DataFrame, by: str, per_group: int, key: str, seed: int = 11, groups: int = 1000) -> DataFrame:
    """At most `per_group` rows of each of the `groups` most frequent values of `by`, always the same.

    Rows are drawn by a hash of `key`; a share a little above what is wanted is kept first, so
    that the ranking which makes the bound exact sees no more than that.
    """
    sizes = F.broadcast(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), by).limit(groups))
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1).cast("double") / float(1 << 63)
    near = rows.join(sizes, by).withColumn("_draw", draw).where(F.col("_draw") * F.col("_n") < 1.2 * per_group + 50)
    rest = [F.xxhash64(c) for c in rows.columns]
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy("_draw", key, *rest)))
    return ranked.where(F.col("_rank") <= per_group).select(*rows.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected `edges`; root is the smallest node reachable.

    Alternates two star contractions: every node hands its larger neighbours to the smallest
    node it knows, then its smaller ones. Degrees stay bounded by partial aggregation and joins;
    no neighbour list is gathered. Each round is a stored table, so a lost executor costs only
    the round it worked on.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    pairs = stored(pairs, "links")
    state = _state(pairs)
    while True:
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        large = _stars(both).where("v > u").select(F.least("m", "v").alias("lo"), F.greatest("m", "v").alias("hi"))
        large = stored(large.where("lo < hi").distinct(), "links")
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        small = _stars(down).select(F.col("m").alias("lo"), "v").unionByName(
            down.groupBy("u").agg(F.min("v").alias("lo")).select("lo", F.col("u").alias("v"))
        )
        pairs = stored(small.where("lo < v").select("lo", F.col("v").alias("hi")).distinct(), "links")
        before, state = state, _state(pairs)
        if state == before:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )


def _stars(directed: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the smallest of u and its neighbours in `directed`.

    The key of the small side is an expression, so that Spark deals out both sides anew and
    may split the rows of a hub.
    """
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select((F.col("u") + F.lit(0)).alias("k"), F.least("u", "m").alias("m"))
    return directed.join(least, F.col("u") == F.col("k")).drop("k")


def _state(pairs: DataFrame):
    row = pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(lo, hi))"), F.expr("sum(cast(xxhash64(lo, hi, 7) as decimal(20)))")).first()
    return tuple(row)
