"""Keyed state of a stream as a log of tables.

A batch writes, for the keys it touched, their whole new state under its own number; what it
writes grows with the batch and not with all keys ever seen. Of every key the entry of the latest
batch counts. The first table of the log (the head) has one row a key, the others any number.
Every so many batches the log is folded into one snapshot, and what only older readers needed is
deleted: a batch that is taken again finds the state before it, because the last snapshot but one
and all entries since stay.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_EVERY = 16
NUMBER = "__batch"


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class StateLog:
    def __init__(self, spark: SparkSession, base: str, key: str, tables: Mapping[str, str], compact_every: int = COMPACT_EVERY):
        self.spark, self.base, self.key, self.tables = spark, base, key, dict(tables)
        self.head, self.every = next(iter(self.tables)), compact_every

    def _numbers(self, kind: str) -> list[int]:
        """Complete batches or snapshots of the log: those whose last table was committed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{[*self.tables][-1]}/{kind}=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or ()
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def _entries(self, name: str, batch: int, whole: int) -> DataFrame:
        """(columns of the table, __batch) of all entries before `batch`, superseded ones included,
        from the last snapshot before `whole` on."""
        snapshots = [n for n in self._numbers("upto") if n < whole]
        since = snapshots[-1] if snapshots else -1
        paths = [f"{self.base}/{name}/upto={since}"] if snapshots else []
        paths += [f"{self.base}/{name}/batch={n}" for n in self._numbers("batch") if since < n < batch]
        schema = f"{self.tables[name]}, {NUMBER} long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _latest(self, batch: int, whole: int, keys: DataFrame | None) -> dict[str, DataFrame]:
        """All tables as they are before `batch`, with the number of each row's batch."""
        wanted = (lambda df: df) if keys is None else (lambda df: df.join(keys, self.key, "left_semi"))
        head = wanted(self._entries(self.head, batch, whole))
        rest = [c for c in head.columns if c not in (self.key, NUMBER)]
        newest = head.groupBy(self.key).agg(F.max_by(F.struct(*rest, NUMBER), NUMBER).alias("s"))
        out = {self.head: newest.select(self.key, *[F.col(f"s.{c}").alias(c) for c in (*rest, NUMBER)])}
        at = out[self.head].select(self.key, NUMBER)
        for name in list(self.tables)[1:]:
            out[name] = wanted(self._entries(name, batch, whole)).join(at, [self.key, NUMBER], "left_semi")
        return out

    def before(self, batch: int, keys: DataFrame | None = None) -> dict[str, DataFrame]:
        """The tables as they were before `batch`, of the given keys (a column, distinct) or all."""
        return {name: df.drop(NUMBER) for name, df in self._latest(batch, batch, keys).items()}

    def write(self, batch: int, tables: Mapping[str, DataFrame]) -> None:
        """The new state of the keys in the head; a key's rows in the other tables are all it has."""
        for name in self.tables:
            df = tables[name].withColumn(NUMBER, F.lit(batch).cast("long"))
            df.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={batch}")

    def compact(self, batch: int) -> None:
        """Every so many batches: one snapshot of what holds after `batch`."""
        if (batch + 1) % self.every:
            return
        earlier = [n for n in self._numbers("upto") if n < batch]
        # a snapshot that a first attempt left is written anew, so it is not read
        for name, df in self._latest(batch + 1, batch, None).items():
            df.write.mode("overwrite").parquet(f"{self.base}/{name}/upto={batch}")
        for name in self.tables:
            for n in earlier[:-1]:
                delete(self.spark, f"{self.base}/{name}/upto={n}")
            for n in self._numbers("batch"):
                if earlier and n <= earlier[-1]:
                    delete(self.spark, f"{self.base}/{name}/batch={n}")
