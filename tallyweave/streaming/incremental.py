"""Incremental variants: results equal the batch ones over the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import upsert


class VersionedTable:
    """A Parquet table as numbered versions in one folder.

    A batch reads the newest version below its own number and writes the one
    of its number, so a batch that is run again replaces its own version and
    nothing is merged twice.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found.append(int(name[1:]))
        return sorted(found)

    def read(self, below: int | None = None) -> DataFrame:
        there = [v for v in self.versions() if below is None or v < below]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{there[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        """Write a version and drop those that no re-run can ask for: all below the one before it."""
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        jvm = self.spark.sparkContext._jvm
        for old in [v for v in self.versions() if v < version][:-1]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def upsert_stream(stream: DataFrame, table: VersionedTable, keys: Sequence[str], value: str, confidence: str, order: Sequence[str], checkpoint: str):
    """Merge each micro-batch into the table as ``upsert`` merges it; returns the started query.

    Within a batch the row of the highest confidence and then the latest
    ``order`` counts, as it would if rows came one by one.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = F.max_by(F.struct(value, confidence), F.struct(confidence, *order)).alias("w")
        one = batch.groupBy(*keys).agg(last).select(*keys, "w.*")
        table.write(upsert(table.read(below=batch_id), one, keys, value, confidence), batch_id)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(stream: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, value): the latest value of each key, as a streaming aggregate."""
    return stream.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def windowed_counts(events: DataFrame, time: str, width: str, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """Counts by tumbling windows with a watermark, over a stream or a table."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def progressive(state: DataFrame, tiers: Sequence[Callable[[DataFrame], DataFrame]], gaps: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], table: VersionedTable) -> DataFrame:
    """Run dearer tiers only on what is still missing, until nothing is or a tier brings no more.

    The state is written once for each tier, so a tier is not run again by
    the counts and tiers after it.
    """
    left = gaps(state).count()
    for n, tier in enumerate(tiers):
        if not left:
            break
        table.write(merge(state, tier(gaps(state))), n)
        state = table.read()
        now = gaps(state).count()
        if now >= left:
            break
        left = now
    return state
