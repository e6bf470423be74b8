"""The append-only log of corrections, as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, created_at timestamp, client_key string, year int, field_id string, parser_value bigint, corrected_value bigint, chosen_source string, rejected array<struct<value: bigint, source: string, valid: boolean>>"
KEPT = 500


def append(events: DataFrame, path: str) -> None:
    """Append events that have a field, a year and a value."""
    events.where("field_id is not null and year is not null and corrected_value is not null").write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def newest(events: DataFrame, n: int = KEPT, keys: tuple[str, ...] = ("client_key",)) -> DataFrame:
    """The last ``n`` events of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    return events.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
