"""Rows dealt out for costly steps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt over all cores for a costly step.

    With ``keys`` by them, for windows that need that shuffle anyway and would
    else run in as few tasks as the rows' size asks for; several for each core,
    as they widen the rows.  Rows that a window has dealt by the same keys
    before stay as they lie, so this comes first.  Without ``keys``, only where
    the files make fewer splits than there are cores.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if keys:
        return rows.repartition(max(16 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def beside(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``other``'s row of the same keys, if any; ``other`` has one for each.

    A left join by a union and a window: where both were dealt by some of the
    keys they stay as they lie, which a join on all of them does not allow.
    """
    theirs = F.struct(*[c for c in other.columns if c not in keys])
    both = rows.withColumn("__mine", F.lit(True)).unionByName(other.select(*keys, theirs.alias("__other"), F.lit(False).alias("__mine")), allowMissingColumns=True)
    w = Window.partitionBy(*keys, F.when(~known(keys), F.col("__mine")))  # unknown keys meet nothing
    return both.withColumn("__other", F.max("__other").over(w)).where("__mine").select(*rows.columns, "__other.*")
