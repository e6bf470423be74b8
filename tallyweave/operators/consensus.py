"""Agreement between several reads of the same value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import best


def modal(df: DataFrame, keys: Sequence[str], value: str, strength: str) -> DataFrame:
    """(keys, value, n, strength): the most frequent value; then the mean strength, then the value decide."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.round(F.avg(strength), 4).alias("strength"))
    return best(counted, keys, [F.desc("n"), F.desc("strength"), F.asc(value)])


def weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """(keys, value, weight): the value with the largest sum of weights, then the larger value."""
    summed = df.groupBy(*keys, value).agg(F.sum(weight).alias("weight"))
    return best(summed, keys, [F.desc("weight"), F.desc(value)])


def priority(family: Column, order: Mapping[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[family], F.lit(len(order)))


def majority(df: DataFrame, keys: Sequence[str], family: str, value: str, confidence: str, order: Mapping[str, int]) -> DataFrame:
    """(keys, value, reads, families, confidence, values): the value most reads agree on.

    Then the number of different families, the confidence and the best
    family's priority decide.  ``values`` counts the different ones.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("reads"), F.countDistinct(family).alias("families"), F.max(confidence).alias("confidence"), F.min(priority(F.col(family), order)).alias("__p"))
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("values"))
    top = best(counted, keys, [F.desc("reads"), F.desc("families"), F.desc("confidence"), F.asc("__p"), F.asc(value)]).drop("__p")
    return top.join(sizes, list(keys))


def resolved(hits: DataFrame, keys: Sequence[str], value: str, confidence: str, least: int, conflict: int = 12, largest: Sequence[str] = (), field: str = "field_id") -> DataFrame:
    """(keys, value, confidence, conflicted): the consensus of hits above a threshold.

    Fields in ``largest`` take their largest value instead of the modal one;
    where values differ the confidence falls by ``conflict``.
    """
    counted = hits.groupBy(*keys, value).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 4).alias("mean"), F.max(confidence).alias("top"))
    sizes = counted.groupBy(*keys).agg((F.count("*") > 1).alias("conflicted"))
    by_size = F.when(F.col(field).isin(*largest), F.col(value)) if largest else F.lit(None).cast("long")
    top = best(counted, keys, [F.desc_nulls_last(by_size), F.desc("n"), F.desc("mean"), F.asc(value)]).join(sizes, list(keys))
    out = top.withColumn("confidence", F.col("top") - F.when(F.col("conflicted"), conflict).otherwise(0))
    return out.where(F.col("confidence") >= least).select(*keys, value, "confidence", "conflicted")


def disagreement(snapshots: DataFrame, keys: Sequence[str], family: str, value: str, current: str) -> DataFrame:
    """(keys, agreeing, differing, material): whether other families speak against the current value."""
    agree = F.countDistinct(F.when(F.col(value) == F.col(current), F.col(family)))
    differ = F.countDistinct(F.when(F.col(value) != F.col(current), F.col(family)))
    out = snapshots.groupBy(*keys).agg(agree.alias("agreeing"), differ.alias("differing"))
    return out.withColumn("material", (F.col("agreeing") + F.col("differing") >= 2) & (F.col("agreeing") < 2) & (F.col("differing") > 0))
