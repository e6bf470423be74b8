"""Merging versions of the same facts: tiers, upserts, backfills, corrections."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import best


class Tier(NamedTuple):
    """Reads of a tier count from ``least`` confidence on; an authoritative one beats all others."""

    name: str
    least: int
    authoritative: bool = False


def tiered(reads: DataFrame, keys: Sequence[str], tiers: Sequence[Tier], tier: str = "tier", confidence: str = "confidence") -> DataFrame:
    """The winning read of each key; ``tiers`` go from low to high.

    Authoritative tiers win over others, the higher one first; then the
    confidence decides, and of equal ones the higher tier.
    """
    spec = reads.sparkSession.createDataFrame([(t.name, t.least, t.authoritative, i) for i, t in enumerate(tiers)], "__tier string, __least int, __auth boolean, __rank int")
    known = reads.join(F.broadcast(spec), F.col(tier) == F.col("__tier")).where(F.col(confidence) >= F.col("__least"))
    order = [F.desc("__auth"), F.desc(F.when(F.col("__auth"), F.col("__rank"))), F.desc(confidence), F.desc("__rank")]
    return best(known, keys, order).drop("__tier", "__least", "__auth", "__rank")


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], value: str = "value", confidence: str = "confidence", protected: str | None = None) -> DataFrame:
    """(keys, value, confidence): full outer merge.

    The incoming value wins where there is none yet or its confidence is as
    high at least; protected (edited) rows stay.
    """
    b = base.select(*keys, F.col(value).alias("b_value"), F.col(confidence).alias("b_conf"), (F.coalesce(F.col(protected), F.lit(False)) if protected else F.lit(False)).alias("b_edited"))
    i = incoming.select(*keys, F.col(value).alias("i_value"), F.col(confidence).alias("i_conf"))
    wins = F.col("i_value").isNotNull() & ~F.coalesce("b_edited", F.lit(False)) & (F.col("b_value").isNull() | (F.col("i_conf") >= F.coalesce("b_conf", F.lit(-1))))
    pick = lambda c: F.when(wins, F.col(f"i_{c}")).otherwise(F.col(f"b_{c}"))
    return b.join(i, list(keys), "full_outer").select(*keys, pick("value").alias(value), pick("conf").alias(confidence))


def backfilled(df: DataFrame, keys: Sequence[str], period: str, value: str, prior: str) -> DataFrame:
    """Missing values from what the next period's record says of its prior one."""
    after = df.select(*keys, (F.col(period) - 1).alias(period), F.col(prior).alias("__prior"))
    return df.join(after, [*keys, period], "left").withColumn(value, F.coalesce(value, "__prior")).drop("__prior")


def corrected(base: DataFrame, events: DataFrame, keys: Sequence[str], value: str, event_value: str, order: Sequence[str]) -> DataFrame:
    """(keys, value, edited): the latest event of each key over the base."""
    last = events.groupBy(*keys).agg(F.max_by(event_value, F.struct(*order)).alias("__v"))
    return base.join(last, list(keys), "left").select(*keys, F.coalesce("__v", F.col(value)).alias(value), F.col("__v").isNotNull().alias("edited"))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return best(df, keys, [F.asc(c) for c in order])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return best(df, keys, [F.desc(c) for c in order])


def chosen_pages(left: DataFrame, right: DataFrame, keys: Sequence[str], score: str = "score", gain: float = 8, weak: float = 20) -> DataFrame:
    """(keys, side, score): the left page, or the right one where the left is missing or weak and the right gains enough."""
    lr = left.select(*keys, F.col(score).alias("l")).join(right.select(*keys, F.col(score).alias("r")), list(keys), "full_outer")
    take_right = F.col("l").isNull() | ((F.col("l") < weak) & F.col("r").isNotNull() & (F.col("r") >= F.col("l") + gain))
    return lr.select(*keys, F.when(take_right, "right").otherwise("left").alias("side"), F.when(take_right, F.col("r")).otherwise(F.col("l")).alias(score))


def missing_pages(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are wanted and not done."""
    return wanted.select(*keys).distinct().join(done.select(*keys).distinct(), list(keys), "left_anti")


def switched(base: DataFrame, incoming: DataFrame, client: str, period: str) -> DataFrame:
    """The base without the periods that another client's incoming records take over."""
    taken = incoming.select(F.col(client).alias("__c"), F.col(period).alias("__p")).distinct()
    return base.join(taken, (F.col(period) == F.col("__p")) & (F.col(client) != F.col("__c")), "left_anti")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, into: str) -> DataFrame:
    """The last label before each row, itself included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into, F.last(label, ignorenulls=True).over(w))
