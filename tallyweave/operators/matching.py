"""Matching rows of two sets, or of one with itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def multiset_match(expected: DataFrame, actual: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """(keys, expected, actual, matched, surplus): multiset intersection by counts, without pairing rows."""
    e = expected.groupBy(*keys, amount).agg(F.count("*").alias("e"))
    a = actual.groupBy(*keys, amount).agg(F.count("*").alias("a"))
    both = e.join(a, [*keys, amount], "full_outer").fillna(0, ["e", "a"])
    return both.groupBy(*keys).agg(F.sum("e").alias("expected"), F.sum("a").alias("actual"), F.sum(F.least("e", "a")).alias("matched"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("surplus"))


def nearest(df: DataFrame, keys: Sequence[str], row: str, amount: str, target: str) -> DataFrame:
    """(keys, row, amount): the row of each key whose amount is closest to the key's target, then the smaller row."""
    pick = F.min_by(F.struct(row, amount), F.struct(F.abs(F.col(amount) - F.col(target)), F.col(row)))
    return df.groupBy(*keys).agg(pick.alias("p")).select(*keys, f"p.{row}", f"p.{amount}")


def without_larger(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Rows for which no other row of the key has a larger amount: an anti join on an inequality, by the key's maximum."""
    w = Window.partitionBy(*keys)
    return df.withColumn("__most", F.max(amount).over(w)).where(F.col(amount) == F.col("__most")).drop("__most")


def with_other(df: DataFrame, keys: Sequence[str], row: str, flag: str) -> DataFrame:
    """Rows for which another row of the key has ``flag``: counts decide, no self join."""
    w = Window.partitionBy(*keys)
    others = F.sum(F.col(flag).cast("int")).over(w) - F.col(flag).cast("int")
    return df.withColumn("__o", others).where("__o > 0").drop("__o")


def pattern_hits(lines: DataFrame, rules: Sequence[tuple[str, str]], line: str = "line") -> DataFrame:
    """(columns, rule): every line with each (name, pattern) rule that it matches.

    Rules are literals, so all patterns are compiled once and a line is read
    in one pass without joining lines to a table of patterns.
    """
    hits = F.array_compact(F.array(*[F.when(F.col(line).rlike(p), F.lit(name)) for name, p in rules]))
    return lines.withColumn("rule", F.explode(hits))


def share_tokens(a: str, b: str, generic: Sequence[str] = (), least: int = 3):
    """Whether two names share a telling word or one holds the other."""
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: (F.length(w) >= least) & ~w.isin(*generic) if generic else F.length(w) >= least)
    return F.arrays_overlap(words(a), words(b)) | F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a))
