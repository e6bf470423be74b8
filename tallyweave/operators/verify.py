"""Checks of resolved facts: changes, gaps, trust, confidence, calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_flags(df: DataFrame, keys: Sequence[str], period: str, value: str, ratio: float = 5, least: float = 1000) -> DataFrame:
    """``df`` with ``flags``: jumps against the neighbouring periods that are there, on both sides of each.

    ``jump`` is a change by ``ratio`` times or more, ``zero`` a change from or
    to 0, ``sign`` a change of sign; small amounts are never flagged.
    """
    w = Window.partitionBy(*keys).orderBy(period)

    def against(other: Column) -> Column:
        v = F.col(value)
        big = F.greatest(F.abs(v), F.abs(other)) >= least
        return F.array_compact(
            F.array(
                F.when(big & (v * other < 0), F.lit("sign")),
                F.when(big & ((v == 0) != (other == 0)), F.lit("zero")),
                F.when(big & (v * other > 0) & (F.greatest(F.abs(v), F.abs(other)) >= ratio * F.least(F.abs(v), F.abs(other))), F.lit("jump")),
            )
        )

    sides = F.array_union(F.coalesce(against(F.lag(value).over(w)), F.array().cast("array<string>")), F.coalesce(against(F.lead(value).over(w)), F.array().cast("array<string>")))
    return df.withColumn("flags", F.array_sort(sides))


def gaps(catalogue: DataFrame, values: DataFrame, keys: Sequence[str], value: str, confidence: str, least: int = 72) -> DataFrame:
    """(keys, reason): catalogue entries without a value or with one of low confidence."""
    joined = catalogue.join(values, list(keys), "left")
    reason = F.when(F.col(value).isNull(), "missing").when(F.coalesce(F.col(confidence), F.lit(0)) < least, "low confidence")
    return joined.withColumn("reason", reason).where("reason is not null").select(*keys, "reason")


def decided(decisions: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first condition of an ordered decision list that holds."""
    chain = F.when(decisions[0][1], F.lit(decisions[0][0]))
    for name, condition in decisions[1:]:
        chain = chain.when(condition, F.lit(name))
    return chain.otherwise(F.lit(otherwise))


def capped(df: DataFrame, confidence: str, flags: str, caps: Mapping[str, int]) -> DataFrame:
    """Confidence lowered to the smallest cap of the row's flags (an array)."""
    each = F.transform(F.col(flags), lambda f: F.coalesce(*[F.when(f == name, F.lit(cap)) for name, cap in caps.items()]))
    return df.withColumn(confidence, F.least(F.col(confidence), F.array_min(each)))


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 10, top: int = 100) -> DataFrame:
    """(bin, n, correct, rate): how often values of each confidence range are right."""
    at = F.least(F.floor(F.col(confidence) * bins / top), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("correct"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("rate"))


def scored_kind(text: Column, kinds: Mapping[str, Mapping[str, int]], least: int = 2, lead: int = 1, otherwise: str = "unknown") -> Column:
    """The kind with the highest sum of weights of its patterns' matches, if it is clear.

    It needs ``least`` points and ``lead`` more than the next; ties go nowhere.
    """
    scores = F.array(*[F.struct(sum((F.regexp_count(text, F.lit(p)) * w for p, w in rules.items()), F.lit(0)).alias("score"), F.lit(kind).alias("kind")) for kind, rules in kinds.items()])

    def clear(ranked: Column) -> Column:
        top, next_one = F.get(ranked, 0), F.coalesce(F.get(ranked, 1)["score"], F.lit(0))
        return F.when((top["score"] >= least) & (top["score"] - next_one >= lead), top["kind"]).otherwise(F.lit(otherwise))

    # Bound as a lambda's variable, the scores are computed once.
    return F.get(F.transform(F.array(F.sort_array(scores, asc=False)), clear), 0)


def inferred_year(text: Column, phrases: Sequence[str], file_name: Column | None = None) -> Column:
    """The year a text is about: the first phrase that names one, else the most frequent (then latest) year in it, else the file's."""
    named = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in phrases]
    years = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1))
    counted = F.transform(F.array_distinct(years), lambda y: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), y.alias("y")))
    own = F.nullif(F.regexp_extract(file_name, r"((?:19|20)\d\d)", 1), F.lit("")) if file_name is not None else F.lit(None).cast("string")
    return F.coalesce(*named, F.array_max(counted)["y"], own).cast("int")
