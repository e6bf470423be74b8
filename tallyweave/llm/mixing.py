"""Mixing sources to target weights, in DataFrame functions only.

Token counts per (source, language, topic) are raked to target marginals by
iterative proportional fitting; a document is then sampled with its cell's
probability by a hash of its id, so the sample does not depend on partitions.

The weights are the tokens that the sample shall have of each cell, so none
exceeds what the cell has: every step of the fitting scales one marginal to its
target and cuts what is too much, and the next round makes up for it elsewhere.
The targets themselves are within reach of each category: what a small one
lacks is shared out among the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import free_name, prepare, written

WORD = r"[^\x20\x09-\x0D]+"
#: Exponents of the tempered targets: 1 keeps a marginal, 0 makes it even.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: The fitting ends when no marginal is off by more than EXACT of its target, or after so many rounds.
ROUNDS, ROUNDS_A_TABLE, EXACT = 24, 12, 1e-10
RATE = 0.8
#: Cells up to here are broadcast to the documents; beyond, that join is shuffled.
BROADCAST_CELLS = 1_000_000
#: So few narrow cells are raked in one task, without moving them for each marginal.
CELLS_A_TASK = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shape(text: Column, n: Column) -> Column:
    """A stand-in for topics where a table has none: the kind of a text of ``n`` words."""
    lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"))), F.lit(0)) + 1
    return F.when(n < 50, "note").when(lines * 12 >= n, "list").when(n >= 1000, "long read").otherwise("article")


def target_of(cells: DataFrame, d: str, power: float, total: float) -> DataFrame:
    """(category, goal): tokens that the sample shall have of each category of ``d``.

    Tempered shares of ``total``; categories that have less than their share
    give all, those with the smallest ratio of tokens to share first.
    """
    m = cells.groupBy(F.col(d).alias("category")).agg(F.sum("tokens").cast("double").alias("mass"))
    every, upto = Window.partitionBy(), Window.orderBy("ratio", "category")
    m = m.withColumn("share", F.pow("mass", F.lit(power))).withColumn("share", F.col("share") / F.sum("share").over(every)).withColumn("ratio", F.col("mass") / F.col("share"))
    taken, left = F.coalesce(F.sum("mass").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.sum("share").over(upto.rowsBetween(0, Window.unboundedFollowing))
    m = m.withColumn("scale", (F.lit(total) - taken) / left)
    scale = F.first(F.when(F.col("scale") <= F.col("ratio"), F.col("scale")), ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return m.select("category", F.least(F.col("mass"), F.coalesce(scale, F.col("ratio")) * F.col("share")).alias(f"goal_{d}"))


def raked(cells: DataFrame, rate: float = RATE, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``: the tokens to be drawn of each."""
    total = rate * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells
    for d, power in temper.items():
        goal = target_of(cells, d, power, total)
        now = now.join(goal, now[d].eqNullSafe(goal["category"])).drop("category")
    now = written(now.withColumn("weight", F.col("tokens").cast("double")), "cells")
    few = now.count() <= CELLS_A_TASK
    for r in range(0, rounds, ROUNDS_A_TABLE):
        now = now.coalesce(1) if few else now
        for _ in range(min(ROUNDS_A_TABLE, rounds - r)):
            for d in temper:
                now = now.withColumn("weight", step(d))
        now = written(now, "raked")
        if worst(now, temper) <= EXACT:
            break
    return now


def step(d: str) -> Column:
    """Weights scaled to the targets of ``d``, and cut at what there is."""
    return F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"goal_{d}") / F.sum("weight").over(Window.partitionBy(d)))


def worst(cells: DataFrame, temper: dict[str, float] = TEMPER) -> float:
    """The largest relative distance of a marginal from its target."""
    off = None
    for d in temper:
        one = cells.groupBy(d).agg(F.max(f"goal_{d}").alias("goal"), F.sum("weight").alias("have")).select((F.abs(F.col("have") - F.col("goal")) / F.col("goal")).alias("off"))
        off = one if off is None else off.unionByName(one)
    return float(off.agg(F.max("off")).first()[0] or 0)


def drawn(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed))))
    return F.round(F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)), 9)


def with_decisions(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, rate: float = RATE, seed: int = 7) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its topic, tokens, probability and decision under free names.

    Null sources, languages and topics are categories of their own.  Documents
    without words weigh nothing: they come back with p = 1 and are kept.
    Equal ids share their fate; repeated rows count each; very long texts are
    counted whole.
    """
    prepare(df.sparkSession)
    n = {c: free_name(df, f"mix_{c}") for c in ("topic", "tokens", "p", "kept", "s", "l", "t")}
    rows = df.withColumn(n["tokens"], n_words(F.col(text)))
    rows = rows.withColumn(n["topic"], F.col(topic) if topic else shape(F.col(text), F.col(n["tokens"])))
    return decided(rows, n, doc_id, source, lang, rate, seed), n


def decided(rows: DataFrame, n: dict[str, str], doc_id: str, source: str, lang: str, rate: float, seed: int) -> DataFrame:
    """Rows that have tokens and topic, with probability and decision."""
    narrow = rows.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(n["topic"]).alias("topic"), F.col(n["tokens"]).alias("tokens"))
    cells = written(narrow.where("tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "mass")
    p = F.round(F.col("weight") / F.col("tokens"), 6)
    p = written(raked(cells, rate).select(F.col("source").alias(n["s"]), F.col("lang").alias(n["l"]), F.col("topic").alias(n["t"]), p.alias(n["p"])), "odds")
    if p.count() <= BROADCAST_CELLS:
        p = F.broadcast(p)
    rows = rows.join(p, rows[source].eqNullSafe(p[n["s"]]) & rows[lang].eqNullSafe(p[n["l"]]) & rows[n["topic"]].eqNullSafe(p[n["t"]]), "left").drop(n["s"], n["l"], n["t"])
    rows = rows.withColumn(n["p"], F.when(F.col(n["tokens"]) > 0, F.col(n["p"])).otherwise(F.lit(1.0)))
    return rows.withColumn(n["kept"], drawn(F.col(doc_id), seed) < F.col(n["p"]))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``df``, columns unchanged.

    Null sources, languages and topics are categories of their own.  Texts
    without words (null and empty ones too) have no tokens to weigh and stay;
    very long ones count with all their tokens.  The draw depends on the id,
    so rows with equal ids share their fate, whatever their texts; null ids
    are one id.  An empty table gives an empty one.
    """
    rows, n = with_decisions(df, **options)
    return rows.where(F.col(n["kept"])).select(*df.columns)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, rate: float = RATE, seed: int = 7) -> DataFrame:
    """A row for each document: its cell, tokens, probability and decision; texts are read once.

    Null and empty texts have no tokens and are kept; null categories are
    categories; repeated rows come back as often as they are there, with equal
    decisions.  Other columns are not read.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"), n_words(F.col(text)).alias("tokens"), F.col(text).alias("text"), *([F.col(topic).alias("topic")] if topic else []))
    kind = F.col("topic") if topic else shape(F.col("text"), F.col("tokens"))
    rows = written(rows.select("doc_id", "source", "lang", "tokens", kind.alias("topic")), "counted")
    n = {"topic": "topic", "tokens": "tokens", "p": "p", "kept": "kept", "s": "s_", "l": "l_", "t": "t_"}
    return decided(rows, n, "doc_id", "source", "lang", rate, seed).select("doc_id", "source", "lang", "topic", "tokens", "p", "kept")


def sql(rate: float = RATE, seed: int = 7, rounds: int = ROUNDS) -> str:
    """The report of ``documents`` as DuckDB SQL, one step of the fitting at a time."""
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    steps = [
        f"""d as (select doc_id, source, lang, n as tokens, case when n < 50 then 'note' when lines * 12 >= n then 'list' when n >= 1000 then 'long read' else 'article' end as topic
  from (select doc_id, source, lang, {words} as n, coalesce(length(text) - length(replace(text, chr(10), '')), 0) + 1 as lines from documents))""",
        "c as materialized (select source, lang, topic, sum(tokens)::double as tokens from d where tokens > 0 group by all)",
    ]
    for x, power in TEMPER.items():
        steps.append(f"a_{x} as (select *, mass / share as ratio from (select x, mass, pow(mass, {power}) / sum(pow(mass, {power})) over () as share from (select {x} as x, sum(tokens) as mass from c group by 1)))")
        steps.append(f"b_{x} as (select *, ({rate} * sum(mass) over () - coalesce(sum(mass) over (order by ratio, x rows between unbounded preceding and 1 preceding), 0)) / sum(share) over (order by ratio, x rows between current row and unbounded following) as scale from a_{x})")
        steps.append(f"m_{x} as materialized (select x, least(mass, share * coalesce((select arg_min(scale, ratio) from b_{x} where scale <= ratio), ratio)) as goal from b_{x})")
    joins = " ".join(f"join m_{x} on c.{x} is not distinct from m_{x}.x" for x in TEMPER)
    steps.append(f"w0 as materialized (select c.*, {', '.join(f'm_{x}.goal as goal_{x}' for x in TEMPER)}, c.tokens as weight from c {joins})")
    k = 0
    for _ in range(rounds):
        for x in TEMPER:
            steps.append(f"w{k + 1} as {'materialized ' if k % 6 == 5 else ''}(select * replace (least(tokens, weight * goal_{x} / sum(weight) over (partition by {x})) as weight) from w{k})")
            k += 1
    steps.append(f"odds as (select source, lang, topic, round(weight / tokens, 6) as p from w{k})")
    steps.append("r as (select d.doc_id, d.source, d.lang, d.topic, d.tokens, case when tokens > 0 then p else 1.0 end as p from d left join odds on d.source is not distinct from odds.source and d.lang is not distinct from odds.lang and d.topic is not distinct from odds.topic)")
    drawn_sql = f"round(('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{seed}'), 1, 12))::bigint / {float(1 << 48)}, 9)"
    return f"with {', '.join(steps)} select *, {drawn_sql} < p as kept from r"
