"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets a few integer measures.  For every (language, source) a
histogram sketch of each ratio is kept: a value is cut to its six leading
bits, so a quantile is off by 1/32 at most, and sketches merge by adding
counts.  Thresholds are outer fences of the sketched quartiles.  Where both
quartiles lie in one bin they say nothing of the spread; the fence is then no
tighter than a sketched tail quantile and a small margin.  A group with few
documents takes its language's sketch, a language with few the one of the
whole corpus.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkit as tk
from .runtime import free_name, prepare, written

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in FIELDS])

#: name: (numerator, denominator, tail percentile, margin in thousandths, whether low values are fenced too).
#: A tail must lie below the share of junk that a group may have: symbols are what junk has most of.
RATIOS = {
    "symbols": ("n_symbols", "n_words", 80, 20, False),
    "length": ("word_chars", "n_words", 99, 100, True),
    "dup_lines": ("n_dup_lines", "n_lines", 99, 50, False),
    "repeats": ("n_repeat_words", "n_words", 99, 50, False),
    "upper": ("n_upper", "word_chars", 99, 10, False),
}


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of one chunk."""
    n_docs = len(offs) - 1
    start, end, doc = tk.words(buf, offs)
    count, woff = tk.word_counts(doc, n_docs)
    solid = ~tk.SPACE[buf]
    p = tk.prefix(buf)
    out = {"n_words": count, "word_chars": tk.per_doc(solid & ((buf & 0xC0) != 0x80), offs), "n_symbols": tk.per_doc(_SYMBOL[buf], offs), "n_upper": tk.per_doc((buf >= 65) & (buf <= 90), offs)}

    # lines that hold a word: distinct (document, content) pairs
    cut = np.flatnonzero(buf == 0x0A)
    bounds = np.unique(np.concatenate([offs, cut + 1]))
    ls, le = bounds[:-1], bounds[1:].copy()
    if len(ls):
        le -= buf[le - 1] == 0x0A
        has = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(solid, out=has[1:])
        keep = has[le] > has[ls]
        ls, le = ls[keep], le[keep]
    ldoc = np.searchsorted(offs, ls, side="right") - 1
    lines = np.bincount(ldoc, minlength=n_docs).astype(np.int64)
    _, first = np.unique(tk.with_doc(tk.span_hash(p, ls, le), ldoc), return_index=True)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(ldoc[first], minlength=n_docs)

    # words in windows that occur twice or more in their document
    h = tk.span_hash(p, start, end)
    w = tk.windows(h, REPEAT_WINDOW)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(w):
        whole = np.flatnonzero(doc[: len(w)] == doc[REPEAT_WINDOW - 1 :])
        mixed = tk.with_doc(w[whole], doc[whole])
        order = np.argsort(mixed, kind="stable")
        s = mixed[order]
        same = np.zeros(len(s) + 1, dtype=bool)
        same[1:-1] = s[1:] == s[:-1]
        twice = whole[order[same[:-1] | same[1:]]]
        covered += np.bincount(twice, minlength=len(covered)) - np.bincount(twice + REPEAT_WINDOW, minlength=len(covered))
    out["n_repeat_words"] = tk.per_doc(np.cumsum(covered[:-1]) > 0, woff)
    return out


@F.arrow_udf(MEASURES)
def measures(text: pa.Array) -> pa.Array:
    got = [measure(*c) for c in tk.chunks(text)]
    cols = [pa.array(np.concatenate([g[c] for g in got]) if got else np.zeros(0, np.int64), pa.int64()) for c in FIELDS]
    return pa.StructArray.from_arrays(cols, list(FIELDS))


def base_failed(m: str) -> Column:
    n = F.col(f"{m}.n_words")
    return (n < 20) | (100 * F.col(f"{m}.n_repeat_words") > 30 * n)


def ratio(m: str, name: str) -> Column:
    """A ratio in thousandths, rounded down; 0 where nothing is counted."""
    top, under = RATIOS[name][:2]
    return F.when(F.col(f"{m}.{under}") > 0, F.expr(f"(1000 * `{m}`.{top}) div `{m}`.{under}")).otherwise(F.lit(0).cast("long"))


def bin_of(v: Column) -> Column:
    """``v`` cut to its six leading bits: the lower end of its bin."""
    drop = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def bin_top(b: Column) -> Column:
    """The upper end of the bin that starts at ``b``."""
    return b + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(b)) - 6, F.lit(0))) - 1


def fences(measured: DataFrame, m: str, lang: str, source: str, min_docs: int, spread: int) -> DataFrame:
    """A row for each (lang, source): its fences.  Null is a group of its own.

    The sketches of all rows that pass the base rules: counts by (group,
    ratio, bin), pre-aggregated before the shuffle, so that a hot source costs
    no more than a small one.
    """
    pairs = F.array(*[F.struct(F.lit(r).alias("ratio"), bin_of(ratio(m, r)).alias("bin")) for r in RATIOS])
    counts = measured.where(~base_failed(m)).select(F.col(lang).alias("l"), F.col(source).alias("s"), F.explode(pairs).alias("p")).groupBy("l", "s", "p.ratio", "p.bin").agg(F.count("*").alias("n"))

    def of_ratio(k: int) -> Column:
        return F.create_map(*[x for r, v in RATIOS.items() for x in (F.lit(r), F.lit(v[k]))])[F.col("ratio")]

    def quartiles(sketch: DataFrame, by: list[str], level: str) -> DataFrame:
        w = Window.partitionBy(*by, "ratio")
        run = sketch.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bin")))
        q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bin")))
        return run.groupBy(*by, "ratio").agg(F.max("total").alias(f"n_{level}"), q(25).alias(f"a_{level}"), q(75).alias(f"b_{level}"), q(100 - of_ratio(2)).alias(f"y_{level}"), q(of_ratio(2)).alias(f"z_{level}"))

    by_lang = counts.groupBy("l", "ratio", "bin").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("ratio", "bin").agg(F.sum("n").alias("n"))
    one, two, three = quartiles(counts, ["l", "s"], "g"), quartiles(by_lang, ["l"], "l"), quartiles(by_all, [], "c")
    two = two.withColumnRenamed("l", "l2").withColumnRenamed("ratio", "r2")
    three = three.withColumnRenamed("ratio", "r3")
    q = one.join(two, F.col("l").eqNullSafe(F.col("l2")) & (F.col("ratio") == F.col("r2"))).join(three, F.col("ratio") == F.col("r3"))
    pick = lambda c: F.when(F.col("n_g") >= min_docs, F.col(f"{c}_g")).when(F.col("n_l") >= min_docs, F.col(f"{c}_l")).otherwise(F.col(f"{c}_c"))
    low, high, margin = pick("a"), bin_top(pick("b")), of_ratio(3)
    beyond = F.greatest(spread * (high - low), margin)
    flat = pick("a") == pick("b")
    upper = F.when(flat, F.greatest(high + beyond, bin_top(pick("z")) + margin)).otherwise(high + beyond)
    lower = F.when(flat, F.least(low - beyond, pick("y") - margin)).otherwise(low - beyond)
    lower = F.when(of_ratio(4), lower).otherwise(F.lit(-1))
    return q.select("l", "s", "ratio", upper.alias("hi"), lower.alias("lo")).groupBy("l", "s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ratio", F.struct("lo", "hi"))))).alias("fence"))


def judged(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 100, spread: int = 3) -> tuple[DataFrame, str, str]:
    """``df`` with a struct of measures and a boolean ``kept``; and their names.

    Every row comes back once.  A null or empty text has no words and fails
    the base rules; null languages and sources form groups of their own.
    Repeated rows count each and share their verdict; a value that lies on a
    fence passes; very long texts are measured whole.
    """
    prepare(df.sparkSession)
    m, kept, k1, k2, fence = (free_name(df, x) for x in ("measures", "method_keeps", "l_key", "s_key", "fence_map"))
    narrow = written(df.select(F.col(lang).alias(lang), F.col(source).alias(source), measures(F.col(text)).alias(m)), "quality")
    return judged_by(df.withColumn(m, measures(F.col(text))), narrow, m, kept, lang, source, (k1, k2, fence), min_docs, spread)


def judged_by(df: DataFrame, measured: DataFrame, m: str, kept: str, lang: str, source: str, names: tuple[str, str, str], min_docs: int, spread: int) -> tuple[DataFrame, str, str]:
    k1, k2, fence = names
    limits = fences(measured, m, lang, source, min_docs, spread).select(F.col("l").alias(k1), F.col("s").alias(k2), F.col("fence").alias(fence))
    limits = written(limits, "fences")
    inside = reduce(lambda a, b: a & b, [F.coalesce(ratio(m, r).between(F.col(fence)[r]["lo"], F.col(fence)[r]["hi"]), F.lit(True)) for r in RATIOS])
    out = df.join(limits, df[lang].eqNullSafe(limits[k1]) & df[source].eqNullSafe(limits[k2]), "left")
    return out.withColumn(kept, ~base_failed(m) & inside).drop(k1, k2, fence), m, kept


def quality_filter(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 100, spread: int = 3) -> DataFrame:
    """The rows that the rules keep, with the columns of ``df`` unchanged.

    Null and empty texts fail the base rules and go; very long ones are
    measured whole.  Null languages and sources are groups of their own, and
    small groups take the fences of all rows.  Repeated rows share their fate;
    columns may have any name.  An empty table gives an empty one.
    """
    out, _, kept = judged(df, text, lang, source, min_docs, spread)
    return out.where(F.col(kept)).select(*[out[c] for c in df.columns])


def quality_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 100, spread: int = 3) -> DataFrame:
    """A row for each document: measures and verdicts, without its text.

    A null text has no words, fails the base rules and is not kept; repeated
    rows come back as often as they are there.  Other columns are not read.
    """
    prepare(df.sparkSession)
    narrow = written(df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), measures(F.col(text)).alias("m")), "quality")
    out, m, kept = judged_by(narrow, narrow, "m", "kept", "lang", "source", ("l_key", "s_key", "fence"), min_docs, spread)
    return out.select("doc_id", *[F.col(f"{m}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(m).alias("base_failed"), F.col(kept).alias("kept"), "lang", "source")
