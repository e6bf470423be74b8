"""Runs of a repeated period in word sequences, by a scan of all lags.

A run is a stretch of consecutive words with smallest period q (words q apart
are alike) that is at least ``min_exp`` periods and ``min_words`` words long
and that no neighbouring word extends.  The words of a batch of documents are
one array of ids, documents in order of falling length; ids differ between
documents, so no run crosses from one into the next.  The array is compared
with itself shifted by every lag up to n / min_exp, where n is the length of
the longest document, and of each comparison only the documents long enough
for the lag take part.  Stretches of equal words give the maximal runs of that
lag; one that a smaller lag has found before is no run of its own, since a
stretch of four periods and more has one smallest period, which divides all
its others of that size.

A document whose comparisons would keep one task busy for long is dealt out:
ranges of its lags go to different machines, and equal stretches of different
ranges are brought together by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .runtime import free_name, prepare, written

WORD = r"[^\x20\x09-\x0D]+"
#: Comparisons of two words that one task makes for one document at most.
UNIT = 1 << 34
#: Texts of fewer bytes are never dealt out for their length alone.
SHORT_BYTES = 1 << 18
RUNS = "array<struct<start: long, length: long, period: long>>"


def scan(ids: np.ndarray, count: np.ndarray, offs: np.ndarray, lags: tuple[int, int] | None, min_exp: int, min_words: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of the runs with a lag in [lo, hi); documents by falling length."""
    found: list[np.ndarray] = []
    longest = int(count[0]) if len(count) else 0
    lo, hi = (1, longest + 1) if lags is None else lags
    falling = -count
    for p in range(max(1, lo), min(hi, longest // min_exp + 1)):
        least = max(min_words, min_exp * p)
        docs = int(np.searchsorted(falling, -least, side="right"))
        if not docs:
            break
        n = int(offs[docs])
        same = np.flatnonzero(ids[: n - p] == ids[p:n])
        need = least - p  # equal words in a row
        if len(same) < need or not (same[need - 1 :] - same[: len(same) - need + 1] == need - 1).any():
            continue
        cut = np.flatnonzero(np.diff(same) > 1)
        first, last = same[np.concatenate([[0], cut + 1])], same[np.concatenate([cut, [len(same) - 1]])]
        long = last - first + 1 >= need
        found.append(np.stack([first[long], last[long] - first[long] + 1 + p, np.full(int(long.sum()), p)]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
    start, length, period = start[new], length[new], period[new]
    doc = np.searchsorted(offs, start, side="right") - 1
    return doc, start - offs[doc], length, period


def find(min_exp: int, min_words: int, ranged: bool):
    """mapInArrow over (text, lo, hi, ...): the columns and the runs whose lag is in [lo, hi), or in any range."""

    def runs_of(text: pa.Array, lags: tuple[int, int] | None) -> pa.Array:
        buf, offs = tk.buffers(text)
        start, end, doc = tk.words(buf, offs)
        h = tk.with_doc(tk.span_hash(tk.prefix(buf), start, end), doc)
        count, woff = tk.word_counts(doc, len(text))
        order = np.argsort(-count, kind="stable")
        size = count[order]
        at = np.concatenate([[0], np.cumsum(size)])
        ids = np.unique(h, return_inverse=True)[1].astype(np.int32)
        ids = ids[np.repeat(woff[order] - at[:-1], size) + np.arange(at[-1])]
        d, s, n, p = scan(ids, size, at, lags, min_exp, min_words)
        d = order[d]
        by = np.lexsort((p, s, d))
        bounds = np.searchsorted(d[by], np.arange(len(text) + 1))
        rows = pa.StructArray.from_arrays([pa.array(x[by].astype(np.int64)) for x in (s, n, p)], ["start", "length", "period"])
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(0)
            if ranged:  # one range of one document at a time
                spans = [(i, i + 1) for i in range(b.num_rows)]
            else:
                spans = list(tk.row_chunks(text))
            for i, j in spans:
                lags = (b.column(1)[i].as_py(), b.column(2)[i].as_py()) if ranged else None
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, runs_of(part.column(0), lags)], [*b.schema.names, "runs"])

    return run


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (text, runs, ...): further the number of words and the text that is left without repetitions."""
    for b in batches:
        for i, j in tk.row_chunks(b.column(0)):
            part = b.slice(i, j - i)
            buf, offs = tk.buffers(part.column(0))
            start, end, doc = tk.words(buf, offs)
            count, woff = tk.word_counts(doc, j - i)
            runs = part.column(1)
            of = np.repeat(np.arange(j - i), runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            s, n, p = (runs.flatten().field(c).to_numpy() for c in ("start", "length", "period"))
            edge = np.zeros(len(start) + 1, np.int64)
            np.add.at(edge, woff[of] + s + p, 1)
            np.add.at(edge, woff[of] + s + n, -1)
            text = tk.joined_words(buf, start, end, doc, np.cumsum(edge)[:-1] == 0, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(count), text], [*b.schema.names, "n_words", "collapsed"])


def periodic_runs(df: DataFrame, text: str = "text", min_exp: int = 4, min_words: int = 6, unit: int = UNIT, short_bytes: int = SHORT_BYTES) -> DataFrame:
    """The rows of ``df`` with n_words, runs (by start, then period) and collapsed, the words that no run repeats.

    A word is left out of ``collapsed`` if some run holds it after the run's
    first period; what is left is joined by one space.  Null and empty texts
    have no words, no runs and an empty ``collapsed``.  Rows are judged one by
    one, so repeated rows give repeated results; an empty table gives an empty
    one.  Other columns pass through; of the three that are added, one whose
    name is taken gets a number behind it.  Texts of any length are scanned
    whole: one that needs more than ``unit`` comparisons by ranges of its lags
    in several tasks.  ``min_exp`` is 2 or more.
    """
    if min_exp < 2:
        raise ValueError("a run has two periods at least")
    prepare(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {c: free_name(df, c) for c in ("n_words", "runs", "collapsed")}
    whole = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"))
    words = F.when(F.octet_length("text") < short_bytes, 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("double")
    units = F.greatest(F.lit(1), F.ceil(words * words / (min_exp * unit))).cast("int")
    dealt = whole.withColumn("units", units)
    own = whole.schema["row"].dataType.simpleString()

    once = dealt.where("units = 1").select("text", "row").mapInArrow(find(min_exp, min_words, False), f"text string, row {own}, runs {RUNS}")

    far = written(dealt.where("units > 1").withColumn("id", F.monotonically_increasing_id()).withColumn("step", F.ceil(words / min_exp / F.col("units"))), "long-texts")
    ranges = far.select("id", "text", "step", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("k")).repartition(n, "id", "k")
    parts = ranges.select("text", (F.col("k") * F.col("step") + 1).cast("long").alias("lo"), ((F.col("k") + 1) * F.col("step") + 1).cast("long").alias("hi"), "id").mapInArrow(find(min_exp, min_words, True), f"text string, lo long, hi long, id long, runs {RUNS}")
    each = parts.select("id", F.inline("runs")).groupBy("id", "start", "length").agg(F.min("period").alias("period"))
    lists = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    later = far.join(lists, "id", "left").select("text", "row", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))

    both = once.select("text", "runs", "row").unionByName(later).mapInArrow(collapse, f"text string, runs {RUNS}, row {own}, n_words long, collapsed string")
    return both.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)], *[F.col(c).alias(as_) for c, as_ in names.items()])


def runs_text(runs: Column) -> Column:
    """``start,length,period`` of every run, each with a line feed behind it."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def longest_run(runs: Column) -> Column:
    """The longest run, of equal ones the first, then that of the smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def tail_repeated(doc_id: Column, text: Column) -> Column:
    """The text whose last words repeat one period, for a tenth of all ids; other texts as they are.

    With h = crc32(id), g = h div 10: if h mod 10 is 0, each word from a = g
    mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    A null id changes nothing.
    """
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def woven(words: Column, n: Column, g: Column) -> Column:
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    found = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, woven(w, F.size(w).cast("long"), F.floor(h / 10).cast("long"))).otherwise(F.lit("")))
    return F.when(h % 10 == 0, found[0]).otherwise(text)
