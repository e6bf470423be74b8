"""Toxicity by class-conditional Kneser-Ney models of a text's words.

Two models, one of toxic and one of ordinary text, are counted from labelled
rows.  Each is an interpolated Kneser-Ney model of three orders:

* a word after the word before it, by the number of documents that have the pair;
* a word, by its continuation count: the number of different words it follows;
* a word's stem (its first bytes), by the pairs of all words that share it.

An absolute discount is taken from every count, and what it frees goes to the
next lower order.  Below the stems lies one distribution for both classes:
continuation counts over the whole corpus, labelled or not (the words before a
word are told apart by a sketch of 64 bits; a word whose sketch is full counts
its documents).  Words and stems hand down the share that both classes have
together, so an expression that neither model knows speaks for no class.

A text is scored by length-normalised log-likelihood ratios of the two models:
that of the whole text and that of its ``STRONGEST`` strongest words.  A
logistic curve over both turns them into a score.  It is fitted to labelled
rows that are scored by models without their fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .runtime import prepare, written

#: Taken from counts of words and stems, and from counts of pairs.
DISCOUNT, PAIR_DISCOUNT = 3, 6
STEM_BYTES = 6
STRONGEST = 2
FOLDS = 3
#: The models are fitted on at most so many labelled rows (those with the
#: smallest hashes of their ids); all counts below the classes cover all rows.
MOST_LABELLED = 20_000
#: Models of more rows are joined with the words of the texts instead of being sent to the workers.
MOST_ROWS = 3_000_000
BROADCAST_LABELS = 2_000_000
U64 = np.uint64

LETTERLESS = np.ones(256, dtype=bool)
LETTERLESS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

FEATURES = T.StructType([T.StructField("strongest", T.DoubleType()), T.StructField("whole", T.DoubleType())])


def expressions(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, stem, word before, document) of every word: runs of ASCII letters and digits and of other characters, A-Z lower-cased."""
    start, end, doc = tk.words(buf, offs, LETTERLESS)
    p = tk.prefix(buf, lower=True)
    w = tk.span_hash(p, start, end)
    s = tk.span_hash(p, start, np.minimum(end, start + STEM_BYTES))
    before = np.zeros(len(w), U64)
    before[1:] = np.where(doc[1:] == doc[:-1], w[:-1], U64(0))
    return w, s, before, doc


def pair(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tk.mix(before * U64(0x9E3779B97F4A7C15) + w)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (text, toxic, fold): documents of each class and fold that have a pair of words."""
    for b in batches:
        toxic, fold = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        for i, j in tk.row_chunks(b.column(0)):
            w, s, v, doc = expressions(*tk.buffers(b.column(0).slice(i, j - i)))
            kind = toxic[i:j] * FOLDS + fold[i:j]
            once = np.unique(tk.with_doc(pair(v, w), doc), return_index=True)[1]
            tagged = tk.with_doc(pair(v, w)[once], kind[doc[once]])
            _, first, n = np.unique(tagged, return_index=True, return_counts=True)
            at = once[first]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[at].view(np.int64)) for x in (v, w, s)], pa.array(kind[doc[at]].astype(np.int32)), pa.array(n.astype(np.int32))], ["v", "w", "s", "kind", "n"])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (text): every word with its stem, its documents and a sketch of the words before it."""
    for b in batches:
        for i, j in tk.row_chunks(b.column(0)):
            w, s, v, doc = expressions(*tk.buffers(b.column(0).slice(i, j - i)))
            once = np.unique(tk.with_doc(w, doc), return_index=True)[1]
            words, first, at = np.unique(w, return_index=True, return_inverse=True)
            sketch = np.zeros(len(words), U64)
            np.bitwise_or.at(sketch, at, U64(1) << (tk.mix(v) & U64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(s[first].view(np.int64)), pa.array(sketch.view(np.int64)), pa.array(np.bincount(at[once], minlength=len(words)).astype(np.int64))], ["w", "s", "sketch", "docs"])


@dataclass
class Table:
    """Values by hash; ``find`` gives positions, one past the end for what is not there."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: list[np.ndarray], default: list[float]) -> Table:
        keys = keys.view(U64)
        order = np.argsort(keys)
        return cls(keys[order], np.concatenate([np.stack(values, axis=1)[order], [default]]).astype(np.float32))

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return self.values[np.zeros(len(h), np.int64)]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.values[np.where(self.keys[at] == h, at, len(self.keys))]


@dataclass
class Model:
    """What each class gives: pairs above the discount, the share handed down after a word,
    known words, and stems (against the shared distribution) for unknown words."""

    pairs: Table
    before: Table
    words: Table
    stems: Table

    def ratios(self, w: np.ndarray, s: np.ndarray, v: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of every word after the one before it."""
        low = self.words.find(w)
        unknown = np.isnan(low[:, 0])
        both = self.pairs.find(pair(v, w)) + self.before.find(v) * low
        both[unknown] = self.stems.find(s[unknown])
        return np.log(both[:, 1] / both[:, 0])

    def features(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(strongest words, whole text) of each text."""
        strongest, whole = [np.zeros(0)], [np.zeros(0)]
        for buf, offs in tk.chunks(text):
            n = len(offs) - 1
            w, s, v, doc = expressions(buf, offs)
            llr = self.ratios(w, s, v).astype(np.float64)
            count = np.bincount(doc, minlength=n)
            whole.append(np.bincount(doc, weights=llr, minlength=n) / np.maximum(count, 1))
            order = np.lexsort((-llr, doc))
            rank = np.arange(len(w)) - (np.cumsum(count) - count)[doc[order]]
            top = order[(rank < STRONGEST) & (llr[order] > 0)]
            strongest.append(np.bincount(doc[top], weights=llr[top], minlength=n) / STRONGEST)
        return np.concatenate(strongest), np.concatenate(whole)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never looked at: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, most: int) -> DataFrame:
    """(text, toxic, fold) of the rows to learn from; ids with several labels are toxic if one says so."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > most:
        h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
        known = known.where(h < int((1 << 40) * most / n))
    known = known.select(F.col("doc_id").alias("label_id"), "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    if min(n, most) <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.join(known, rows["id"] == known["label_id"]).select("text", "toxic", "fold")


@dataclass
class Counts:
    """What the classes have above the discounts: words, stems, pairs, what follows a word, and sums over all.

    ``rows`` is their number, by which a model is sent to the workers or joined.
    """

    words: DataFrame
    stems: DataFrame
    pairs: DataFrame
    before: DataFrame
    sums_w: dict[str, float]
    sums_s: dict[str, float]
    everything: float
    rows: int


def count_classes(docs: DataFrame, train: DataFrame, text: str = "text") -> Counts:
    """Counts of all of ``train`` and of each part without a fold, a column for each model and class."""
    models = range(FOLDS + 1)  # the last one leaves out nothing
    # Dealt out before they are summed: a column for each model would make wide rows of the shuffle.
    counted = train.mapInArrow(count_pairs, "v long, w long, s long, kind int, n int").repartition("v", "w", "s").groupBy("v", "w", "s")
    fold, label = F.col("kind") % FOLDS, F.floor(F.col("kind") / FOLDS)
    sums = [F.coalesce(F.sum(F.when((fold != m) & (label == c), F.col("n"))), F.lit(0)).cast("int").alias(f"n{c}_{m}") for m in models for c in (0, 1)]
    pairs = written(counted.agg(*sums), "class-pairs")
    corpus = docs.select(F.col(text).alias("text")).mapInArrow(count_words, "w long, s long, sketch long, docs long").groupBy("w", "s").agg(F.bit_or("sketch").alias("sketch"), F.sum("docs").alias("docs"))
    full = F.bit_count("sketch")
    follows = F.when(full < 60, -64 * F.log((64 - full) / 64)).otherwise(F.greatest("docs", F.lit(177)))
    corpus = written(corpus.select("w", "s", follows.alias("follows")), "corpus-words")
    of_stems = corpus.groupBy("s").agg(F.sum("follows").alias("stem_follows"))
    everything = float(of_stems.agg(F.sum("stem_follows")).first()[0] or 1)

    names = [f"n{c}_{m}" for m in models for c in (0, 1)]
    evidence = F.col(f"n0_{FOLDS}") + F.col(f"n1_{FOLDS}")
    above = lambda x, d: F.greatest(F.col(x) - d, F.lit(0))

    def totals(df: DataFrame) -> dict[str, float]:
        got = df.agg(*[F.sum(x).alias(f"c_{x}") for x in names], *[F.sum(above(x, DISCOUNT)).alias(f"d_{x}") for x in names]).first()
        return {c: float(v or 0) for c, v in got.asDict().items()}

    words = written(pairs.groupBy("w", "s").agg(*[F.sum((F.col(x) > 0).cast("int")).alias(x) for x in names]), "class-words")
    stems = written(words.groupBy("s").agg(*[F.sum(x).alias(x) for x in names]), "class-stems")
    # Only words that some pair above the discount follows need their own share to hand down.
    mass = [x for n in names for x in (F.sum(n).alias(n), F.sum(above(n, PAIR_DISCOUNT)).alias(f"d_{n}"))]
    before = pairs.groupBy("v").agg(*mass).where(" or ".join(f"d_{n} > 0" for n in names))
    tables = [
        written(words.where(evidence > DISCOUNT).join(corpus.select("w", "follows"), "w"), "model-words"), written(stems.where(evidence > DISCOUNT).join(of_stems, "s"), "model-stems"),
        written(pairs.where(evidence > PAIR_DISCOUNT).drop("s"), "model-pairs"), written(before, "model-before"),
    ]
    return Counts(*tables, totals(words), totals(stems), everything, sum(t.count() for t in tables))


def fitted(docs: DataFrame, train: DataFrame, text: str = "text") -> list[Model]:
    """The model of all of ``train``, then for each fold the one without it, as tables for the workers."""
    return models_of(count_classes(docs, train, text))


def models_of(counts: Counts) -> list[Model]:
    """All models as sorted tables: ``counts.rows`` rows come to the driver, so ask for their number before."""
    arrays = lambda df: {c: t[c].to_numpy() for t in [df.toArrow()] for c in t.column_names}
    tables = {k: arrays(df) for k, df in zip("wspv", (counts.words, counts.stems, counts.pairs, counts.before), strict=True)}
    return [model_of(tables, counts.sums_w, counts.sums_s, counts.everything, m) for m in (FOLDS, *range(FOLDS))]


def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (row, text): each different word after a word of a text, and how often it is there."""
    for b in batches:
        for i, j in tk.row_chunks(b.column(1)):
            w, s, v, doc = expressions(*tk.buffers(b.column(1).slice(i, j - i)))
            _, first, n = np.unique(tk.with_doc(pair(v, w), doc), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(doc[first])), *[pa.array(x[first].view(np.int64)) for x in (v, w, s)], pa.array(n)], ["row", "v", "w", "s", "n"])


def joined_features(rows: DataFrame, counts: Counts, m: int) -> DataFrame:
    """(row, strongest, whole) of ``rows`` (row, text) by the model ``m``, found by joins: for models of any size.

    The same numbers as ``Model.features`` gives.  Every table has one row for
    a word, so a frequent word is split by the adaptive join.  Texts without
    words are not in the result.
    """
    names = [f"n{c}_{m}" for c in (0, 1)]
    positive = lambda c: F.greatest(c, F.lit(0.0))

    def level(sums: dict[str, float], c: int, lower: Column) -> Column:
        share = 1 - sum(sums[f"d_{x}"] for x in names) / max(sum(sums[f"c_{x}"] for x in names), 1)
        return (1 - share) * positive(F.col(names[c]) - DISCOUNT) / max(sums[f"d_{names[c]}"], 1) + share * lower

    shared = F.col("stem_follows") / counts.everything
    stems = counts.stems.select("s", *[(level(counts.sums_s, c, shared) / shared).alias(f"f{c}") for c in (0, 1)])
    words = counts.words.join(stems, "s", "left").select("w", *[level(counts.sums_w, c, F.col("follows") / counts.everything * F.coalesce(f"f{c}", F.lit(1.0))).alias(f"l{c}") for c in (0, 1)])
    before = counts.before.select("v", *[(1 - F.col(f"d_{x}") / F.greatest(x, F.lit(1))).alias(f"b{c}") for c, x in enumerate(names)], *[F.col(x).alias(f"m{c}") for c, x in enumerate(names)])
    tops = counts.pairs.join(before, "v", "left").select("v", "w", *[F.coalesce(positive(F.col(x) - PAIR_DISCOUNT) / F.greatest(f"m{c}", F.lit(1)), F.lit(0.0)).alias(f"t{c}") for c, x in enumerate(names)])

    listed = rows.mapInArrow(list_words, "row long, v long, w long, s long, n long")
    all_ = listed.join(words, "w", "left").join(stems, "s", "left").join(before.drop("m0", "m1"), "v", "left").join(tops, ["v", "w"], "left")
    both = [F.when(F.col("l0").isNull(), F.coalesce(f"f{c}", F.lit(1.0))).otherwise(F.coalesce(f"t{c}", F.lit(0.0)) + F.coalesce(f"b{c}", F.lit(1.0)) * F.col(f"l{c}")) for c in (0, 1)]
    ratio = F.log(both[1] / both[0])
    each = all_.select("row", "n", ratio.alias("llr"))
    strong = F.slice(F.sort_array(F.collect_list(F.when(F.col("llr") > 0, F.struct("llr", "n"))), asc=False), 1, STRONGEST)
    step = lambda acc, x: F.struct((acc["sum"] + x["llr"] * F.least(x["n"], acc["room"])).alias("sum"), (acc["room"] - F.least(x["n"], acc["room"])).alias("room"))
    top = F.aggregate(strong, F.struct(F.lit(0.0).alias("sum"), F.lit(STRONGEST).cast("long").alias("room")), step)["sum"] / STRONGEST
    return each.groupBy("row").agg(top.alias("strongest"), (F.sum(F.col("n") * F.col("llr")) / F.sum("n")).alias("whole"))


def model_of(tables: dict[str, dict[str, np.ndarray]], sums_w: dict[str, float], sums_s: dict[str, float], everything: float, m: int) -> Model:
    """The model whose counts are in the columns of ``m``."""
    names = [f"n{c}_{m}" for c in (0, 1)]
    w, s, v, p = (tables[k] for k in "wsvp")

    def level(t: dict[str, np.ndarray], sums: dict[str, float], lower: list[np.ndarray]) -> list[np.ndarray]:
        """Discounted counts of each class, and the share of both handed down to ``lower``."""
        share = 1 - sum(sums[f"d_{x}"] for x in names) / max(sum(sums[f"c_{x}"] for x in names), 1)
        return [(1 - share) * np.maximum(t[x] - DISCOUNT, 0) / max(sums[f"d_{x}"], 1) + share * low for x, low in zip(names, lower, strict=True)]

    shared = s["stem_follows"] / everything
    of_stem = [x / shared for x in level(s, sums_s, [shared, shared])]
    stems = Table.of(s["s"], of_stem, [1.0, 1.0])
    factor = stems.find(w["s"].view(U64)).astype(np.float64)
    words = Table.of(w["w"], level(w, sums_w, [w["follows"] / everything * factor[:, c] for c in (0, 1)]), [np.nan, np.nan])
    before = Table.of(v["v"], [1 - v[f"d_{x}"] / np.maximum(v[x], 1) for x in names], [1.0, 1.0])
    seen = Table.of(v["v"], [v[x] for x in names], [np.inf, np.inf]).find(p["v"].view(U64)).astype(np.float64)
    tops = [np.maximum(p[x] - PAIR_DISCOUNT, 0) / np.maximum(seen[:, c], 1) for c, x in enumerate(names)]
    return Model(Table.of(pair(p["v"].view(U64), p["w"].view(U64)).view(np.int64), tops, [0.0, 0.0]), before, words, stems)


def scorer(df: DataFrame, model: Model):
    """A UDF: text -> its ratios."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(FEATURES)
    def udf(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in shared.value.features(text)], FEATURES.names)

    return udf


def without_fold(df: DataFrame, models: list[Model]):
    """mapInArrow over (text, toxic, fold): ratios by the model without the row's fold."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(2).to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                rows = np.flatnonzero(fold == f)
                if len(rows):
                    mine = b.take(pa.array(rows))
                    got = shared.value[f].features(mine.column(0))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, got), mine.column(1).cast(pa.float64())], [*FEATURES.names, "label"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """A row for each document: doc_id, held_out and a score from 0 to 1.

    Only texts enter a score.  A null or empty text, or one without known
    expressions, has ratios of 0.  Columns beside id and text are not read.
    Models of up to ``MOST_ROWS`` rows are sent to the workers, larger ones
    joined; the scores are the same.  Repeated rows count and come back as often
    as they are there; very long texts are scored whole.  Where the labels to
    learn from are of one class only or missing, every score is the share of
    toxic ones (or 0).
    """
    prepare(docs.sparkSession)
    train = labelled(docs, labels, doc_id, text, most_labelled)
    counts = count_classes(docs, train, text)
    ids = [F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out")]
    if counts.rows <= MOST_ROWS:
        model, *others = models_of(counts)
        seen = written(train.mapInArrow(without_fold(docs, others), ", ".join(f"{c} double" for c in (*FEATURES.names, "label"))), "ratios")
        rows = docs.select(*ids, scorer(docs, model)(F.col(text)).alias("x"))
    else:
        numbered = lambda df, *more: written(df.select(*more, F.col("text")).withColumn("row", F.monotonically_increasing_id()), "numbered")
        zero = {c: 0.0 for c in FEATURES.names}
        own = numbered(train, "toxic", "fold")
        parts = [own.where(F.col("fold") == f).join(joined_features(own.where(F.col("fold") == f).select("row", "text"), counts, f), "row", "left") for f in range(FOLDS)]
        seen = written(reduce(DataFrame.unionByName, parts).select(*FEATURES.names, F.col("toxic").cast("double").alias("label")).fillna(zero), "ratios")
        every = numbered(docs.select(*ids, F.col(text).alias("text")), "doc_id", "held_out")
        rows = every.drop("text").join(joined_features(every.select("row", "text"), counts, FOLDS), "row", "left").fillna(zero, FEATURES.names).select("doc_id", "held_out", F.struct(*FEATURES.names).alias("x"))
    classes = {r.label: r["count"] for r in seen.groupBy("label").count().collect()}
    if len(classes) < 2:
        return rows.select("doc_id", "held_out", F.lit(float(max(classes, default=0.0))).alias("score"))
    curve = LogisticRegression(maxIter=100, regParam=1e-4).fit(VectorAssembler(inputCols=FEATURES.names, outputCol="features").transform(seen))
    z = F.lit(float(curve.intercept))
    for name, weight in zip(FEATURES.names, curve.coefficients, strict=True):
        z = z + F.lit(float(weight)) * F.col(f"x.{name}")
    return rows.select("doc_id", "held_out", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))
