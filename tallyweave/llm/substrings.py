"""Removal of word sequences that an earlier document holds, by difference-cover anchors.

A window is ``length`` consecutive words of one document.  Grams of ``length -
period + 1`` words are hashed only at places whose number modulo ``period``
lies in ``cover``, a set that has every difference modulo ``period``.  So for
any two places of equal windows there is a shift below ``period`` that takes
both to covered places, and the gram there lies inside the window: equal
windows share an aligned anchor.  The plan:

1. Equal texts become one, with their smallest id (a table bucketed by the
   text's md5, so that later passes join it without moving a text).  A copy
   with a larger id loses everything, if it has a window at all.
2. Each text gives its distinct anchors, once each.  They are dealt out by
   hash and sorted; an anchor that two texts have is a repeated one.  Sorted
   rows are looked at one after the other, so no group is ever held.
3. Repeated anchors are extended to both sides, to all windows around them.
   Windows are dealt out, sorted by hash and id, and compared with the first
   of their run: one with a larger id goes.
4. Anchors and windows that very many texts have would meet in one task.  A
   sample of texts names them (at most ``FREQUENT`` each).  Frequent anchors
   are repeated, so they need not be sent at all; the smallest id of each
   frequent window is found by sums before rows move.  What the sample misses
   is only slower: every anchor and every window is judged in one way or the
   other.

Words are compared by 64-bit hashes, windows by 96 bits of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .runtime import fresh_path, prepare, written

PERIOD, COVER = 7, (0, 1, 3)
#: Frequent anchors and windows that are told to all tasks; the sample that names them; the share of its texts that have one.
FREQUENT, SAMPLE, SHARE = 4096, 5000, 0.002
#: Stands for a null id, which comes after all others.
LAST = (1 << 63) - 1
U64 = np.uint64
OTHER = U64(0xA0761D6478BD642F)


class Cover(NamedTuple):
    """Windows of ``length`` words, anchored by grams at ``cover`` modulo ``period``."""

    length: int = 13
    period: int = PERIOD
    cover: tuple[int, ...] = COVER

    @property
    def gram(self) -> int:
        return self.length - self.period + 1

    def checked(self) -> Cover:
        if {(a - b) % self.period for a in self.cover for b in self.cover} != set(range(self.period)):
            raise ValueError(f"{self.cover} lacks a difference modulo {self.period}")
        if self.gram < 1:
            raise ValueError("windows have as many words as the period at least")
        return self


class Words(NamedTuple):
    """A chunk's words: bytes, spans, documents, hashes, and the offsets of the words of each document."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    h: np.ndarray
    count: np.ndarray
    offs: np.ndarray

    @staticmethod
    def of(text: pa.Array) -> Words:
        buf, offs = tk.buffers(text)
        start, end, doc = tk.words(buf, offs)
        h = tk.span_hash(tk.prefix(buf), start, end)
        return Words(buf, start, end, doc, h, *tk.word_counts(doc, len(text)))

    def places(self, n: int) -> np.ndarray:
        """Where n words of one document begin."""
        return np.flatnonzero(np.arange(len(self.h)) + n <= self.offs[self.doc + 1])

    def anchors(self, c: Cover) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the grams at covered places of the documents that have a window."""
        at = self.places(c.gram)
        covered = np.zeros(c.period, bool)
        covered[list(c.cover)] = True
        at = at[covered[(at - self.offs[self.doc[at]]) % c.period] & (self.count[self.doc[at]] >= c.length)]
        return at, tk.windows(self.h, c.gram)[at] if len(at) else np.zeros(0, U64)

    def windows(self, c: Cover, at: np.ndarray) -> np.ndarray:
        return tk.windows(self.h, c.length)[at] if len(at) else np.zeros(0, U64)


def texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for b in batches:
        for i, j in tk.row_chunks(b.column(column)):
            part = b.slice(i, j - i)
            yield part, Words.of(part.column(column))


def member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def counted(c: Cover):
    """mapInArrow over (text): how many texts of a chunk have an anchor or a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in texts(batches):
            at = w.places(c.length)
            for kind, (place, h) in enumerate((w.anchors(c), (at, w.windows(c, at)))):
                once = np.unique(tk.with_doc(h, w.doc[place]), return_index=True)[1]
                value, n = np.unique(h[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), kind, np.int32)), pa.array(value.view(np.int64)), pa.array(n)], ["kind", "h", "n"])

    return run


def send_anchors(c: Cover, frequent: np.ndarray):
    """mapInArrow over (text, row): the distinct anchors of each text but for the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in texts(batches):
            at, h = w.anchors(c)
            rare = ~member(h, frequent)
            at, h = at[rare], h[rare]
            once = np.sort(np.unique(tk.with_doc(h, w.doc[at]), return_index=True)[1])
            yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), part.column(1).take(pa.array(w.doc[at[once]]))], ["h", "row"])

    return run


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, row) sorted by h, those whose h comes more than once."""
    held_h, held_row, held_hit = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def out(row: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(h)], ["row", "h"])

    for b in batches:
        if not b.num_rows:
            continue
        h = np.concatenate([held_h, b.column(0).to_numpy()])
        row = np.concatenate([held_row, b.column(1).to_numpy()])
        same = h[1:] == h[:-1]
        hit = np.zeros(len(h), bool)
        hit[1:] |= same
        hit[:-1] |= same
        hit[0] |= held_hit
        yield out(row[:-1][hit[:-1]], h[:-1][hit[:-1]])
        held_h, held_row, held_hit = h[-1:], row[-1:], bool(hit[-1])
    if held_hit:
        yield out(held_row, held_h)


def extend(c: Cover, anchors: np.ndarray, windows: np.ndarray):
    """mapInArrow over (text, row, first, hashes): the windows around repeated anchors but for the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in texts(batches):
            at, h = w.anchors(c)
            lists = part.column(3)
            of = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            known = np.sort(tk.with_doc(lists.flatten().to_numpy(zero_copy_only=False).view(U64), of))
            hit = member(h, anchors) | member(tk.with_doc(h, w.doc[at]), known)
            around = np.zeros(len(w.h) + 1, np.int64)
            around[at[hit] + 1] = 1
            around = np.cumsum(around)
            s = w.places(c.length)
            s = s[around[s + c.period] > around[s]]
            a = w.windows(c, s)
            rare = ~member(a, windows)
            s, a = s[rare], a[rare]
            b = tk.windows(tk.mix(w.h ^ OTHER), c.length)[s] & U64(0xFFFFFFFF) if len(s) else a
            rows = pa.array(w.doc[s])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), part.column(2).take(rows), part.column(1).take(rows), pa.array((s - w.offs[w.doc[s]]).astype(np.int32))], ["a", "b", "first", "row", "s"])

    return run


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, first, row, s) sorted by the former three, those with a larger ``first`` than the first row of their (a, b)."""
    held: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, first = (batch.column(i).to_numpy() for i in range(3))
        new = np.concatenate([[held is None or (a[0], b[0]) != held[:2]], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        least = first[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
        if held is not None and not new[0]:
            least[: int(new.argmax()) if new.any() else len(a)] = held[2]
        held = int(a[-1]), int(b[-1]), int(least[-1])
        gone = pa.array(first > least)
        yield pa.RecordBatch.from_arrays([batch.column(3).filter(gone), batch.column(4).filter(gone)], ["row", "s"])


def least_ids(c: Cover, windows: np.ndarray):
    """mapInArrow over (text, first): the smallest ``first`` of each frequent window in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in texts(batches):
            s = w.places(c.length)
            a = w.windows(c, s)
            hit = member(a, windows)
            least = np.full(len(windows), LAST)
            seen = np.searchsorted(windows, a[hit])
            np.minimum.at(least, seen, part.column(1).to_numpy()[w.doc[s[hit]]])
            seen = np.unique(seen)
            yield pa.RecordBatch.from_arrays([pa.array(windows[seen].view(np.int64)), pa.array(least[seen])], ["h", "first"])

    return run


def cut_out(c: Cover, windows: np.ndarray, least: np.ndarray):
    """mapInArrow over (text, key, first, places): words, removed spans and what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in texts(batches):
            lists = part.column(3)
            of = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            edge = np.zeros(len(w.h) + 1, np.int64)
            np.add.at(edge, w.offs[of] + lists.flatten().to_numpy(zero_copy_only=False), 1)
            if len(windows):
                s = w.places(c.length)
                a = w.windows(c, s)
                hit = member(a, windows)
                s, a = s[hit], a[hit]
                edge[s[part.column(2).to_numpy()[w.doc[s]] > least[np.searchsorted(windows, a)]]] += 1
            edge = (edge > 0).astype(np.int64)
            edge[c.length :] -= edge[: -c.length].copy() if len(edge) > c.length else 0
            gone = np.cumsum(edge)[:-1] > 0
            change = np.concatenate([[True], w.doc[1:] != w.doc[:-1]]) if len(gone) else gone
            lo = np.flatnonzero(gone & (change | ~np.concatenate([[False], gone[:-1]])))
            hi = np.flatnonzero(gone & np.concatenate([change[1:] | ~gone[1:], [True]])) + 1 if len(gone) else lo
            spans = pa.StructArray.from_arrays([pa.array(x - w.offs[w.doc[lo]]) for x in (lo, hi)], ["lo", "hi"])
            at = np.searchsorted(w.doc[lo], np.arange(part.num_rows + 1))
            removed = np.bincount(w.doc, weights=gone, minlength=part.num_rows).astype(np.int64)
            kept = tk.joined_words(w.buf, w.start, w.end, w.doc, ~gone, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(w.count), pa.array(removed), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans), kept], ["key", "first", "n_words", "n_removed", "spans", "kept"])

    return run


def frequent(distinct: DataFrame, c: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the anchors and windows that a sample of texts has most often."""
    total = distinct.count()
    sample = distinct if total <= SAMPLE else distinct.sample(SAMPLE / total, seed=11)
    least = max(2.0, SHARE * min(total, SAMPLE))
    n = sample.select("text").mapInArrow(counted(c), "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = [n.where(F.col("kind") == k).orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").collect() for k in (0, 1)]
    return tuple(np.sort(np.array([r.h for r in rows], np.int64).view(U64)) for rows in top)


class Shared(NamedTuple):
    """documents: doc_id, id and key of each row; texts: key, first, n_words, n_removed, spans and kept of each distinct text."""

    documents: DataFrame
    texts: DataFrame
    table: str


def shared_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", cover: Cover = Cover()) -> Shared:
    """Find each word that a window covers whose words also begin in a document with a smaller id.

    Ids are whole numbers; a null one comes after all others.  Rows with equal
    ids are no earlier than each other, so they lose nothing to each other.
    Null and empty texts have no words; a text with fewer words than a window
    loses none; very long ones are judged whole, in one task.  Other columns
    are not read.  ``texts`` says what the row with the smallest id of each
    text loses; ``without_shared`` gives a row for each row.  ``table`` is a
    scratch table, to be dropped when the result has been used.
    """
    spark = prepare(df.sparkSession)
    c = cover.checked()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    table = f"tallyweave_words_{uuid.uuid4().hex}"
    distinct = rows.groupBy("key").agg(F.first("text").alias("text"), F.min("id").alias("first")).withColumn("row", F.monotonically_increasing_id())
    distinct.write.bucketBy(n, "key").sortBy("key").format("parquet").option("path", fresh_path(spark, "distinct-texts")).saveAsTable(table)
    distinct = spark.table(table)
    keys = distinct.select("row", "key")

    anchors, windows = frequent(distinct, c)
    least = np.full(len(windows), LAST)
    if len(windows):
        for r in distinct.select("text", "first").mapInArrow(least_ids(c, windows), "h long, first long").groupBy("h").agg(F.min("first").alias("first")).collect():  # FREQUENT rows at most
            least[np.searchsorted(windows, np.int64(r.h).view(U64))] = r.first

    sent = distinct.select("text", "row").mapInArrow(send_anchors(c, anchors), "h long, row long")
    twice = sent.repartition(n, "h").sortWithinPartitions("h").mapInArrow(repeated, "row long, h long")
    lists = twice.groupBy("row").agg(F.collect_list("h").alias("hashes")).join(keys, "row").select("key", "hashes")
    around = distinct.join(lists, "key", "left").select("text", "row", "first", "hashes").mapInArrow(extend(c, anchors, windows), "a long, b long, first long, row long, s int")
    gone = around.repartition(n, "a").sortWithinPartitions("a", "b", "first").mapInArrow(later, "row long, s int")
    places = written(gone.groupBy("row").agg(F.collect_list("s").alias("places")).join(keys, "row").select("key", "places"), "shared-places")
    result = distinct.join(places, "key", "left").select("text", "key", "first", "places").mapInArrow(cut_out(c, windows, least), "key binary, first long, n_words long, n_removed long, spans array<struct<lo: long, hi: long>>, kept string")
    return Shared(rows.select("doc_id", "id", "key"), result, table)


def of_rows(documents: DataFrame, judged: DataFrame, length: int, emptied: dict) -> DataFrame:
    """A row for each document: a later copy of a text that has a window loses all of it (``emptied``: what its columns say then)."""
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= length)
    return documents.join(judged, "key").select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), *[F.when(copy, v).otherwise(F.col(k)).alias(k) for k, v in emptied.items()])


def without_shared(df: DataFrame, doc_id: str = "doc_id", text: str = "text", cover: Cover = Cover()) -> DataFrame:
    """A row for each row of ``df``: doc_id, n_words, n_removed, spans (word numbers, half-open) and kept, the words that stay, joined by one space."""
    got = shared_words(df, doc_id, text, cover)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_words").alias("hi")))
    out = written(of_rows(got.documents, got.texts, cover.length, {"spans": whole, "kept": F.lit("")}), "without-shared")
    df.sparkSession.sql(f"drop table {got.table}")
    return out


SQL = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
places as (select doc_id, w, unnest(range(1, len(w) - 11)) as s from words where len(w) >= 13),
windows as (select doc_id, s, md5(array_to_string(w[s : s + 12], ' ')) as h from places),
firsts as (select h, min(doc_id) as least from windows group by h),
gone as (select distinct doc_id, s + o as i from windows join firsts using (h), (select unnest(range(13)) as o) where least < doc_id),
marked as (select doc_id, list(i) as i from gone group by doc_id),
flat as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from words),
kept as (select f.doc_id, string_agg(f.x, ' ' order by f.i) as kept from flat f left join gone g on f.doc_id = g.doc_id and f.i = g.i where g.i is null group by f.doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(len(m.i), 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from words w left join marked m using (doc_id) left join kept k using (doc_id)
"""
