"""Removal of long byte strings that occur more than once in a corpus, exactly.

A window is a string of ``length`` bytes.  Each has one anchor: the leftmost
of its ``gram``-byte substrings with the smallest hash.  Equal windows have
equal anchors at equal places, so only windows with the same anchor need be
compared, and a document has about one anchor in ``(length - gram) / 2``
bytes.  The plan:

1. Equal texts become one, with a count (``texts``, a table bucketed by the
   text's md5, so that the later passes join it without moving a text).
2. The consecutive windows of one anchor span a fragment.  Fragments go into
   a narrow table (text, place, hash of the anchor, hash of the fragment).
3. A fragment that occurs twice repeats as a whole.  One whose anchor occurs
   nowhere else repeats nowhere.  What is left, mostly the two ends of each
   repeated passage, is settled by its bytes: fragments are grouped by anchor,
   a run-length index is built over groups of bounded size, and its matching
   statistics mark the windows that match elsewhere.
4. Anchor groups above the bound (one passage in very many contexts) are split
   by the bytes around the anchor: the windows of a fragment are dealt into
   parts by where the anchor lies in them, and parts are grouped by the bytes
   that all their windows hold.  Equal parts repeat as a whole, and the index
   is built over these smaller groups as in step 3.  What is still too large
   (very many parts that differ in a few bytes at their ends) is split once
   more, into single windows, where equal bytes are all there is to compare.

Hashes have 64 bits (texts: 128).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .runindex import MOST_TEXTS, RunIndex
from .runtime import fresh_path, prepare, written

GROUP_BYTES = 1 << 20
INDEX_BYTES = 1 << 20
#: Parts into which the windows of a large group are dealt.
PARTS = 16
U64 = np.uint64
_PLACE = U64((1 << 31) - 1)


class Repeats(NamedTuple):
    """documents: doc_id and key of each row; texts: key, n_bytes, spans and kept bytes of each distinct text."""

    documents: DataFrame
    texts: DataFrame
    table: str


def fragments(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash, fragment hash, place of the anchor) of all fragments of a chunk."""
    n, w = len(buf), length - gram + 1
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z, z, z
    p = tk.prefix(buf)
    at = np.arange(n - gram + 1)
    grams = tk.span_hash(p, at, at + gram)
    value = (grams & ~_PLACE) | at.astype(U64)
    # sliding minimum: from both sides within blocks of one window
    m = -(-len(value) // w) * w
    padded = np.full(m, ~U64(0))
    padded[: len(value)] = value
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(right[: n - length + 1], left[w - 1 : w + n - length]) & _PLACE).astype(np.int64)

    start = np.arange(n - length + 1)
    text = np.searchsorted(offs, start, side="right") - 1
    whole = np.flatnonzero(start + length <= offs[text + 1])
    if not len(whole):
        return z, z, z, z, z, z
    text, anchor = text[whole], anchor[whole]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(whole)]]))
    begin = whole[first]
    f = tk.span_hash(p, begin, begin + count + length - 1)
    return text[first], begin - offs[text[first]], count, grams[anchor[first]].view(np.int64), f.view(np.int64), anchor[first] - begin


def find_fragments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in tk.row_chunks(b.column(1)):
                key, buf = b.column(0).slice(i, j - i), tk.buffers(b.column(1).slice(i, j - i))
                text, *fields = fragments(*buf, length, gram)
                yield pa.RecordBatch.from_arrays([key.take(pa.array(text)), *map(pa.array, fields)], ["key", "start", "windows", "anchor", "fragment", "at"])

    return run


PIECE = "key binary, start long, windows long, at long, anchor long, settled boolean, large boolean, bytes binary"
LISTED = ("start", "windows", "at", "anchor", "settled", "large")


def cut_fragments(length: int):
    """mapInArrow over (key, text, place of the text, listed): the bytes of the listed fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in tk.row_chunks(b.column(1)):
                buf, offs = tk.buffers(b.column(1).slice(i, j - i))
                base, listed = b.column(2).slice(i, j - i).to_numpy(), b.column(3).slice(i, j - i)
                flat = listed.flatten()
                of = np.repeat(np.arange(j - i), listed.value_lengths().to_numpy(zero_copy_only=False))
                raw = buf.tobytes()
                lo = (offs[:-1] - base)[of] + flat.field("start").to_numpy()
                cut = [raw[x : x + n + length - 1] for x, n in zip(lo.tolist(), flat.field("windows").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(of)), *[flat.field(c) for c in LISTED], pa.array(cut, pa.binary())], ["key", *LISTED, "bytes"])

    return run


def find_parts(length: int, gram: int, step: int):
    """mapInArrow over pieces: runs of ``step`` windows by where the anchor lies in them, grouped by the bytes they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            for i, j in tk.row_chunks(col["bytes"]):
                buf, offs = tk.buffers(col["bytes"].slice(i, j - i))
                windows, at, start = (col[c].slice(i, j - i).to_numpy() for c in ("windows", "at", "start"))
                of = np.repeat(np.arange(j - i), windows)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                part = (at[of] - nth) // step
                first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])])) if len(of) else np.zeros(0, np.int64)
                count = np.diff(np.concatenate([first, [len(of)]]))
                of, nth, part = of[first], nth[first], part[first]
                p, lo, anchor = tk.prefix(buf), offs[of] + nth, offs[of] + at[of]
                shared = tk.span_hash(p, anchor - part * step, anchor - np.minimum(part * step + step - 1, length - gram) + length)
                group = tk.mix(shared + part.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
                whole = tk.span_hash(p, lo, lo + count + length - 1).view(np.int64)
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([*[col[c].slice(i, j - i).take(rows) for c in ("key", "start", "settled")], pa.array(start[of] + nth), pa.array(count), pa.array(at[of] - nth), pa.array(group), pa.array(whole)], ["key", "of", "done", "start", "windows", "at", "anchor", "fragment"])

    return run


def index_groups(length: int):
    """Spans of the windows that match another fragment of their anchor group."""

    def spans(t: pa.Table) -> pa.RecordBatch | None:
        texts = t["bytes"].to_pylist()
        index = RunIndex.build(texts)
        far = index.matching_statistics() >= length
        windows, start = t["windows"].to_numpy(), t["start"].to_numpy()
        rows, lo, hi = [], [], []
        for i in np.flatnonzero(~t["settled"].to_numpy(zero_copy_only=False)):
            hit = np.flatnonzero(far[index.starts[i] : index.starts[i] + windows[i]])
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                for a, z in zip(hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])], strict=True):
                    rows.append(i)
                    lo.append(start[i] + a)
                    hi.append(start[i] + z + length)
        if not rows:
            return None
        key = t["key"].combine_chunks().take(pa.array(rows))
        return pa.RecordBatch.from_arrays([key, pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = rows = 0
        for g in tk.groups(batches, ["anchor"]):
            if held and (size + g.nbytes > INDEX_BYTES or rows + g.num_rows > MOST_TEXTS):
                if (got := spans(pa.concat_tables(held))) is not None:
                    yield got
                held, size, rows = [], 0, 0
            held.append(g)
            size, rows = size + g.nbytes, rows + g.num_rows
        if held and (got := spans(pa.concat_tables(held))) is not None:
            yield got

    return run


def window_hashes(length: int):
    """mapInArrow over pieces: the hash of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            for i, j in tk.row_chunks(col["bytes"], limit=1 << 17):
                buf, offs = tk.buffers(col["bytes"].slice(i, j - i))
                windows, start = (col[c].slice(i, j - i).to_numpy() for c in ("windows", "start"))
                of = np.repeat(np.arange(j - i), windows)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                at = offs[of] + nth
                h = tk.span_hash(tk.prefix(buf), at, at + length).view(np.int64)
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([col["key"].slice(i, j - i).take(rows), pa.array(start[of] + nth), pa.array(h), col["settled"].slice(i, j - i).take(rows)], ["key", "lo", "h", "settled"])

    return run


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans, and what a text keeps outside them."""
    names = ["key", "n_bytes", "spans", "kept"]
    for b in batches:
        for i, j in tk.row_chunks(b.column(1)):
            buf, offs = tk.buffers(b.column(1).slice(i, j - i))
            raw = buf.tobytes()
            kept, los, his = [], [], []
            for text, spans in enumerate(b.column(2).slice(i, j - i)):
                a, z = int(offs[text]), int(offs[text + 1])
                if not spans.is_valid or not len(spans):
                    merged = np.zeros((0, 2), np.int64)
                else:
                    flat = spans.values
                    lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                    order = np.argsort(lo, kind="stable")
                    lo, upto = lo[order], np.maximum.accumulate(hi[order])
                    new = np.concatenate([[True], lo[1:] > upto[:-1]])
                    merged = np.stack([lo[new], upto[np.concatenate([new[1:], [True]])]], axis=1)
                at = a
                parts = []
                for x, y in merged.tolist():
                    parts.append(raw[at : a + x])
                    at = a + y
                parts.append(raw[at:z])
                kept.append(b"".join(parts))
                los.append(merged[:, 0])
                his.append(merged[:, 1])
            lo, at = tk.csr(los, np.int64)
            hi, _ = tk.csr(his, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pairs), pa.array(kept, pa.binary())], names)


def classified(found: DataFrame, length: int, group_bytes: int, name: str) -> DataFrame:
    """Fragments that can repeat: ``settled`` if they repeat as a whole or are ``done``, ``large`` by their group's size.

    One of equal fragments is ``sent`` where its bytes are needed: in groups
    with something that is not settled.
    """
    same = found.groupBy("anchor", "fragment").agg(F.count("*").alias("n"), F.min("row").alias("one"), F.first("windows").alias("windows"), F.min(~F.col("done")).alias("open"))
    same = written(same, "same").withColumn("left", F.col("open") & (F.col("n") == 1))
    group = same.groupBy("anchor").agg(F.count("*").alias("m"), F.max("left").alias("left"), F.sum(F.col("windows") + length - 1).alias("size"))
    group = group.where("m >= 2 and left").select("anchor", (F.col("size") > group_bytes).alias("large"))
    status = same.join(group, "anchor", "left").where("n >= 2 or large is not null").select("anchor", "fragment", (F.col("n") >= 2).alias("twice"), F.when(F.col("large").isNotNull(), F.col("one")).alias("one"), "large")
    keep = ["key", *(["of"] if "of" in found.columns else []), "start", "windows", "at", "anchor", "done"]
    return written(found.join(status, ["anchor", "fragment"]).select(*keep, (F.col("twice") | F.col("done")).alias("settled"), "large", F.col("row").eqNullSafe(F.col("one")).alias("sent")), name)


def of_whole(marked: DataFrame, length: int) -> DataFrame:
    return marked.where("settled").select("key", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + length - 1).alias("hi"))


def indexed(pieces: DataFrame, length: int, n: int) -> DataFrame:
    """What the run-length indexes of the groups find."""
    return pieces.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(index_groups(length), "key binary, lo long, hi long")


def single(pieces: DataFrame, length: int) -> DataFrame:
    """Groups whose parts share all but a few bytes, window by window."""
    hashed = pieces.mapInArrow(window_hashes(length), "key binary, lo long, h long, settled boolean")
    twice = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n >= 2").select("h")
    return hashed.where("not settled").join(twice, "h").select("key", "lo", (F.col("lo") + length).alias("hi"))


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, gram: int = 128, group_bytes: int = GROUP_BYTES) -> Repeats:
    """Find each byte of ``text`` that a ``length``-byte string covers which starts elsewhere too.

    Null texts are empty; rows with equal texts repeat each other, whatever
    their ids; texts shorter than ``length`` have nothing to remove, very long
    ones are cut whole, in one task.  Other columns are not read.  Spans are half-open byte
    ranges that neither overlap nor touch.  ``table`` is a scratch table in
    the shared folder, to be dropped when the result has been used.
    """
    spark = prepare(df.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    table = f"tallyweave_texts_{uuid.uuid4().hex}"
    rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")).write.bucketBy(n, "key").sortBy("key").format("parquet").option("path", fresh_path(spark, "distinct-texts")).saveAsTable(table)
    texts = spark.table(table)
    narrow = rows.select("doc_id", "key")

    found = texts.select("key", "text").mapInArrow(find_fragments(length, gram), "key binary, start long, windows long, anchor long, fragment long, at long")
    marked = classified(written(found.withColumn("row", F.monotonically_increasing_id()).withColumn("done", F.lit(False)), "fragments"), length, group_bytes, "marked")
    listed = marked.where("sent").groupBy("key").agg(F.collect_list(F.struct(*LISTED)).alias("listed"))
    pieces = written(texts.join(listed, "key").select("key", "text", F.lit(0).cast("long").alias("of"), "listed").mapInArrow(cut_fragments(length), PIECE), "pieces")
    spans = [of_whole(marked, length), indexed(pieces.where("not large"), length, n)]

    big = pieces.where("large")
    if not big.isEmpty():
        step = max(1, (length - gram + 1) // PARTS)
        parts = big.mapInArrow(find_parts(length, gram, step), "key binary, of long, done boolean, start long, windows long, at long, anchor long, fragment long")
        parts = classified(written(parts.withColumn("row", F.monotonically_increasing_id()), "parts"), length, group_bytes, "marked-parts")
        listed = parts.where("sent").groupBy("key", F.col("of").alias("start")).agg(F.collect_list(F.struct(*LISTED)).alias("listed"))
        smaller = big.select("key", "start", "bytes").join(listed, ["key", "start"]).select("key", "bytes", "start", "listed")
        smaller = written(smaller.mapInArrow(cut_fragments(length), PIECE), "smaller-pieces")
        spans += [of_whole(parts.where("not done"), length), indexed(smaller.where("not large"), length, n), single(smaller.where("large"), length)]
    copied = texts.where(f"copies >= 2 and octet_length(text) >= {length}").select("key", F.lit(0).cast("long").alias("lo"), F.octet_length("text").cast("long").alias("hi"))
    spans = reduce(DataFrame.unionByName, spans, copied).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    result = texts.select("key", "text").join(spans, "key", "left").select("key", "text", "spans").mapInArrow(cut_out, "key binary, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary")
    return Repeats(narrow, result, table)


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, gram: int = 128, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row for each row of ``df``: doc_id, n_bytes, spans and the kept bytes."""
    got = repeats(df, doc_id, text, length, gram, group_bytes)
    out = written(got.documents.join(got.texts, "key").drop("key"), "without-repeats")
    df.sparkSession.sql(f"drop table {got.table}")
    return out
