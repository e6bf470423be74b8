"""Token-ID output: texts as Parquet lists of ids, in order, with metadata.

Layout of an output folder:

``tokens/``  one file for each shard (a range of documents), rows ascending:
             doc_id, shard, offset (ids before it in the shard), n_tokens,
             meta (a struct of the metadata columns), tokens (list of ints).
``shards/``  a row for each shard: its first id's place in the whole and the
             number of its ids; as many rows as there are write tasks.

Row groups and pages are small, and parquet-mr writes a column and an offset
index for each, so a reader of a few documents or of ``n_tokens`` alone never
touches the pages of the ids.  Ids are dictionary-encoded, or delta-packed
where ``encoding="delta"``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkit as tk
from .runtime import prepare

CACHE_WORDS = 500_000
JOINED_WORDS = 500
STOPPED = r"([\pL\pN])([.,])([ \t\n\v\f\r]|$)"

#: encoding: Parquet writer options of the ids.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#tokens.list.element": "false"},
}


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    Right for tokenizers that cut at white space before they merge; with
    ``apart=False`` a text is encoded as a whole instead.  With ``lower`` (for
    tokenizers that lower-case letters and cut between a letter or digit and
    a stop) words differ neither in ASCII case nor by a stop at their end, so
    that there are fewer of them.
    """

    def __init__(self, path: str, apart: bool = True, lower: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.apart, self.lower = Tokenizer.from_file(path), apart, lower
        self.forget()

    def forget(self) -> None:
        """Known words: sorted 64-bit hashes, and where in ``ids`` the ids of each are."""
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        at, size = [], []
        for i in range(0, len(words), JOINED_WORDS):
            some = words[i : i + JOINED_WORDS]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            first = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            starts = np.zeros(len(some) + 1, np.int64)
            np.cumsum([len(w) + 1 for w in some], out=starts[1:])
            cuts = np.searchsorted(first, starts)
            if self.used + len(first) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(first), "<u4")])
            self.ids[self.used : self.used + len(first)] = got.ids
            at.append(cuts[:-1] + self.used)
            size.append(np.diff(cuts))
            self.used += len(first)
        order = np.argsort(hashes)
        where = np.searchsorted(self.hashes, hashes[order])
        self.at = np.insert(self.at, where, np.concatenate(at)[order])
        self.size = np.insert(self.size, where, np.concatenate(size)[order])
        self.hashes = np.insert(self.hashes, where, hashes[order])

    def rows(self, words: pa.Array) -> np.ndarray:
        """The row of each of some different words among the known ones; those that are new are learned."""
        buf, offs = tk.buffers(words)
        h = tk.span_hash(tk.prefix(buf), offs[:-1], offs[1:])
        if not len(h):
            return np.zeros(0, np.int64)

        def new() -> np.ndarray:
            at = np.searchsorted(self.hashes, h)
            return np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != h) if len(self.hashes) else np.arange(len(h))

        missing = new()
        if len(missing) and len(self.hashes) + len(missing) > CACHE_WORDS:
            self.forget()
            missing = new()
        if len(missing):
            self.learn(words.take(pa.array(missing)).to_pylist(), h[missing])
        return np.searchsorted(self.hashes, h)

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        text = pc.fill_null(text.cast(pa.string()), "")
        if not self.apart:
            lists = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(text.to_pylist(), add_special_tokens=False)]
            return tk.csr(lists, "<u4")
        # The string of a special token stays as it is, as it is none in capitals.
        if self.lower and not pc.any(pc.match_substring(text, "<|")).as_py():
            text = pc.replace_substring_regex(pc.ascii_lower(text), STOPPED, r"\1 \2\3")
        split = pc.ascii_split_whitespace(text)
        offs = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        row = self.rows(coded.dictionary)
        code = coded.indices.to_numpy()
        if not len(code):
            return np.zeros(0, "<u4"), np.zeros(len(text) + 1, np.int64)
        n = self.size[row][code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.at[row][code] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[offs - offs[0]]


@cache
def encoder(path: str, apart: bool, lower: bool) -> WordEncoder:
    """One for each Python worker: its tasks share the words it knows."""
    return WordEncoder(path, apart, lower)


#: Texts that tell tokenizers apart: white space of all kinds, case, stops, marks, digits, other scripts, special strings.
PROBES = (
    "Hello, World. It's 3.14 (or so)!\nNew line\tand  two blanks ", "ÄÖÜ straße Über naïve café É", "THE end.Not the END. U.S.A. a.b.c", "x=1;y=2 #tag @user a_b-c/d\\e", "日本語 テキスト и русский العربية", "don't stop... we'll \"quote\" 'it'", "<|endoftext|> </s> [CLS] <unk>",
    "emoji 😀 e\u0301 \u00a0nbsp", "1,234,567.89 10% $5 2020-01-31", "ALLCAPS MixedCase lower A.", " leading and trailing ", "tab\there\x0bvertical\x0cfeed\r\n", "",
)


def check_words(vocabulary: str, lower: bool) -> None:
    """Raises where encoding word by word differs from encoding whole texts."""
    probes = pa.array(PROBES)
    (a, i), (b, j) = WordEncoder(vocabulary, True, lower)(probes), WordEncoder(vocabulary, False, False)(probes)
    if not (np.array_equal(a, b) and np.array_equal(i, j)):
        raise ValueError(f"{vocabulary} does not cut at white space before it merges{' or tells capitals apart' if lower else ''}: encode whole texts")


def with_end(ids: np.ndarray, offs: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """An end id after each document."""
    if end_id is None:
        return ids, offs
    return np.insert(ids, offs[1:], end_id), offs + np.arange(len(offs))


def encoded(path: str, end_id: int | None, apart: bool, lower: bool):
    """mapInArrow over sorted rows: ids, and their place within the task's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, total = encoder(path, apart, lower), TaskContext.get().partitionId(), 0
        for b in batches:
            text = b.column(1)
            for a, z in tk.row_chunks(text, 4 * tk.CHUNK_BYTES):
                ids, offs = with_end(*encode(text.slice(a, z - a)), end_id)
                cols = [b.column(0).slice(a, z - a), pa.array(np.full(z - a, shard, np.int32)), pa.array(offs[:-1] + total), pa.array(np.diff(offs)), b.column(2).slice(a, z - a), tk.list_array(ids.astype(np.int32), offs)]
                total += int(offs[-1])
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "shard", "offset", "n_tokens", "meta", "tokens"])

    return run


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (), apart: bool = False, lower: bool = False, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_rows: int = 2000) -> None:
    """Encode every row of ``df`` and write the folder ``path``.

    Rows come in ascending doc_id order, null doc_ids first, rows with equal
    doc_ids by a hash of their text; equal rows are all written.  A null or
    empty text has no ids but the end id; a very long one is encoded whole, by
    one task.  Metadata columns may have any name: they go into a struct; other
    columns are left out.  An empty table gives an empty folder.

    Texts are encoded whole.  ``apart`` and ``lower`` encode each distinct word
    once, which is right for some tokenizers only (see ``WordEncoder``): one
    that gives other ids for ``PROBES`` is refused.
    """
    spark = prepare(df.sparkSession)
    if apart:
        check_words(vocabulary, lower)
    meta = F.struct(*[F.col(c) for c in metadata]) if metadata else F.struct(F.lit(None).cast("int").alias("none"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), meta.alias("meta"), F.xxhash64(text).alias("h"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([T.StructField("doc_id", kinds["doc_id"]), T.StructField("shard", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("meta", kinds["meta"]), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    options = {"parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows)} | ENCODINGS[encoding]
    rows.select("doc_id", "text", "meta").mapInArrow(encoded(vocabulary, end_id, apart, lower), out).write.options(**options).parquet(f"{path}/tokens")
    sums = spark.read.schema(out).parquet(f"{path}/tokens").groupBy("shard").agg(F.sum("n_tokens").alias("n_ids"))
    # One row for each write task, so this one window over all of them stays small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id"), "n_ids").write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """doc_id, start (ids before it in the whole), n_tokens and the chosen columns."""
    shards = spark.read.parquet(f"{path}/shards")
    rows = spark.read.parquet(f"{path}/tokens")
    return rows.join(F.broadcast(shards), "shard").select("doc_id", (F.col("first_id") + F.col("offset")).alias("start"), "n_tokens", *columns)


@F.arrow_udf(T.LongType())
def ids_crc32(tokens: pa.Array) -> pa.Array:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    values = tokens.values.to_numpy(zero_copy_only=False).astype("<u4")
    offs = tokens.offsets.to_numpy()
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.int64())
