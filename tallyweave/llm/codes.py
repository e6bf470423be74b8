"""Vector compression into short codes (product quantisation) in whole numbers.

Vectors are cut into equal parts, and each part is replaced by the number of
the nearest entry in a codebook of that part.  Components are whole numbers
(``floor(scale * x)``), so sums do not depend on the order of adding and every
run gives the same codebooks.

Vectors are packed once into blocks, written as Parquet: the components of a
block as one column-wise array, dimension by dimension.  A round of training
is one ``treeAggregate`` over the blocks: each task adds up the distances of
its block dimension by dimension, takes the nearest entries, adds the parts
into a tensor of sums and counts with ``np.add.at``, and the tensors merge
through a tree, so the driver receives a few tensors of a size that depends on
the codebooks alone.  A lost executor costs its blocks of one round, read
again from the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, written

#: Vectors of a block.
BLOCK = 2048
#: Components beyond (after scaling) could exceed 64 bits in a sum of squares.
MOST = 1 << 26


class Codes(NamedTuple):
    """rows: those kept with code and error; books: (part, entry, position) -> component."""

    rows: DataFrame
    books: np.ndarray


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its components are there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & (F.size(vector) > 0), F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def pack(dims: int):
    """mapInArrow over (row, v): blocks of rows with the components dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                flat = part.column(1).flatten().to_numpy()
                columns = np.ascontiguousarray(flat.reshape(-1, dims).T)
                at = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.ListArray.from_arrays(at, part.column(0)), pa.array([columns.tobytes()], pa.binary())], ["n", "rows", "columns"])

    return run


def nearest(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, vector) -> nearest entry, ties to the lower one, and its squared distance."""
    parts, entries, width = books.shape
    n = columns.shape[1]
    code, error = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    for part in range(parts):
        distance = np.zeros((entries, n), np.int64)
        for d in range(width):
            gap = columns[part * width + d].astype(np.int64)[None, :] - books[part, :, d][:, None]
            distance += gap * gap
        code[part] = distance.argmin(axis=0)
        error[part] = np.take_along_axis(distance, code[part][None, :], axis=0)[0]
    return code, error


def trained_round(blocks: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of its parts; one without parts stays."""
    parts, entries, width = books.shape
    sent = blocks.sparkSession.sparkContext.broadcast(books)  # parts x entries x width numbers, whatever the table's size

    def add(total: tuple[np.ndarray, np.ndarray], block) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total
        columns = np.frombuffer(block.columns, np.int32).reshape(dims, block.n)
        code, _ = nearest(columns, sent.value)
        for part in range(parts):
            np.add.at(sums[part], code[part], columns[part * width : (part + 1) * width].T.astype(np.int64))
            np.add.at(counts[part], code[part], 1)
        return total

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    zero = (np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64))
    sums, counts = blocks.select("n", "columns").rdd.treeAggregate(zero, add, merge, depth=3)
    sent.destroy()
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def assign(books: np.ndarray, dims: int):
    """mapInArrow over blocks: a row for each vector, with its code in hex and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column(0)[i].as_py()
                columns = np.frombuffer(b.column(2)[i].as_buffer(), np.int32).reshape(dims, n)
                code, error = nearest(columns, books)
                text = code.T.astype(np.uint8).tobytes().hex()
                step = 2 * len(books)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, 1).flatten(), pa.array([text[k : k + step] for k in range(0, n * step, step)], pa.string()), pa.array(error.sum(axis=0))], ["row", "code", "error"])

    return run


def compressed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codes:
    """The rows of ``df`` whose vector can be used, with ``code`` and ``error``.

    Left out are null and empty vectors, those with null or non-finite
    components, and those of another length than the first vector kept, which
    is that of the smallest id.  The codebooks start as the vectors of the
    ``entries`` smallest ids (null ids come last, equal ids in the order of
    their vectors; with fewer vectors there are fewer entries).  Repeated rows
    count each.  An empty table gives an empty one.  Further columns pass
    through; ``code`` and ``error`` replace columns of those names.  A length
    that ``parts`` does not divide, and components beyond 2^26 after scaling,
    are errors.  ``entries`` is 256 at most.
    """
    prepare(df.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold 256 entries at most")
    names = [c for c in df.columns if c.lower() not in ("code", "error")]
    kept = df.where(usable(F.col(vector)))
    first = kept.orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector)).limit(entries)
    dims = next((r[0] for r in first.select(F.size(vector)).limit(1).collect()), None)
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    if dims is None:
        return Codes(df.select(*names).where("false").withColumn("code", F.lit("")).withColumn("error", F.lit(0).cast("long")), np.zeros((parts, 0, 0), np.int64))
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size(vector) == dims)
    small = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) <= MOST)
    packed = kept.select(row.alias("row"), F.when(small, whole_numbers(F.col(vector), scale)).otherwise(F.raise_error(F.lit("a component beyond 2^26 after scaling"))).alias("v"))
    own = packed.schema["row"].dataType.simpleString()
    blocks = written(packed.mapInArrow(pack(dims), f"n int, rows array<{own}>, columns binary"), "vector-blocks")

    seeds = kept.orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector)).limit(entries).select(whole_numbers(F.col(vector), scale)).collect()
    books = np.array([r[0] for r in seeds], np.int64).reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = trained_round(blocks, books, dims)
    out = blocks.mapInArrow(assign(books, dims), f"row {own}, code string, error long")
    return Codes(out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "code", "error"), books)


def books_sha256(books: np.ndarray) -> str:
    """Digest of all components by part, entry and position, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with ``label_error``, the error summed over equal labels (nulls together).

    Sums are made before rows move; a frequent label is split by the adaptive
    join, since its side with the sums has one row.
    """
    rows = written(rows, "vector-codes")
    sums = rows.groupBy(F.col(label).alias("of_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col(label).eqNullSafe(F.col("of_label"))).drop("of_label")


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    step = """
d{k} as materialized (select v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) as dist from comps v join b{k} b using (part, pos) group by all),
a{k} as materialized (select vec_id, part, arg_min(entry, dist * 256 + entry) as entry, min(dist) as dist from d{k} group by all),"""
    update = """
s{k} as (select part, entry, pos, sum(x)::bigint as total, count(*) as n from comps join a{k} using (vec_id, part) group by all),
b{next} as materialized (select b.part, b.entry, b.pos, coalesce(((s.total - ((s.total % s.n) + s.n) % s.n) // s.n)::bigint, b.x) as x from b{k} b left join s{k} s using (part, entry, pos)),"""
    body = "".join(step.format(k=k) + update.format(k=k, next=k + 1) for k in range(rounds)) + step.format(k=rounds)
    return f"""
with kept as (select vec_id, embedding, label from embeddings where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
flat as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as d, len(embedding) // {parts} as width from kept),
comps as materialized (select vec_id, d // width as part, d % width as pos, floor(x::double * {scale})::bigint as x from flat),
seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {entries}),
b0 as materialized (select part, entry, pos, x from comps join seeds using (vec_id)),{body}
digest as (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from b{rounds}),
coded as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(dist)::bigint as error from a{rounds} group by vec_id),
scored as (select k.vec_id, c.code, c.error, k.label from kept k join coded c using (vec_id))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from scored, digest
"""


SQL = _sql()
