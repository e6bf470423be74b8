"""Vectorised byte and word kernels over Arrow string columns (numpy only).

A batch of texts is one byte buffer with offsets.  Words are maximal runs of
bytes other than ASCII white space (0x20, 0x09-0x0D), so no decoding is
needed: UTF-8 continuation bytes never look like white space.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, grown as needed."""
    have = _pow_cache.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
        steps[0] = 1
        have = _pow_cache[base] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def with_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between the documents of a chunk."""
    return mix(h + doc.astype(U64) * U64(0x9E3779B97F4A7C15))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"", col.type))
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def release() -> None:
    """Give freed memory back: a worker lives on between tasks, next to others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def row_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose whole texts hold about ``limit`` bytes (one text may be longer)."""
    size = np.zeros(len(col) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), out=size[1:])
    i = 0
    while i < len(col):
        j = min(len(col), max(int(np.searchsorted(size, size[i] + limit, side="right")) - 1, i + 1))
        yield i, j
        i = j
    release()


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts in runs of about ``limit`` bytes (one text may be longer)."""
    buf, offs = buffers(col)
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    release()


def prefix(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of byte values times powers; see ``span_hash``."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * _powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end), alike wherever the span lies."""
    n = len(p)
    raw = (p[end] - p[start]) * _powers(_BASE_INV, n)[start]
    return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; ``between`` marks the bytes of no word."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~between[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    first = solid.copy()
    first[1:] &= edge[1:n] | ~solid[:-1]
    last = solid.copy()
    last[:-1] &= edge[1:n] | ~solid[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def joined_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, keep: np.ndarray, n_docs: int) -> pa.Array:
    """The kept words of each document, joined by one space, as strings."""
    start, end, doc = start[keep], end[keep], doc[keep]
    size = end - start + 1  # with the space behind
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    out = np.append(buf, np.uint8(0x20))[np.minimum(take, len(buf))]
    out[at[1:] - 1] = 0x20
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    solid = np.ones(len(out), bool)
    solid[at[1:][last] - 1] = False
    offs = np.zeros(n_docs + 1, np.int64)
    offs[1:] = np.cumsum(np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64) - (np.bincount(doc, minlength=n_docs) > 0))
    return pa.StringArray.from_buffers(n_docs, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(out[solid].tobytes()))


def word_counts(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document, and the offsets of its words."""
    count = np.bincount(doc, minlength=n_docs).astype(np.int64)
    return count, np.concatenate([[0], np.cumsum(count)])


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive word hashes (len(h) - k + 1 of them)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.full(m, (salt * 0x9FB21C651E98DF25 + k) & (2**64 - 1), dtype=U64)
    for j in range(k):
        out = out * U64(0xD1342543DE82EF95) + h[j : j + m]
    return mix(out)


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per byte or word) of each document."""
    c = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's k-word shingles.

    With fewer than k words (but one at least) the whole sequence is the one
    shingle; with none the set is empty.
    """
    n_docs = len(offs) - 1
    start, end, doc = words(buf, offs)
    h = span_hash(prefix(buf, lower), start, end)
    count, woff = word_counts(doc, n_docs)
    w = windows(h, k)
    out = []
    for d in range(n_docs):
        a, n = woff[d], count[d]
        if n >= k:
            out.append(np.unique(w[a : a + n - k + 1]))
        elif n:
            out.append(windows(h[a : a + n], int(n), salt=1))
        else:
            out.append(np.zeros(0, U64))
    return out


def csr(parts: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values and offsets."""
    offs = np.zeros(len(parts) + 1, np.int64)
    if parts:
        np.cumsum([len(p) for p in parts], out=offs[1:])
    return (np.concatenate(parts).astype(dtype, copy=False) if parts else np.zeros(0, dtype)), offs


def list_array(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in batches that are sorted by them.

    Holds one group at a time, so callers must bound a group's size.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        new = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            c = b.column(b.schema.get_field_index(k))
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            new[1:] |= pc.not_equal(c[1:].is_null(), c[:-1].is_null()).to_numpy(zero_copy_only=False)
        if held:
            last = held[-1]
            new[0] = any(last.column(last.schema.get_field_index(k))[-1].as_py() != b.column(b.schema.get_field_index(k))[0].as_py() for k in keys)
        cuts = np.flatnonzero(new)
        at = 0
        for c in cuts:
            if c > at:
                held.append(b.slice(at, c - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], int(c)
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)
