"""Chat formatting: turns as one byte string with a loss mask, and back.

A turn is ``<|im_start|>`` role, newline, text, ``<|im_end|>``, newline.
Control strings inside roles and texts are escaped by a backslash after their
first character; one that has backslashes there already gets one more, so the
text comes back exactly.  The bytes of a batch are laid out by columns: the
lengths of all segments give offsets, the offsets give for each output byte
its source, and one gather fills the buffer that Arrow then uses as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .runtime import prepare

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that mark turns here or in other common chat templates.
CONTROLS = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LONG_SEGMENT = 1 << 16

_RESTS = {c: [re.escape(x[1:]) for x in CONTROLS if x[0] == c] for c in "<["}
_ESCAPE = "|".join(rf"{re.escape(c)}\\*(?:{'|'.join(r)})" for c, r in _RESTS.items())
_TO = [(rf"({re.escape(c)})(\\*)({'|'.join(r)})", r"\1\2\\\3") for c, r in _RESTS.items()]
_FROM = [(re.compile(rf"({re.escape(c)})\\(\\*(?:{'|'.join(r)}))"), r"\1\2") for c, r in _RESTS.items()]
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)

PIECE = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("piece", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.ArrayType(T.IntegerType())), T.StructField("loss_bytes", T.ArrayType(T.IntegerType()))])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(col: pa.Array) -> pa.Array:
    """Texts without a control string; null is empty."""
    col = pc.fill_null(col, "")
    if not pc.any(pc.match_substring_regex(col, _ESCAPE)).as_py():
        return col
    for pattern, to in _TO:
        col = pc.replace_substring_regex(col, pattern, to)
    return col


def escaped_role(col: pa.Array) -> pa.Array:
    """A role on one line: backslashes and newlines are escaped as well."""
    col = pc.replace_substring(pc.fill_null(col, ""), "\\", "\\\\")
    return escaped(pc.replace_substring(col, "\n", "\\n"))


def unescaped(text: str) -> str:
    for pattern, to in _FROM:
        text = pattern.sub(to, text)
    return text


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.DOTALL)


def assembled(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, offsets of the turns, start of each turn's text)."""
    marks = (START.encode(), b"\n", END.encode() + b"\n")
    rb, ro = tk.buffers(escaped_role(role))
    tb, to = tk.buffers(escaped(text))
    fixed = np.frombuffer(b"".join(marks), np.uint8)
    source = np.concatenate([fixed, rb, tb])
    at = np.cumsum([0] + [len(m) for m in marks])
    n = len(ro) - 1
    size, start = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for column, mark in ((0, 0), (2, 1), (4, 2)):
        size[:, column], start[:, column] = len(marks[mark]), at[mark]
    size[:, 1], start[:, 1] = np.diff(ro), ro[:-1] + len(fixed)
    size[:, 3], start[:, 3] = np.diff(to), to[:-1] + len(fixed) + len(rb)
    size, start = size.ravel(), start.ravel()
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    short = np.where(size <= LONG_SEGMENT, size, 0)
    upto = np.concatenate([[0], np.cumsum(short)])
    step = np.arange(upto[-1])
    out[np.repeat(ends[:-1] - upto[:-1], short) + step] = source[np.repeat(start - upto[:-1], short) + step]
    for i in np.flatnonzero(size > LONG_SEGMENT):  # few and long: copied one by one, without indices
        out[ends[i] : ends[i + 1]] = source[start[i] : start[i] + size[i]]
    return out, ends[::5], ends[3::5]


def pieces(loss_role: str):
    """mapInArrow over sorted turns: runs of one conversation's turns, formatted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = TaskContext.get().partitionId(), 0
        for b in batches:
            for a, z in tk.row_chunks(b.column(3)):
                conv, role, text = (b.column(c).slice(a, z - a) for c in (0, 2, 3))
                out, offs, begin = assembled(role, text)
                ids = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
                null = conv.is_null().to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
                cut = np.concatenate([first, [len(ids)]])
                masked = pc.fill_null(pc.equal(role, loss_role), False).to_numpy(zero_copy_only=False)
                piece = np.searchsorted(first, np.arange(len(ids)), side="right") - 1
                spans = np.concatenate([[0], np.cumsum(np.bincount(piece[masked], minlength=len(first)))])
                length = offs[1:] - len(END) - 1 - begin
                texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(offs[cut].astype(np.int32)), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(np.full(len(first), shard, np.int32)), pa.array(made + np.arange(len(first))), pa.array(np.diff(cut)), texts, tk.list_array((begin - offs[cut[piece]])[masked].astype(np.int32), spans), tk.list_array(length[masked].astype(np.int32), spans)], PIECE.names)
                made += len(first)

    return run


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Conversations as formatted strings with the byte spans of the loss mask.

    A row is a run of consecutive turns of one conversation; nearly always
    that is the whole conversation, a very long one comes in several rows,
    which follow each other by (shard, piece).  Rows are dealt by ranges of
    (conversation, turn), so one huge conversation fills many tasks.  Null
    conversations are one conversation; null turns come first; turns that tie
    are ordered by role and text; null roles and texts are empty.
    """
    spark = prepare(df.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    return rows.repartitionByRange(n, *order).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(pieces(loss_role), PIECE)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted string."""
    got = _TURN.findall(formatted)
    if sum(len(START) + len(END) + 2 + len(r) + len(t) for r, t in got) != len(formatted):
        raise ValueError("not a formatted conversation")
    return [(unescaped_role(r), unescaped(t)) for r, t in got]


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over pieces in order: a row for each conversation, one piece held at a time."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    held: dict | None = None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": held["id"], "n_turns": held["turns"], "turns_sha256": held["all"].hexdigest(), "loss_chars": held["loss_chars"], "loss_sha256": held["loss"].hexdigest(), "formatted_chars": held["chars"]}], pa.schema([(x, pa.string() if "sha" in x else pa.int64()) for x in names]))

    for b in batches:
        for conv, formatted, starts, sizes in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_bytes")), strict=True):
            if held is None or held["id"] != conv:
                if held is not None:
                    yield closed()
                held = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            raw = formatted.encode()
            for role, text in parsed(formatted):
                held["turns"] += 1
                held["all"].update(f"{role}\n{text}\n".encode())
            for at, n in zip(starts, sizes, strict=True):
                text = unescaped(raw[at : at + n].decode())
                held["loss_chars"] += len(text)
                held["loss"].update(text.encode())
            held["chars"] += len(formatted)
    if held is not None:
        yield closed()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from formatted pieces."""
    spark = prepare(formatted.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "shard", "piece")
    return rows.mapInArrow(digests, DIGEST)


_RESTS_SQL = "|".join(x for r in _RESTS.values() for x in r).replace("'", "''")
#: The digests of ``conversations`` and a conversation -7 as DuckDB SQL.
SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, {len(START) + len(END) + 2} + length(role) + length(regexp_replace(text, '([<\[])(\\*)({_RESTS_SQL})', '\1\2\\\3', 'g')) as n from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars
from e group by conv_id
"""
