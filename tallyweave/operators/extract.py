"""Extraction of labelled amounts from ordered lines by rule lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from .merging import carried

PICKERS = {"last": A.last_amount, "largest": A.largest_amount, "only": A.only_amount}


class LineRule(NamedTuple):
    """A field's caption on a line, what rules a line out, and which of its amounts counts."""

    field: str
    caption: str
    confidence: int
    pick: str = "last"
    exclude: str = r"^\b$"
    line_no: str | None = None


def line_hits(lines: DataFrame, rules: Sequence[LineRule], keys: Sequence[str], line: str = "line", line_no: str = "line_no") -> DataFrame:
    """(keys, line_no, field_id, value, confidence, evidence): every rule's amount on every line it fits.

    A line without amounts takes those of the next line.  The rules are
    literals of one projection, so a line is tokenised once for all of them.
    """
    w = Window.partitionBy(*keys).orderBy(line_no)
    own, after = A.substantial_tokens(F.col(line)), A.substantial_tokens(F.lead(line).over(w))
    rows = lines.withColumn("__own", own).withColumn("__t", F.when(F.size("__own") > 0, F.col("__own")).otherwise(F.coalesce(after, F.array().cast("array<bigint>"))))
    c = F.lower(F.col(line))

    def hit(r: LineRule) -> Column:
        fits = c.rlike(r.caption) & ~c.rlike(r.exclude)
        if r.line_no:
            fits = fits & F.substring(c, 1, 35).rlike(rf"(^|[\s|]){r.line_no}([\s.|)]|$)")
        value = PICKERS[r.pick](F.col("__t"))
        return F.when(fits & value.isNotNull(), F.struct(F.lit(r.field).alias("field_id"), value.alias("value"), F.lit(r.confidence).alias("confidence")))

    hits = F.array_compact(F.array(*[hit(r) for r in rules]))
    return rows.select(*keys, line_no, F.substring(F.col(line), 1, 220).alias("evidence"), F.explode(hits).alias("h")).select(*keys, line_no, "h.*", "evidence")


def islands(lines: DataFrame, keys: Sequence[str], order: str, header: Column, terminator: Column) -> DataFrame:
    """Rows inside blocks, with ``block``: a block opens at a header and closes at its first terminator."""
    w = Window.partitionBy(*keys).orderBy(order)
    opened = lines.withColumn("block", F.sum(header.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__end", terminator & ~header).where("block > 0")
    inside = Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return opened.withColumn("__closed", F.coalesce(F.max(F.col("__end").cast("int")).over(inside), F.lit(0))).where("__closed = 0").drop("__closed")


def block_totals(lines: DataFrame, keys: Sequence[str], order: str, header: Column, terminator: Column, amount: str) -> DataFrame:
    """(keys, block, n, amount, printed): the lines of each block summed, and the total it prints."""
    rows = islands(lines, keys, order, header, terminator)
    body = ~F.col("__end")
    return rows.groupBy(*keys, "block").agg(F.count(F.when(body, F.col(amount))).alias("n"), F.coalesce(F.sum(F.when(body, F.col(amount))), F.lit(0)).alias("amount"), F.max(F.when(~body, F.col(amount))).alias("printed"))


def carried_captions(lines: DataFrame, keys: Sequence[str], order: str, line: str = "line") -> DataFrame:
    """Amount lines with the caption that applies: their own, or the last one before without amounts."""
    tokens = A.substantial_tokens(F.col(line))
    caption = F.trim(F.regexp_replace(F.regexp_replace(F.col(line), A.RUN, " "), r"[\s$|.\-]+", " "))
    rows = lines.withColumn("amounts", tokens).withColumn("__own", F.when(F.length(caption) >= 3, caption))
    return carried(rows, keys, [order], "__own", "caption").where((F.size("amounts") > 0) & F.col("caption").isNotNull()).drop("__own")


def triplets(lines: DataFrame, keys: Sequence[str], order: str, numeric: Column) -> DataFrame:
    """Captions followed by three numeric lines, matches not overlapping: (keys, order, v1, v2, v3 of the lines).

    A start has three numeric lines after it; of starts that follow each other
    every fourth counts, which is what a scan that skips its match would take.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = lines.withColumn("__num", numeric)
    ahead = [F.coalesce(F.lead("__num", i).over(w), F.lit(False)) for i in (1, 2, 3)]
    rows = rows.withColumn("__n", F.row_number().over(w)).withColumns({f"v{i}": F.lead("line", i).over(w) for i in (1, 2, 3)}).withColumn("__start", reduce(lambda a, b: a & b, ahead))
    starts = rows.where("__start")
    run = Window.partitionBy(*keys).orderBy("__n")
    starts = starts.withColumn("__new", F.coalesce((F.col("__n") - F.lag("__n").over(run) > 1).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(run))
    place = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy("__n"))
    return starts.withColumn("__p", place).where("(__p - 1) % 4 = 0").drop("__num", "__n", "__start", "__new", "__run", "__p")
