"""Winners, top lists and residuals within groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups of up to so many rows are added side by side.
SHORT = 64


def best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key.  ``order`` must end in something unique.

    Spark limits each group before the shuffle, so a hot key sends ``n`` rows
    from every task and not all of its rows.
    """
    at = rank or "__rank"
    out = df.withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(at) <= n)
    return out if rank else out.drop(at)


def deduped(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in ``order``."""
    return best(df, keys, order)


def top_distinct(df: DataFrame, keys: Sequence[str], amount: str, n: int, largest: bool = True) -> DataFrame:
    """(keys, amount, rank): the ``n`` largest different amounts of each key."""
    each = df.select(*keys, amount).where(F.col(amount).isNotNull()).distinct()
    return best(each, keys, [F.desc(amount) if largest else F.asc(amount)], n, "rank")


def runner_up(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """(keys, value, other): the winner, and the first row in order with another value, if any.

    The first row of each value, then the first two of those: both limits work
    before the shuffle, so no key's rows are sorted in one task.
    """
    two = best(best(df, [*keys, value], order), keys, order, 2, "__place")
    at = lambda n: F.max(F.when(F.col("__place") == n, F.col(value)))
    return two.groupBy(*keys).agg(at(1).alias(value), at(2).alias("other"))


def shared_top(df: DataFrame, label: str, period: str, amount: str, n: int, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, period, label, amount): the same ``n`` labels in every period, and the rest as ``other``.

    Labels are ranked by their sum over all periods.  A label that a period
    lacks has 0 there.  The data is aggregated once; everything after that
    works on one row for each label and period.
    """
    cells = df.groupBy(*scope, period, label).agg(F.sum(amount).alias("amount"))
    totals = cells.groupBy(*scope, label).agg(F.sum("amount").alias("total"))
    w = Window.partitionBy(*scope).orderBy(F.desc("total"), F.asc(label)) if scope else Window.orderBy(F.desc("total"), F.asc(label))
    winners = totals.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(*scope, label)
    periods = cells.select(*scope, period).distinct()
    grid = periods.join(winners, list(scope)) if scope else periods.join(F.broadcast(winners))
    shown = grid.join(cells, [*scope, period, label], "left").select(*scope, period, F.col(label).cast("string").alias("label"), F.coalesce("amount", F.lit(0)).alias("amount"))
    rest = cells.join(winners, [*scope, label], "left_anti").groupBy(*scope, period).agg(F.sum("amount").alias("amount"))
    other = periods.join(rest, [*scope, period], "left").select(*scope, period, F.lit("other").alias("label"), F.coalesce("amount", F.lit(0)).alias("amount"))
    return shown.unionByName(other)


def residual(df: DataFrame, keys: Sequence[str], amount: str, chosen: Column) -> DataFrame:
    """(keys, total, chosen, residual): what the chosen rows leave of each total, never below 0."""
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("total"), F.coalesce(F.sum(F.when(chosen, F.col(amount))), F.lit(0)).alias("chosen"))
    return sums.withColumn("residual", F.greatest(F.lit(0), F.col("total") - F.col("chosen")))


def skipping_sum(amounts: np.ndarray, room: int) -> tuple[int, int]:
    """(sum, number) of the amounts that fit into what is left, one after the other; one that does not is skipped."""
    taken = used = 0
    if (amounts < 0).any():
        for v in amounts.tolist():
            if taken + v <= room:
                taken, used = taken + v, used + 1
        return taken, used
    left = amounts
    while len(left := left[left <= room - taken]):  # what is larger than the room never fits again
        sums = np.cumsum(left)
        n = int(np.searchsorted(sums, room - taken, side="right"))
        taken, used, left = taken + int(sums[n - 1]), used + n, left[n:]
    return taken, used


def capped_groups(amounts: np.ndarray, there: np.ndarray, starts: np.ndarray, cap: int, first: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sums, numbers) of ``skipping_sum`` for each group of amounts; the first group starts from ``first``.

    Short groups are added place by place, all of them at once.
    """
    n = np.diff(starts, append=len(amounts))
    sums, used = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    sums[0], used[0] = first
    for g in np.flatnonzero(n > SHORT):
        part = slice(starts[g], starts[g] + n[g])
        taken, more = skipping_sum(amounts[part][there[part]], cap - int(sums[g]))
        sums[g], used[g] = sums[g] + taken, used[g] + more
    live = np.flatnonzero(n <= SHORT)
    for place in range(SHORT):
        live = live[n[live] > place]
        if not len(live):
            break
        at = starts[live] + place
        fits = live[there[at] & (amounts[at] <= cap - sums[live])]
        sums[fits] += amounts[starts[fits] + place]
        used[fits] += 1
    return sums, used


def capped_sum(df: DataFrame, keys: Sequence[str], amount: str, order: Sequence[str], cap: int) -> DataFrame:
    """(keys, claimed, used): rows in order are added while the sum stays within ``cap``; one that would exceed it is skipped.

    Which rows count depends on those before them, so a key's rows are read in
    order by one task, as a stream: what is kept of them is the sum so far,
    whatever their number.  Null amounts are skipped.  The keys that end in a
    batch of rows go out as one batch.
    """
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("claimed", T.LongType()), T.StructField("used", T.LongType())])
    n = len(keys)
    tag = F.xxhash64(*[F.col(k).cast("string") for k in keys], *[F.col(k).isNull() for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        claimed = used = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(open_key, types, strict=True)] + [pa.array([claimed], pa.int64()), pa.array([used], pa.int64())], [*keys, "claimed", "used"])

        for b in batches:
            if not b.num_rows:
                continue
            types = [b.column(i).type for i in range(n)]
            new = np.zeros(b.num_rows, dtype=bool)
            for c in b.columns[: n + 1]:
                new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
                new[1:] |= pc.not_equal(c[1:].is_null(), c[:-1].is_null()).to_numpy(zero_copy_only=False)
            amounts = b.column(n + 1)
            there = amounts.is_valid().to_numpy(zero_copy_only=False)
            values = pc.fill_null(amounts, 0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(new)])
            at = lambda i: tuple(b.column(j)[i].as_py() for j in range(n))
            continued = open_key is not None and at(0) == open_key
            if open_key is not None and not continued:
                yield row()
            first = (claimed, used) if continued else (0, 0)
            sums, counts = capped_groups(values, there, starts, cap, first)
            # the last key may go on in the next batch
            if len(starts) > 1:
                yield pa.RecordBatch.from_arrays([*[b.column(j).take(pa.array(starts[:-1])) for j in range(n)], pa.array(sums[:-1]), pa.array(counts[:-1])], [*keys, "claimed", "used"])
            open_key, claimed, used = at(int(starts[-1])), int(sums[-1]), int(counts[-1])
        if open_key is not None:
            yield row()

    rows = df.select(*keys, tag.alias("__tag"), F.col(amount).cast("long").alias("__amount"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    rows = rows.repartition("__tag").sortWithinPartitions("__tag", *keys, *[f"__o{i}" for i in range(len(order))], "__amount")
    return rows.select(*keys, "__tag", "__amount").mapInArrow(run, schema)


def max_then_sum(df: DataFrame, outer: Sequence[str], inner: Sequence[str], amount: str) -> DataFrame:
    """(outer, amount): the largest amount of each inner key, summed."""
    return df.groupBy(*outer, *inner).agg(F.max(amount).alias("m")).groupBy(*outer).agg(F.sum("m").alias("amount"))
