"""The last pass over a client's years: a projection of what was read and what was edited.

State is a row for each (client, year, field): what the parser read
(``baseline``, ``baseline_confidence``, ``baseline_source``), which never
changes, what is shown (``value``, ``confidence``, ``source``) and whether a
user has set it (``edited``).  Each run starts from the baseline and the edits
and never from an earlier result, so running it again changes nothing.

State is dealt by sheet, lines and totals by client; inputs that are dealt so
(``spread``) move once, and what is read from them, which does not depend on
state, once more to the sheets: it is the same in every run, so that a second
one takes that of the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import pool, ranking, trust, verify
from .dealing import spread

# Fields that another year's worksheet never fills, what such a read is worth, and where it gives way.
OWN_YEAR = ("depreciation", "amortization", "other_income", "other_operating_income")
FILLED, GIVES_WAY, WEAK = 88, 85, r"(?i)OCR label|fuzzy|label match"
# The eight rows of expenses, what they and the rest are worth.
SLOTS = ("officer_compensation", "salaries_wages", "advertising", "rent", "taxes_licenses", "bank_credit_card", "professional_fees", "utilities")
SLOT_CONFIDENCE, REST = 90, "other_operating_expenses"
STATE = ("baseline", "baseline_confidence", "baseline_source", "value", "confidence", "source", "edited")


def restored(state: DataFrame) -> DataFrame:
    """State with what is shown set back to the parser's read, but for edited rows."""
    edited = F.coalesce("edited", F.lit(False))
    return state.withColumns({c: F.when(edited, F.col(c)).otherwise(F.col(b)) for c, b in (("value", "baseline"), ("confidence", "baseline_confidence"), ("source", "baseline_source"))})


def merged(state: DataFrame, reads: DataFrame, keys: Sequence[str], take, sheet: Sequence[str] = ()) -> DataFrame:
    """State with reads (keys, new_value, new_confidence, new_source) where ``take(state's row)`` says so; rows that were not there come in.

    With ``sheet`` only into sheets that state has.  Reads are one for each
    key, and none without one meets a row of state.  Both lie in one table and
    windows bring them together, so what was dealt by sheet stays there.
    """
    new = ("new_value", "new_confidence", "new_source")
    rows = state.select(*keys, *STATE, F.lit(True).alias("__own")).unionByName(reads.select(*keys, *new, F.lit(False).alias("__own")), allowMissingColumns=True)
    own = F.col("__own")
    apart = lambda columns: F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]), own)  # noqa: E731  unknown keys meet nothing
    rest = [k for k in keys if k not in sheet]
    rows = rows.withColumns({"__s": apart(sheet) if sheet else F.lit(None).cast("boolean"), "__k": apart(rest)})
    cell, of_sheet = Window.partitionBy(*sheet, "__s", *rest, "__k"), Window.partitionBy(*sheet, "__s")
    both = rows.withColumns({"__new": F.max(F.when(~own, F.struct(*new))).over(cell), "__met": F.max("__own").over(cell)})
    if sheet:
        both = both.withColumn("__there", F.max("__own").over(of_sheet)).where("__there")
    both = both.where(own | ~F.col("__met")).select(*keys, *STATE, "__new.*")
    use = F.coalesce(take & F.col("new_value").isNotNull() & ~F.coalesce("edited", F.lit(False)), F.lit(False))
    shown = {c: F.when(F.col("__use"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("value", "confidence", "source")}
    return both.withColumn("__use", use).withColumns(shown).withColumn("edited", F.coalesce("edited", F.lit(False))).select(*keys, *STATE)


def refilled(state: DataFrame, comparisons: DataFrame, client: Sequence[str], year: str) -> DataFrame:
    """Blank and weak values of years that are there, from the worksheet of a later one.

    ``comparisons`` is (client, year, prior_year, field_id, value).  Values
    that look like form numbers, years or crumbs fill nothing; of several
    worksheets the earliest counts.
    """
    source = F.concat(F.lit("Two-year comparison (from "), F.col(year).cast("string"), F.lit(" return)"))
    rows = comparisons.where(~F.col("field_id").isin(*OWN_YEAR) & F.col("value").isNotNull())
    rows = rows.where(~trust.suspicious(F.col("field_id"), F.col("value"), source, F.col("prior_year"))).select(*client, year, "prior_year", "field_id", "value")
    first = ranking.best(spread(rows, *client, "prior_year"), [*client, "prior_year", "field_id"], [F.asc(year), F.asc("value")])
    reads = first.select(*client, F.col("prior_year").alias(year), "field_id", F.col("value").alias("new_value"), F.lit(FILLED).alias("new_confidence"), source.alias("new_source"))
    weak = (F.coalesce("source", F.lit("")) == "") | F.col("source").rlike(WEAK)
    return merged(state, reads, [*client, year, "field_id"], F.col("value").isNull() | (weak & (F.coalesce("confidence", F.lit(0)) < GIVES_WAY)), [*client, year])


def aligned(state: DataFrame, lines: DataFrame, totals: DataFrame, client: Sequence[str], year: str) -> DataFrame:
    """The eight expense rows hold the same labels in all years of a client, by their sums, and the rest what is left.

    ``lines`` is the pool (client, year, label, amount, source), ``totals``
    (client, year, total) the printed totals.  A label that a year lacks is 0.
    A client's eight labels are put beside its sums by one join on the client.
    """
    sheet = [*client, year]
    cells = lines.groupBy(*sheet, "label").agg(F.sum("amount").alias("amount"))
    sums = cells.groupBy(*client, "label").agg(F.sum("amount").alias("__sum"))
    top = ranking.best(sums, client, [F.desc("__sum"), F.asc("label")], len(SLOTS), "place").groupBy(*client).agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("__top"))
    held = lambda n: F.max(F.when(F.col(year).isNotNull() & (F.get("__top", F.lit(n))["label"] == F.col("label")), F.col("amount")))
    wide = cells.join(top, list(client)).groupBy(*sheet).agg(F.max(F.size("__top")).alias("__n"), *[held(n).alias(f"__{n}") for n in range(len(SLOTS))])
    seat = lambda n: F.when(F.col("__n") > n, F.struct(F.lit(n + 1).alias("place"), F.coalesce(f"__{n}", F.lit(0)).alias("amount")))
    seats = lambda w: w.select(*sheet, F.inline(F.array_compact(F.array(*map(seat, range(len(SLOTS)))))))
    slot = F.get(F.array(*map(F.lit, SLOTS)), F.col("place") - 1)
    own = seats(spread(wide, *sheet)).select(*sheet, slot.alias("field_id"), F.col("amount").alias("new_value"), F.lit(SLOT_CONFIDENCE).alias("new_confidence"), F.concat(F.lit("Operating expenses (top-8 slot "), F.col("place").cast("string"), F.lit(")")).alias("new_source"))
    rest = spread(pool.partition_rest(lines, seats(wide).select(*sheet, "amount"), totals, sheet).select(*sheet, "rest", "source"), *sheet)
    left = rest.select(*sheet, F.lit(REST).alias("field_id"), F.col("rest").alias("new_value"), F.lit(FILLED).alias("new_confidence"), F.col("source").alias("new_source"))
    return merged(state, own.unionByName(left), [*sheet, "field_id"], F.lit(True))


def finalize(state: DataFrame, comparisons: DataFrame, lines: DataFrame, totals: DataFrame, client: Sequence[str] = ("client",), year: str = "year") -> DataFrame:
    """State after restoring, refilling, checking and aligning; running it on its own result gives the same.

    Suspicious values that no user has set are cleared after refilling, before
    the expense rows are aligned.
    """
    now = refilled(restored(state), comparisons, client, year)
    odd = F.col("value").isNotNull() & ~F.coalesce("edited", F.lit(False)) & F.coalesce(trust.suspicious(F.col("field_id"), F.col("value"), F.col("source"), F.col(year)), F.lit(False))
    now = now.withColumn("__odd", odd)
    now = now.withColumns({c: F.when(~F.col("__odd"), F.col(c)) for c in ("value", "confidence", "source")}).drop("__odd")
    return aligned(now, lines, totals, client, year)


def flagged(state: DataFrame, client: Sequence[str] = ("client",), year: str = "year") -> DataFrame:
    """Finalized state with the flags of large changes between years."""
    return verify.change_flags(state, [*client, "field_id"], year, "value")
