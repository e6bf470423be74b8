"""Two-year worksheets, year inference, and values held against the other cells of their sheet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from . import trust
from .dealing import known
from .extract import islands
from .ranking import best

# Phrases that name a return's year, in order, and the words that make the latest year count.
YEAR_PHRASES = (
    r"(?i)(?:tax\s+year|calendar\s+year|for\s+(?:the\s+)?calendar\s+year|taxable\s+year)\s*[:\s.-]+\s*(20\d{2})\b",
    r"(?i)(?:year\s+ended|ending|ended)\s+(?:[a-z]{3,9}\.?\s+\d{1,2},?\s+)?(20\d{2})\b",
    r"(?i)\b(?:dec|december)\.?\s+\d{1,2},?\s+(20\d{2})\b",
    r"(?i)\bform\s+1120[^0-9]{0,48}(20\d{2})\b",
    r"(?i)\breturn\s+summary[^0-9]{0,120}(20\d{2})\b",
    r"(?i)\b(20\d{2})\s+(?:tax\s+return|u\.?s\.?\s+return)\b",
)
YEAR_PAIR = r"\b(20\d{2})\s*[\&\-–]\s*(20\d{2})\b"
SIDE_BY_SIDE = r"(?i)comparison|two\s*year|worksheet"
# Balance-sheet amounts that are mistaken for the year's expense.
BALANCE_TRAPS = {"depreciation": ("accumulated_depreciation", "gross_fixed_assets"), "amortization": ("accumulated_amortization", "gross_intangible_assets"), "common_stock": ("unclassified_equity", "other_stock_equity"), "preferred_stock": ("unclassified_equity",)}
WEAK_ONLY = ("common_stock", "preferred_stock")


def tax_year(text: Column, file_name: Column) -> Column:
    """The year a return is for: a phrase, a pair's later year, the most frequent year (the latest of a worksheet), the file's."""
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    phrases = [number(F.regexp_extract(text, p, 1)) for p in YEAR_PHRASES]
    pair = F.greatest(number(F.regexp_extract(text, YEAR_PAIR, 1)), number(F.regexp_extract(text, YEAR_PAIR, 2)))
    years = F.transform(A.all_of(text, r"\b20\d{2}\b"), lambda y: y.cast("int"))
    counted = F.transform(F.array_distinct(years), lambda y: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), y.alias("y")))
    most = F.when(text.rlike(SIDE_BY_SIDE), F.array_max(years)).otherwise(F.array_max(counted)["y"])
    named = F.array_max(F.transform(A.all_of(file_name, r"(20\d{2})", 1), lambda y: y.cast("int")))
    return F.coalesce(*phrases, pair, most, named)


def year_column(left: Column, right: Column, target: Column) -> Column:
    """Which of two year columns (0 or 1) is the target's, or else the nearer one; the left one of equals."""
    nearer = F.abs(target - left) <= F.abs(target - right)
    return F.when(target == left, 0).when(target == right, 1).when(target < F.least(left, right), 0).when(target > F.greatest(left, right), 1).otherwise(F.when(nearer, 0).otherwise(1))


def year_columns(tokens: Column) -> Column:
    """The two year amounts of a worksheet row, without a column of changes or totals; one amount stands for both."""

    def of(t: Column) -> Column:
        n = F.size(t)
        at = lambda i: F.get(t, n - i)
        a, b, c = at(3), at(2), at(1)
        extra = (n >= 3) & ((F.abs(F.abs(a - b) - F.abs(c)) <= 1) | (F.abs(F.abs(b) - F.abs(a) - F.abs(c)) <= 1) | (F.abs(F.abs(c) - F.abs(a) - F.abs(b)) <= 1))
        # With more than two left over the earlier two of the last three count.
        two = F.when(F.coalesce(extra, F.lit(False)), F.when(n >= 4, F.array(at(4), a)).otherwise(F.array(a, b))).otherwise(F.when(n >= 3, F.array(a, b)).otherwise(F.array(b, c)))
        return F.when(n >= 2, two).when(n == 1, F.array(c, c))

    return A.let(tokens, of)


def blank_current(line: Column) -> Column:
    """A row of one year's amount and its negative as the change: the current year's cell is blank."""
    run = r"((?:(?<![\d.])-\s*)?)(\d{1,3}(?:,\d{3})+(?:\.\d{2})?)"
    both = F.arrays_zip(A.all_of(line, run, 1).alias("sign"), A.all_of(line, run, 2).alias("run"))
    return A.let(both, lambda x: (F.size(x) == 2) & (F.get(x, 0)["run"] == F.get(x, 1)["run"]) & (F.trim(F.get(x, 0)["sign"]) == "") & (F.trim(F.get(x, 1)["sign"]) == "-"))


def comparison_amount(line: Column, column: Column) -> Column:
    """The amount of a worksheet row in a year's column (0 or 1); none in a blank current cell."""
    blank = (column == 1) & F.contains(line, F.lit("-")) & F.coalesce(blank_current(line), F.lit(False))
    return F.when(~blank, F.get(year_columns(A.keepable_tokens(line)), column))


def section_ratios(lines: DataFrame, keys: Sequence[str], order: str, header: Column, terminator: Column, column: int, line: str = "line") -> DataFrame:
    """(keys, label, ratio): one column of the percentages of the rows inside a section; a label counts once, the first row of it."""
    rows = islands(lines, keys, order, header, terminator).where(~F.col("__end"))
    ratios = A.percents(F.col(line))
    label = F.trim(F.regexp_replace(F.regexp_extract(F.col(line), r"^(.*?)(?:\d+(?:\.\d+)?\s*%|--)", 1), r"^\(\d+\)\s*|\s*\(\d+\)\s*$", ""))
    found = rows.select(*keys, order, label.alias("label"), ratios.alias("r")).where((F.size("r") >= 2) & F.length("label").between(1, 100)).select(*keys, order, "label", F.get("r", F.lit(column)).alias("ratio"))
    return best(found.where("ratio is not null"), [*keys, "label"], [F.asc(order)]).drop(order)


def cross_referenced(candidates: DataFrame, keys: Sequence[str], traps: str = "traps", no_asset: Column | None = None) -> DataFrame:
    """The read of a year's depreciation or amortization: candidates are (keys, value, source, family, confidence, ord, traps).

    A candidate that equals a balance-sheet amount in ``traps`` is none.  The
    form comes first (its net line before others), then form 4562, statements
    and comparisons.  Without the asset (``no_asset``) only a zero counts.
    """
    value, fam = F.col("value"), F.col("family")
    size = F.abs(value)
    crumb = (fam == "comparison") & (size.between(2020, 2035) | size.isin(1986, 1987))
    ok = ((value == 0) | A.is_reasonable(value)) & ~F.coalesce(F.array_contains(F.col(traps), value), F.lit(False)) & ~crumb
    if no_asset is not None:
        ok = ok & (~F.coalesce(no_asset, F.lit(False)) | (value == 0))
    place = F.when((fam == "form") & F.col("source").rlike(r"(?i)NET\s+DEPRECIATION"), 0).when(fam == "form", 1).when(fam == "form4562", 2).when(fam == "statement", 3).otherwise(4)
    same = candidates.where(ok & (place == 4)).groupBy(*keys, "value").agg((F.count("*") > 1).alias("agreed"))
    rows = candidates.where(ok).withColumn("place", place).join(same, [*keys, "value"], "left")
    agreed = F.coalesce(F.col("agreed"), F.lit(False)) & (F.col("place") == 4)
    return best(rows, keys, [F.asc("place"), F.desc(agreed), F.desc(F.when(agreed, F.col("confidence"))), F.asc("ord")]).select(*keys, "value", "source", "family")


def coherent(cells: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """Cells with ``cleared``: why a value cannot be what its field says, or null.

    Suspicious values, expenses that equal a balance-sheet amount, and weak
    reads of stock that repeat another equity amount.  The amounts of a sheet
    are put beside its few suspects by one window.
    """
    on = [*keys, year]
    rounded = A.whole(F.col("value").cast("double"))
    traps = sorted({o for others in BALANCE_TRAPS.values() for o in others})  # a few fields of each sheet
    trap = F.when(F.col("field_id").isin(*traps) & known(on), F.struct(F.col("field_id").alias("other"), rounded.alias("amount")))
    cells_beside = cells.withColumn("__traps", F.collect_set(trap).over(Window.partitionBy(*on)))
    among = reduce(lambda c, x: c.when(F.col("field_id") == x[0], F.array(*map(F.lit, x[1]))), BALANCE_TRAPS.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    odd = trust.suspicious(F.col("field_id"), F.col("value"), F.col("source"), F.col(year))
    weak = ~F.col("field_id").isin(*WEAK_ONLY) | (trust.is_weak(F.col("source")) & (F.col("value") > 0))
    repeats = F.coalesce(F.exists("__traps", lambda t: F.array_contains("__among", t["other"]) & (t["amount"] == F.col("__rounded"))), F.lit(False)) & weak
    reason = F.when(F.col("value").isNull(), F.lit(None).cast("string")).when(odd, "suspicious magnitude/source").when(repeats & F.col("field_id").isin(*WEAK_ONLY), "weak duplicate").when(repeats, "matched balance-sheet line")
    return cells_beside.withColumns({"__among": among, "__rounded": rounded}).withColumn("cleared", reason).drop("__traps", "__among", "__rounded")


def rolled_par(retained: Column, gap: Column, others: Sequence[str], nominal: Sequence[int] = (100, 500, 1000, 5000, 10000)) -> Column:
    """Retained earnings with the nominal stock that a balance sheet lacks: where all stock cells are empty and the gap is a par value."""
    empty = F.lit(True)
    for c in others:
        empty = empty & (F.coalesce(F.col(c), F.lit(0)) == 0)
    return F.when((retained > 0) & empty & gap.isin(*nominal), retained + gap).otherwise(retained)
