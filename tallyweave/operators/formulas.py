"""Formula graphs over wide rows, identities and common sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Formula(NamedTuple):
    """``name`` = signed sum of terms; null unless ``least`` of ``present`` are there."""

    name: str
    plus: tuple[str, ...]
    minus: tuple[str, ...] = ()
    present: tuple[str, ...] = ()
    least: int = 1
    absolute: tuple[str, ...] = ()


# The expense rows that are summed.
SLOTS = ("officer_compensation", "salaries_wages", "advertising", "rent", "taxes_licenses", "bank_credit_card", "professional_fees", "utilities")

# The sheet's computed rows, in the order in which they depend on each other.
WORKBOOK = (
    Formula("gross_profit", ("sales",), ("cogs",)),
    Formula("depreciation_amortization", ("depreciation", "amortization")),
    Formula("overhead_sga", SLOTS),
    Formula("operating_profit", ("gross_profit", "other_operating_income"), ("depreciation_amortization", "overhead_sga", "other_operating_expenses")),
    Formula("net_profit_before_taxes", ("operating_profit", "other_income"), ("interest_expense", "other_expenses")),
    Formula("adjusted_net_profit_before_taxes", ("net_profit_before_taxes", "adjusted_owner_compensation")),
    Formula("net_income", ("adjusted_net_profit_before_taxes", "extraordinary_gain"), ("taxes_paid", "extraordinary_loss")),
    Formula("total_current_assets", ("cash", "accounts_receivable", "inventory", "other_current_assets")),
    Formula("net_fixed_assets", ("gross_fixed_assets",), ("accumulated_depreciation",), absolute=("accumulated_depreciation",)),
    Formula("net_intangible_assets", ("gross_intangible_assets",), ("accumulated_amortization",), absolute=("accumulated_amortization",)),
    Formula("total_assets", ("total_current_assets", "net_fixed_assets", "net_intangible_assets", "other_assets"), present=("total_current_assets", "net_fixed_assets")),
    Formula("total_current_liabilities", ("accounts_payable", "short_term_debt", "current_portion_ltd", "other_current_liabilities")),
    Formula("long_term_liabilities", ("notes_minus_short_term", "subordinated", "other_long_term_liabilities")),
    Formula("total_liabilities", ("total_current_liabilities", "long_term_liabilities")),
    Formula("total_equity", ("preferred_stock", "common_stock", "additional_paid_in_capital", "other_stock_equity", "unclassified_equity")),
    Formula("total_liabilities_equity", ("total_liabilities", "total_equity")),
)


def evaluated(df: DataFrame, formulas: Sequence[Formula] = WORKBOOK) -> DataFrame:
    """``df`` with every formula's column; inputs that it lacks count as missing.

    A missing term counts as 0, but a formula none of whose inputs is there
    (or fewer than its ``least``) stays missing.  It only projects, so Spark
    runs the whole graph in one stage.
    """
    names = [f.name for f in formulas]
    inputs = {t for f in formulas for t in (*f.plus, *f.minus)} - set(names)
    out = df.drop(*names).withColumns({c: F.lit(None).cast("long") for c in sorted(inputs - set(df.columns))})
    for f in formulas:
        term = lambda c, f=f: F.coalesce(F.abs(F.col(c)) if c in f.absolute else F.col(c), F.lit(0))
        total = sum((term(c) for c in f.plus), F.lit(0)) - sum((term(c) for c in f.minus), F.lit(0))
        there = sum((F.col(c).isNotNull().cast("int") for c in (f.present or (*f.plus, *f.minus))), F.lit(0))
        out = out.withColumn(f.name, F.when(there >= f.least, total))
    return out


def wide(cells: DataFrame, keys: Sequence[str], fields: Sequence[str], field: str = "field_id", value: str = "value") -> DataFrame:
    """One row for each key, one column for each field, in one aggregation."""
    return cells.groupBy(*keys).agg(*[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])


def long(df: DataFrame, keys: Sequence[str], fields: Sequence[str], field: str = "field_id", value: str = "value") -> DataFrame:
    """(keys, field, value) of the fields that are there."""
    return df.unpivot(list(keys), list(fields), field, value).where(F.col(value).isNotNull())


def closure(left: Column, right: Column, tolerance: float = 1) -> Column:
    """``closes``, ``open`` or ``unknown`` where a side is missing."""
    return F.when(left.isNull() | right.isNull(), "unknown").when(F.abs(left - right) <= tolerance, "closes").otherwise("open")


def audited(df: DataFrame, formulas: Sequence[Formula] = WORKBOOK, tolerance: float = 1) -> DataFrame:
    """``df`` with ``mismatches``: the formulas whose stored value is not what its inputs give."""
    again = {f.name: f"{f.name}__again" for f in formulas}
    stored = df.withColumns({v: F.col(k) for k, v in again.items() if k in df.columns})
    checked = evaluated(stored, formulas)
    wrong = F.array_compact(F.array(*[F.when(closure(F.col(n), F.col(a), tolerance) == "open", F.lit(n)) for n, a in again.items() if n in df.columns]))
    return checked.withColumn("mismatches", wrong).withColumns({n: F.col(a) for n, a in again.items() if n in df.columns}).drop(*again.values())


def solved_residual(df: DataFrame, into: str, total: str, parts: Sequence[str]) -> DataFrame:
    """Fill a missing part: total less the other parts, if all of them are there and it is not negative."""
    known = sum((F.col(p) for p in parts), F.lit(0))
    rest = F.col(total) - known
    return df.withColumn(into, F.coalesce(F.col(into), F.when(rest >= 0, rest)))


def common_size(df: DataFrame, parts: Sequence[str], base: str, digits: int = 6) -> DataFrame:
    """Each part as a share of the base; null where the base is 0 or missing."""
    return df.withColumns({f"{p}_share": F.round(F.col(p) / F.nullif(F.col(base), F.lit(0)), digits) for p in parts})


def ratios(df: DataFrame, specs: Mapping[str, tuple[str, str]], digits: int = 4) -> DataFrame:
    """Named ratios (numerator, denominator)."""
    return df.withColumns({n: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), digits) for n, (a, b) in specs.items()})


def displayed(df: DataFrame, overrides: Mapping[str, str], baselines: Mapping[str, str] | None = None, formulas: Sequence[Formula] = WORKBOOK) -> DataFrame:
    """``df`` evaluated, with a user's ``overrides`` (formula: column) on top and ``hints`` on what they hide.

    A formula whose override or parsed baseline (formula: column) is off by
    more than a dollar says what it expects.
    """
    out = evaluated(df, formulas)
    off = lambda a, b: F.abs(a - b) > 1
    expects = [F.when(off(F.col(o), F.col(f)), F.format_string(f"{f}: Formula expects %d", F.col(f))) for f, o in overrides.items()]
    parsed = [F.when(off(F.col(f), F.col(b)), F.format_string(f"{f}: From extraction %d", F.col(b))) for f, b in (baselines or {}).items()]
    hints = F.array_compact(F.array(*expects, *parsed)) if expects or parsed else F.array().cast("array<string>")
    return out.withColumn("hints", hints).withColumns({f: F.coalesce(F.col(o), F.col(f)) for f, o in overrides.items()})


def identity_warnings(df: DataFrame, ordinary_income: str, gross_profit: str, formulas: Sequence[Formula] = WORKBOOK) -> DataFrame:
    """``df`` evaluated, with ``warnings``: where the sheet's profits are not what the form says.

    Without taxes, extraordinary items and owner's compensation the net income
    has to be the form's income too.
    """
    out = evaluated(df, formulas)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in out.columns else F.lit(0)
    say = lambda text, *cs: F.format_string(text, *[F.format_number(c, 0) for c in cs])
    income, form_profit = F.col(ordinary_income), F.col(gross_profit)
    before, net, profit = F.col("net_profit_before_taxes"), F.col("net_income"), F.col("gross_profit")
    open_before = F.coalesce(before != income, F.lit(False))
    plain = (n("taxes_paid") == 0) & (n("extraordinary_gain") - n("extraordinary_loss") + n("adjusted_owner_compensation") == 0)
    slots = sum((n(c) for c in SLOTS), F.lit(0))
    warnings = F.array_compact(F.array(
        F.when(form_profit != profit, say("Gross profit mismatch: form %s vs sales−COGS %s", form_profit, profit)),
        F.when(open_before, say("P&L does not close to Form ordinary income (workbook NPBT %s vs form %s, gap %s; top-8 sum %s, other_opex %s)", before, income, before - income, slots, n("other_operating_expenses"))),
        F.when(open_before & F.col("other_operating_expenses").isNotNull(), say("other_operating_expenses may be wrong (gap %s)", before - income)),
        F.when(~open_before & (net != income) & plain, say("Net income %s ≠ Form ordinary income %s (top-8 sum %s, other_opex %s)", net, income, slots, n("other_operating_expenses"))),
    ))
    return out.withColumn("warnings", warnings)
