"""How far a resolved value can be trusted: its source, its size, other reads of it.

Cells are long rows (keys, field_id, value, confidence, source); snapshots are
the independent reads of each cell (keys, field_id, family, value, label).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions.gates import Text, gated as gate
from ..functions.labels import first_rule
from . import formulas
from .dealing import beside, known
from .verify import decided

# What the wording of a source says of it.
WEAK = r"(?i)OCR label match|fuzzy|label match"
AUTHORITATIVE = r"(?i)form 1120|schedule l|statement \d|stmt \d|two-year comparison|embedded schedule|page 1 block|P&L reverse math|ordinary income"
RESIDUAL = r"(?i)minus\s+slot|federal\s+table\s+minus|residual|summed detail|itemized closure|misc detail closes|stmt total|operating expenses \(stmt|sum\(all\)\s*[−\-]|top-8\)|includes form lines outside top-8"
NO_RESIDUAL = r"(?i)P&L reverse math|ordinary income|stmt total\s*[−\-]\s*stmt lines in top-8"
CLOSES = r"(?i)closes\s+stmt|detail\s+sum|misc\s+detail|summed\s+detail|residual.*closes|structural\s+closure"
SUBTRACTIVE = r"(?i)total\s+minus\s+util"
LINE_18 = r"(?i)statement\s*\(?\s*line\s*18\)?"
FAMILIES = (("structured", r"(?i)structured financial"), ("form", r"(?i)form 1120|page 1 block|NET\s+DEPRECIATION|depreciation report"), ("schedule-l", r"(?i)schedule l|embedded schedule"), ("comparison", r"(?i)comparison"), ("statement", r"(?i)statement|stmt \d"), ("ocr", WEAK))
# Families that check each other, and in which order they are preferred.
CROSS_CHECKS = ("form", "schedule-l", "comparison", "structured")
FAMILY_ORDER = ("form", "schedule-l", "comparison", "statement", "structured", "ocr", "other")
# Fields that are never a dollar or less, and fields that row numbers are mistaken for.
MATERIAL = ("sales", "cogs", "rent", "depreciation", "amortization", "officer_compensation", "salaries_wages", "advertising", "taxes_licenses", "gross_fixed_assets", "accumulated_depreciation", "accounts_receivable", "cash", "inventory", "notes_minus_short_term", "other_stock_equity")
TRAPS = ("amortization", "other_operating_expenses", "accounts_payable", "advertising", "bank_credit_card", "professional_fees", "utilities", "other_current_liabilities", "short_term_debt", "current_portion_ltd", "other_current_assets", "notes_minus_short_term", "other_stock_equity", "unclassified_equity")
# Cells that a balance sheet which does not balance puts in doubt.
BALANCE = ("cash", "accounts_receivable", "inventory", "other_current_assets", "gross_fixed_assets", "other_assets", "accounts_payable", "other_current_liabilities", "notes_minus_short_term", "common_stock", "other_stock_equity", "unclassified_equity")
# Caps of confidence.
CAP_SUSPICIOUS, CAP_RESIDUAL, CAP_ZERO, CAP_SUBTRACTIVE, CAP_SINGLE, CAP_HIGH, CAP_TRUSTED, CAP_AGREED = 42, 58, 68, 78, 85, 92, 95, 99
DEFAULT_CONFIDENCE, LEAST_CONFIDENCE = 70, 65
# What is said of odd values, and of profits that do not close.
ODD_VALUE = "Likely form line number or OCR noise — verify"
ODD_FIELDS = {"depreciation": "Value looks like OCR noise or form line number — verify", "amortization": "Value looks like balance-sheet line or OCR noise — verify"}
PROFITS, PROFIT_FLAG, OPEN_PROFIT = ("net_profit_before_taxes", "net_income", "operating_profit"), "math-warning — workbook total vs Form ordinary income", r"(?i)P&L does not close|Net income .+ ≠ Form ordinary"
#: Fields of a form at most.
MOST_FIELDS = 1000


def said(source: Column) -> Column:
    return F.coalesce(source, F.lit(""))


def is_weak(source: Column) -> Column:
    return said(source).rlike(WEAK)


def is_residual(source: Column) -> Column:
    """Derived by subtraction or summing, unless an identity proves it."""
    return ~said(source).rlike(NO_RESIDUAL) & said(source).rlike(RESIDUAL)


def is_authoritative(source: Column) -> Column:
    return ~is_residual(source) & said(source).rlike(AUTHORITATIVE)


def family(source: Column) -> Column:
    """The family of reads that a source belongs to."""
    return first_rule(said(source), FAMILIES, "other")


def facts_of(source: Column | Text) -> dict[str, Column]:
    """What a source's wording says, by name: to be projected once where several rules ask for it.

    Patterns are asked only of sources that hold a piece of them.
    """
    s = gate(source)
    residual = ~s.rlike(NO_RESIDUAL) & s.rlike(RESIDUAL)
    names = reduce(lambda c, r: c.when(s.rlike(r[1]), F.lit(r[0])), FAMILIES[1:], F.when(s.rlike(FAMILIES[0][1]), F.lit(FAMILIES[0][0]))).otherwise(F.lit("other"))
    return {
        "weak": s.rlike(WEAK), "residual": residual, "sure": ~residual & s.rlike(AUTHORITATIVE), "family": names, "closes": s.rlike(CLOSES), "subtractive": s.rlike(SUBTRACTIVE), "line18": s.rlike(LINE_18),
        "comparison": s.rlike("(?i)comparison"), "structured": s.rlike("(?i)structured financial"), "top8": s.rlike(r"(?i)^Operating expenses \(top-8"), "expenses": s.rlike(r"(?i)^Operating expenses \("), "coherence": s.rlike("(?i)^Coherence:"),
        "user": s.rlike("(?i)^user correction|user confirmed|user selected"), "inferred": s.rlike(r"(?i)verify|residual|post-verification|inferred"), "detail": s.rlike(r"(?i)closes\s+stmt|detail\s+sum|summed\s+detail|misc\s+detail"),
        **odd_facts(s),
    }


def odd_facts(s: Column | Text) -> dict[str, Column]:
    """What ``suspicious`` asks of a source's wording, besides whether it is weak or sure."""
    s = s if isinstance(s, Text) else Text(s, s)
    plain = s.text
    return {
        "row": F.nullif(F.regexp_extract(plain, r"(?i)\bline\s*(\d{1,3})\b", 1), F.lit("")).cast("long"),
        "of_interest": plain.rlike(r"(?i)^\s*\d{1,3}\s+interest|million|form\s*8990|163\s*\(\s*j\s*\)|section\s*163|business\s+interest\s+limitation"), "of_163": plain.rlike(r"(?i)(?:^|[^\d])163(?:[^\d]|$)|8990|limitation"),
        "line31": plain.rlike(r"(?i)form\s*1120\s*line\s*31"), "adjustment": plain.rlike(r"(?i)post[-\s]?1986|1986\s+depreciation\s+adjustment"), "schedule_l": plain.rlike(r"(?i)schedule\s*l"), "zero": plain.rlike(r"(?i)summary zero|multi-line") & ~plain.rlike(r"(?i)form 1120 line 10|comparison"),
    }


def with_facts(df: DataFrame, source: str = "source") -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a column for each of the source's facts, and those columns."""
    df = df.withColumn("__said", said(F.col(source))).withColumn("__low", F.lower("__said"))
    facts = facts_of(Text(F.col("__said"), F.col("__low")))
    return df.withColumns({f"__{k}": c for k, c in facts.items()}).drop("__said", "__low"), {k: F.col(f"__{k}") for k in facts}


def suspicious(field: Column, value: Column, source: Column, year: Column, facts: dict[str, Column] | None = None) -> Column:
    """Values that are more likely a form, year or row number, or a crumb, than dollars.

    Without ``facts`` inside ``let``: inlined into one generated method,
    several times over, the patterns are too long to be compiled.
    """
    if facts:
        return _suspicious(field, value, year, facts)
    given = F.struct(field.alias("field"), value.alias("value"), said(source).alias("source"), year.alias("year"), is_weak(source).alias("weak"), is_authoritative(source).alias("sure"))
    return A.let(given, lambda x: _suspicious(x["field"], x["value"], x["year"], {"weak": x["weak"], "sure": x["sure"], **odd_facts(x["source"])}))


def _suspicious(field: Column, value: Column, year: Column, says: dict[str, Column]) -> Column:
    size = F.abs(A.whole(value.cast("double")))
    crumb = lambda most: size.between(1, most)
    signs = [
        A.is_form_number(size),
        F.coalesce((size == year) | (size == year % 100) | (year.isNotNull() & size.between(2020, 2035)), F.lit(False)) & (year != 0),
        size == says["row"],
        field.isin("cogs", "rent", "sales", "depreciation") & crumb(99) & ~says["sure"],
        (field == "taxes_paid") & crumb(99) & says["line31"],
        (field == "interest_expense") & crumb(999) & ((size <= 50) | says["of_interest"] | ((size == 163) & says["of_163"])),
        field.isin("depreciation", "amortization") & (size.isin(1986, 1987) | says["adjustment"]),
        field.isin(*MATERIAL) & (size == 1),
        field.isin(*TRAPS) & crumb(99),
        field.isin("common_stock", "preferred_stock") & crumb(99) & ~says["schedule_l"],
        (field == "other_income") & (value == 0) & says["zero"],
        says["weak"] & (size <= 99),
    ]
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in signs])


def gated(cells: DataFrame, year: Column, thorough: Column | bool = False) -> DataFrame:
    """Cells with ``verdict`` (keep, cap or clear): suspicious values are cleared or lose their confidence.

    A cleared cell has neither value nor confidence.
    """
    field, value, source = F.col("field_id"), F.col("value"), F.col("source")
    size = F.abs(A.whole(value.cast("double")))
    thorough = thorough if isinstance(thorough, Column) else F.lit(thorough)
    odd, weak, sure = suspicious(field, value, source, year), is_weak(source), is_authoritative(source)
    assumed = (field == "other_income") & (value == 0) & said(source).rlike(r"(?i)summary zero")
    adjusted = field.isin("depreciation", "amortization") & (size.isin(1986, 1987) | said(source).rlike(r"(?i)post[-\s]?1986"))
    clear = odd & ((sure & (size <= 99)) | adjusted | ((field == "interest_expense") & (size <= 999)) | ((field == "accounts_payable") & (size <= 99) & ~sure))
    clear = clear | (thorough & (odd | weak) & ~sure)
    doubtful = odd | (weak & (F.abs(value) <= 1))
    verdict = F.when(value.isNull(), "keep").when(assumed, "assumed zero").when(~doubtful, "keep").when(clear, "clear").otherwise("cap")
    cap = F.when(F.col("verdict") == "cap", CAP_SUSPICIOUS).when(F.col("verdict") == "assumed zero", CAP_ZERO)
    out = cells.withColumn("verdict", verdict)
    lowered = F.when(F.col("verdict") != "clear", F.least(F.coalesce("confidence", F.lit(0)), cap))  # least() skips a missing cap
    return out.withColumn("confidence", F.when(F.col("verdict") == "keep", F.col("confidence")).otherwise(lowered)).withColumn("value", F.when(F.col("verdict") != "clear", value))


def refilled(cells: DataFrame, comparison: DataFrame, keys: Sequence[str], year: Column, protected: Sequence[str] = ("other_current_liabilities",)) -> DataFrame:
    """Missing, suspicious and weak cells take the comparison's value, unless that is suspicious itself.

    Positive comparison values never fill ``protected`` fields.
    """
    new = comparison.select(*keys, "field_id", F.col("value").alias("c_value"), F.col("confidence").alias("c_conf"))
    both = cells.join(new, [*keys, "field_id"], "full_outer")
    field, name = F.col("field_id"), F.lit("Two-year comparison (cross-reference refill)")
    usable = F.col("c_value").isNotNull() & ~suspicious(field, F.col("c_value"), F.lit("Two-year comparison"), year) & ~(field.isin(*protected) & (F.col("c_value") > 0))
    needs = F.col("value").isNull() | suspicious(field, F.col("value"), F.col("source"), year) | is_weak(F.col("source"))
    take = usable & needs
    return both.select(*keys, "field_id", F.when(take, A.whole(F.col("c_value").cast("double"))).otherwise(F.col("value")).alias("value"), F.when(take, F.coalesce("c_conf", F.lit(88))).otherwise(F.col("confidence")).alias("confidence"), F.when(take, name).otherwise(F.col("source")).alias("source"))


def distinct_snapshots(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One read of each family and whole value: the most confident."""
    rows = reads.withColumn("value", A.whole(F.col("value").cast("double"))).where("value is not null")
    pick = F.max_by(F.struct(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"), "label"), F.struct(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)), "label"))
    return rows.groupBy(*keys, "field_id", "family", "value").agg(pick.alias("p")).select(*keys, "field_id", "family", "value", "p.confidence", "p.label")


def agreement(cells: DataFrame, snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with how many families agree with each, and what other reads there are.

    Counts only: a cell's reads are never gathered, but for the text of those
    that differ (one for each family and value).
    """
    on = [*keys, "field_id"]
    s = snapshots.select(*on, F.col("family").alias("s_family"), F.col("value").alias("s_value"), F.col("label").alias("s_label"))
    rows = beside(s, cells.select(*on, A.whole(F.col("value").cast("double")).alias("chosen")).where("chosen is not null"), on).where("chosen is not null")
    same, credible, paired = F.col("s_value") == F.col("chosen"), F.col("s_family").isin(*CROSS_CHECKS), F.col("s_family").isin("form", "comparison")
    text = F.concat(F.col("s_family"), F.coalesce(F.concat(F.lit(" ("), F.nullif("s_label", F.lit("")), F.lit(")")), F.lit("")), F.lit(": "), F.format_number("s_value", 0))
    rank = F.array_position(F.array(*map(F.lit, FAMILY_ORDER)), F.col("s_family"))
    others = F.array_sort(F.collect_set(F.when(~same, F.struct(rank.alias("r"), F.col("s_value").alias("v"), text.alias("t")))))
    distinct = lambda c: F.size(F.collect_set(F.when(c, F.col("s_family")))).cast("long")  # noqa: E731  a handful of families
    counts = rows.groupBy(*on).agg(F.count("*").alias("reads"), distinct(same).alias("agree"), distinct(same & paired).alias("agree_paired"), F.count(F.when(paired, 1)).alias("paired"), distinct(same & credible).alias("agree_credible"), F.count(F.when(credible, 1)).alias("credible"), F.max((credible & ~same).cast("int")).alias("differ"), others.alias("others"))
    numbers = ["reads", "agree", "agree_paired", "paired", "agree_credible", "credible", "differ"]
    out = beside(cells, counts, on).fillna(0, numbers)
    material = (F.col("credible") >= 2) & (F.col("agree_credible") < 2) & (F.col("differ") == 1)
    return out.withColumn("material", material).withColumn("other_reads", F.when(F.size("others") > 0, F.concat(F.lit("Other reads: "), F.array_join(F.transform("others", lambda o: o["t"]), " · ")))).drop("others", "differ", "credible", "agree_credible")


def trusted_single(confidence: Column, f: dict[str, Column]) -> Column:
    return F.when(f["sure"], confidence >= LEAST_CONFIDENCE).otherwise((f["comparison"] & (confidence >= 84)) | f["structured"] | (f["top8"] & (confidence >= 70)) | (f["coherence"] & (confidence >= 80)))


def any_flag(flags: Column, pattern: str) -> Column:
    return F.exists(flags, lambda f: f.rlike(pattern))


def trust_tier(value: Column, confidence: Column, shown: Column, agree: Column, flags: Column, odd: Column, f: dict[str, Column]) -> Column:
    """The first of ten tiers that fits a cell, from empty to confirmed; ``odd`` says whether it is suspicious."""
    by = lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(F.lit(no))
    steps = [
        (value.isNull(), "empty"),
        (f["user"], "user-confirmed"),
        (any_flag(flags, r"(?i)exceeds sales|does not balance|structural-mismatch|formula-disagreement|high-confidence-no-closure|Subtractive formula"), "math-warning"),
        (any_flag(flags, r"(?i)Other reads|Sources disagree"), "moderate"),
        (odd, "low"),
        (any_flag(flags, r"(?i)verify manually|verify against|inferred from|residual"), by(confidence >= 80, "moderate", "low")),
        (f["residual"] | f["inferred"], by(shown >= 80, "moderate", "low")),
        (f["expenses"] & (confidence >= 70), by(shown >= 75, "single-good", "moderate")),
        (agree >= 2, "multi-source"),
        ((f["family"] == "ocr") | f["weak"], "ocr-only"),
        (confidence < LEAST_CONFIDENCE, "low"),
        (f["sure"], by(shown >= 80, "authoritative", "single-good")),
        (f["detail"] & (confidence >= 85), "single-good"),
        (f["comparison"] & trusted_single(confidence, f), "comparison"),
        (trusted_single(confidence, f), by(shown >= 70, "single-good", "moderate")),
    ]
    return reduce(lambda c, x: c.when(*x) if c is not None else F.when(*x), steps, None).otherwise(F.lit("moderate"))


def cross_field_flags(cells: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """(keys, field_id, flag): what the cells of one sheet say against each other."""
    needed = sorted({t for f in formulas.WORKBOOK for t in (*f.plus, *f.minus)} | set(BALANCE))
    wide = formulas.evaluated(formulas.wide(cells, [*keys, year], needed))
    c, whole = F.col, lambda n: A.whole(F.col(n).cast("double"))
    gap = c("total_assets") - c("total_liabilities_equity")
    off = F.format_string("Balance sheet does not balance (assets %s vs liabilities+equity %s, gap %s)", *[F.format_number(x, 0) for x in (c("total_assets"), c("total_liabilities_equity"), gap)])
    flag = lambda test, field, text: F.when(test, F.struct(F.lit(field).alias("field_id"), (text if isinstance(text, Column) else F.lit(text)).alias("flag")))
    exceeds, same_a = c("cogs") > c("sales"), whole("amortization") == whole("accumulated_amortization")
    same_d = (whole("depreciation") == whole("accumulated_depreciation")) & (c("gross_fixed_assets").isNull() | (whole("depreciation") == whole("gross_fixed_assets")))
    flags = [
        flag(exceeds, "sales", "COGS exceeds sales"),
        flag(exceeds, "cogs", "COGS exceeds sales"),
        *[flag((F.abs(gap) > 1) & c(f).isNotNull(), f, off) for f in BALANCE],
        flag(same_a, "amortization", "P&L amortization equals accumulated amortization — likely wrong field"),
        flag(same_d, "depreciation", "P&L depreciation equals accumulated depreciation — likely wrong field"),
    ]
    return wide.select(*keys, year, F.explode(F.array_compact(F.array(*flags))).alias("f")).select(*keys, year, "f.field_id", "f.flag")


def reconciled(cells: DataFrame, snapshots: DataFrame, keys: Sequence[str], fields: DataFrame, year: str = "year", warnings: DataFrame | None = None) -> DataFrame:
    """(keys, year, field_id, value, flags, status, confidence, agreement, tier) of every field of every sheet.

    ``fields`` lists the input fields, ``warnings`` has (keys, year, warning).
    A field without a value is ``missing``.  Cells and reads that were dealt by
    sheet stay as they lie.  Cells may have a
    column ``persisted``, an agreement found before, which counts where a cell
    has no reads.  Sheets whose profit does not close by a warning have rows
    of their profits too, without values, with the warning's flag and tier.
    """
    on = [*keys, year]
    closed = r"P&L does not close|other_operating_expenses may be wrong"
    # most fields of most sheets have no value: only those that have one are judged
    names, there = listed(fields), F.col("value").isNotNull() & known(on)
    persisted = F.col("persisted") if "persisted" in cells.columns else F.lit(0)
    read = F.struct("value", "confidence", "source", persisted.cast("long").alias("persisted"))
    rows = cells.where(there & F.col("field_id").isin(*names)).groupBy(*on, "field_id").agg(F.max(read).alias("c")).select(*on, "field_id", "c.*")
    missing = cells.groupBy(*on).agg(F.collect_set(F.when(there, F.col("field_id"))).alias("there"))
    missing = missing.select(*on, F.explode(F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), "there")).alias("field_id"), F.array().cast("array<string>").alias("flags"), F.lit("missing").alias("status"), F.lit("empty").alias("tier"))
    rows = agreement(rows, snapshots, on)
    across = cross_field_flags(cells, keys, year).groupBy(*on, "field_id").agg(F.array_sort(F.collect_set("flag")).alias("across"))
    rows = beside(rows, across, [*on, "field_id"])
    if warnings is not None:
        open_sheets = warnings.where(F.col("warning").rlike(f"(?i){closed}")).select(*on).distinct().withColumn("unclosed", F.lit(True))
        rows = rows.join(open_sheets, on, "left").withColumn("unclosed", F.coalesce("unclosed", F.lit(False)))
    else:
        rows = rows.withColumn("unclosed", F.lit(False))

    field, value, y = F.col("field_id"), F.col("value"), F.col(year)
    rows, f = with_facts(rows)
    conf, fam = F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)), f["family"]
    line18, closes, subtractive = f["line18"], f["closes"], f["subtractive"]
    rows = rows.withColumn("__odd", suspicious(field, value, F.col("source"), y, f)).withColumn("isolated", line18 & (F.col("agree_paired") == 0))
    isolated, material = F.col("isolated"), F.col("material")
    agree = F.when(F.col("reads") == 0, F.coalesce("persisted", F.lit(0))).when(isolated, F.col("agree_paired")).otherwise(F.col("agree"))
    single, residual, odd = ~line18 & trusted_single(conf, f), f["residual"], F.col("__odd")
    alone = F.when(agree < 2, decided([
        ("OCR label match only — no corroboration", (fam == "ocr") | f["weak"]),
        ("Subtractive formula — verify against detail lines", subtractive),
        ("Statement Line 18 — corroborating source disagrees", line18 & (F.col("reads") > 0) & material),
        ("Low-trust source — verify manually", ~residual & ~single & ~closes),
    ], ""))
    other = field == "other_operating_expenses"
    own = F.array(
        F.when(isolated, F.lit("low_trust_source")),
        F.nullif(alone, F.lit("")),
        F.when(other & subtractive & ~closes, F.lit("formula-disagreement — subtractive vs detail lines may diverge")),
        F.when(other & residual & F.col("unclosed"), F.lit("Residual opex — verify against statement detail")),
        F.when(other & F.col("unclosed"), F.lit("P&L does not close to Form ordinary income — verify other opex")),
        F.when(odd, F.lit(ODD_VALUE)),
        *[F.when(odd & (field == name), F.lit(text)) for name, text in ODD_FIELDS.items()],
        F.when(material, F.col("other_reads")),
    )
    flags = F.array_union(F.coalesce("across", F.array().cast("array<string>")), F.array_compact(own))
    high = F.when(conf >= 92, CAP_HIGH).otherwise(CAP_TRUSTED)
    cap = F.when(residual, CAP_RESIDUAL).when(isolated, CAP_SINGLE).when(agree >= 2, CAP_AGREED).when(material, CAP_SINGLE).when(single, high).when(closes, CAP_TRUSTED).when(subtractive, CAP_SUBTRACTIVE).otherwise(CAP_SINGLE)
    rows = rows.withColumn("flags", flags).withColumn("agreement", agree).withColumn("shown", F.least(conf, cap))
    hard = any_flag(F.col("flags"), r"(?i)exceeds sales|does not balance|structural-mismatch|formula-disagreement|high-confidence-no-closure")
    weakly = (agree < 2) & ~single & ~closes & ~((fam == "statement") & (conf >= 88) & ~subtractive & ~line18)
    review = hard | odd | material | (conf < LEAST_CONFIDENCE) | ((fam == "ocr") & (agree < 2)) | f["weak"] | isolated | weakly
    status = F.when(review, "review").otherwise("verified")
    tier = trust_tier(value, conf, F.col("shown"), F.col("agreement"), F.col("flags"), odd, f)
    out = rows.select(*on, "field_id", "value", F.array_sort("flags").alias("flags"), status.alias("status"), F.col("shown").alias("confidence"), "agreement", tier.alias("tier"))
    out = out.unionByName(missing, allowMissingColumns=True)
    return out if warnings is None else out.unionByName(profit_rows(warnings, on), allowMissingColumns=True)


def profit_rows(warnings: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the profits of sheets that do not close by a warning, flagged and with its tier."""
    open_sheets = warnings.where(F.col("warning").rlike(OPEN_PROFIT)).select(*on).distinct()
    return open_sheets.select(*on, F.explode(F.array(*map(F.lit, PROFITS))).alias("field_id"), F.array(F.lit(PROFIT_FLAG)).alias("flags"), F.lit("math-warning").alias("tier"))


def listed(fields: DataFrame) -> list[str]:
    """The names of a form's fields, which are a short list."""
    names = [r.field_id for r in fields.select("field_id").distinct().limit(MOST_FIELDS + 1).collect()]
    if len(names) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    return names


def picked_read(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, field_id, value, family): the value most reads have, if two agree; else the most confident read.

    Then confidence and the family's place decide.
    """
    on = [*keys, "field_id"]
    place = F.array_position(F.array(*map(F.lit, FAMILY_ORDER)), F.col("family"))
    best = F.max_by(F.struct("family", "confidence"), F.struct(F.col("confidence"), -place))
    groups = snapshots.groupBy(*on, "value").agg(F.count("*").alias("n"), F.countDistinct("family").alias("families"), best.alias("b"), F.max(F.struct(F.col("confidence").alias("c"), (-place).alias("p"))).alias("rank"))
    agreed = F.struct((F.col("n") >= 2).cast("int"), F.when(F.col("n") >= 2, F.col("n")).otherwise(0), F.when(F.col("n") >= 2, F.col("families")).otherwise(0), "rank", -F.col("value"))
    return groups.groupBy(*on).agg(F.max_by(F.struct("value", F.col("b.family").alias("family"), F.col("b.confidence").alias("confidence")), agreed).alias("w")).select(*on, "w.value", "w.family", "w.confidence")


def schedule_agreement(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, field_id, reads, agree): whether any two reads of a field are equal; one alone says nothing."""
    return snapshots.groupBy(*keys, "field_id").agg(F.count("*").alias("reads"), F.countDistinct("value").alias("values")).select(*keys, "field_id", "reads", F.when(F.col("reads") >= 2, F.col("values") < F.col("reads")).alias("agree"))
