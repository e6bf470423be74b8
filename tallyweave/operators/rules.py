"""Ordered rule tables with reasons, and small decisions over the cells of one sheet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions.labels import ROW, blanks, is_anchor, is_footer
from .dealing import known
from .ranking import best
from .verify import decided

# Captions and footers that hold no amounts.
NOISE_LINE = r"(?i)ibisworld|common size|% of sales|% of total assets|naics code"
HISTORICAL = r"(?i)gross\s+receipts\s+for\s+20\d{2}"
HISTORICAL_CONTEXT = r"(?i)8990\s+gross\s+receipts\s+for\s+20\d{2}|section\s+448|3\s+tax\s+years|aggregate\s+average"
INTEREST_CRUMB = r"(?i)million|form\s*8990|see instructions|163\s*\(\s*j\s*\)|section\s*163|business\s+interest\s+(?:expense\s+)?limitation|irc\s*§?\s*163"
PAYMENT = r"(?i)\b(?:fein|ein|employer\s+ident|tax\s+period|payment\s+type|credit\s+card\s*\(fees)\b|(?=.*\bcredit\s+card\b)(?=.*(?:payment|instruction|apply|banking\s+information))"
EMPLOYER_NUMBER = r"\b(\d{2})-(\d{7})\b"
BAD_KEY = r"identification|incorporation|stock\s+owned|schedule\s*[a-z]|form\s*\d"
PREPARER_KEY = r"^(\S+)\s+\1$|\b(pllc|cpa|p\.?c\.?)\b"
ENTITY_KEY = r"\b(llc|inc|corp|corporation|company|services|service|supply)\b"
GENERIC_WORDS = ("llc", "inc", "corp", "corporation", "company", "services", "service", "supply", "the", "and")
ANCHORS = (("sales", r"(?i)\b(sales|gross\s+receipts|gross\s+income|total\s+income)\b"), ("cogs", r"(?i)\b(cogs|cost\s+of\s+goods|cost\s+of\s+sales)\b"), ("gross_fixed_assets", r"(?i)\b(fixed\s+assets|gross\s+fixed|property\s+plant)\b"), ("inventory", r"(?i)\b(inventory|inventories)\b"))
REVIEW_FLAG = r"(?i)candidate_conflict|source_disagreement|formula.disagreement|formula_inconsistency|ocr_incomplete|verify manually|verify against|residual opex|low.trust|low_trust|ocr label|likely form line|structural|disagree|outside typical range|comparison_missing"
FORM_LINE_2 = r"(?i)form\s*1120(?:-s)?\s*(?:page\s*1\s*)?line\s*2\b|page\s*1\s+block"


class Rejection(NamedTuple):
    """Why a value of a field is not taken from a line: ``when`` matches it and ``unless`` does not."""

    reason: str
    fields: tuple[str, ...] = ()
    when: str | None = None
    unless: str | None = None
    negative: bool = False
    no_amount: bool = False


# Which lines a field's value is not taken from.
REJECTIONS = (
    Rejection("payable", ("bank_credit_card",), r"(?i)payable"),
    Rejection("licenses", ("officer_compensation", "taxes_paid"), r"(?i)taxes?\s+and\s+(lic|license)"),
    Rejection("gross profit", ("cogs",), r"(?i)gross profit|\[3\b|\b3\b.*gross"),
    Rejection("accumulated", ("depreciation",), r"(?i)accumulated|less\s+acc|post-1986|adjustment|form\s*4562"),
    Rejection("negative", ("depreciation", "unclassified_equity"), negative=True),
    Rejection("accumulated", ("amortization",), r"(?i)accumulated|less\s+acc|schedule\s*l|gross\s+intangible"),
    Rejection("not accumulated", ("accumulated_depreciation",), unless=r"(?i)accumulated|less\s+acc"),
    Rejection("other assets", ("accumulated_amortization",), r"(?i)other\s+assets|\b14\b", r"(?i)amort|accumulated"),
    Rejection("other assets", ("accumulated_amortization",), r"(?i)other\s+ass", r"(?i)less\s+accumulated\s+amort"),
    Rejection("payables", ("other_current_assets",), r"(?i)accounts\s+payable|\b16\b", r"(?i)other\s+current\s+asset|line\s*6|\b6\b"),
    Rejection("caption", ("other_current_assets",), unless=r"(?i)other\s+current\s+ass|line\s*6|\b6\b"),
    Rejection("question", ("inventory",), r"(?i)was there any change|determining quantities|opening and closing inventory|lifo inventory method|figured under lifo|inventory at (?:beginning|end) of year|section\s*263|1\.263|263A|de\s*minimis\s+safe\s+harbor"),
    Rejection("caption", ("unclassified_equity",), unless=r"(?i)retained|equity|line\s*24|\b24\b"),
    Rejection("share schedule", ("other_income",), r"(?i)\b10\b.*other\s+income|schedule\s*k-?1|shareholder|1045\s+other\s+income|identifv?ying\s+number"),
    Rejection("other income", ("other_operating_income",), r"(?i)other\s+income", r"(?i)other\s+operat.{0,8}inc"),
    Rejection("caption", ("sales",), unless=r"(?i)receipt|sales|1a|1c"),
    Rejection("caption", ("cogs",), unless=r"(?i)cost\s+of|cogs|goods\s+sold"),
    Rejection("total", ("rent",), r"(?i)gross\s+profit|total\s+income|ordinary\s+income"),
    Rejection("interest", ("taxes_licenses",), r"(?i)(\b13\b|\[13\]).*interest"),
    Rejection("other caption", ("other_assets",), r"(?i)current\s+liabilit|total\s+assets|totlassets|total\s+liabilit|shareholders|ending\s+assets|beginning\s+assets|f\s+total\s+assets|\b15\b"),
    Rejection("other caption", ("other_assets",), r"(?i)other\s+current\s+asset|line\s*6|\b6\b", r"(?i)line\s*14|\b14\b"),
    Rejection("caption", ("other_assets",), unless=r"(?i)\b14\b|other\s+ass"),
    Rejection("no amount", ("other_current_liabilities", "accounts_payable", "accounts_receivable", "taxes_licenses", "depreciation", "other_income", "accumulated_amortization", "gross_intangible_assets"), no_amount=True),
)


def rejected(field: Column, line: Column, value: Column, year: Column, rules: Sequence[Rejection] = REJECTIONS) -> Column:
    """The first reason why a hit does not count, or null.

    Form numbers, the year and the row's own number come before the rules.
    """
    size = F.abs(value)
    empty = F.size(A.substantial_tokens(line)) == 0
    chain = F.when(A.is_form_number(size), "form number").when((size == year) | (size == year % 100), "year").when(size == A.leading_number(line), "row number")
    for r in rules:
        test = field.isin(*r.fields) if r.fields else F.lit(True)
        if r.when:
            test = test & line.rlike(r.when)
        if r.unless:
            test = test & ~line.rlike(r.unless)
        if r.negative:
            test = test & (value < 0)
        if r.no_amount:
            test = test & empty
        chain = chain.when(test, r.reason)
    return chain


def split_rejects(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``): both from one column, so nothing is in both or neither."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def is_noise(line: Column) -> Column:
    """Lines of industry figures, percentages and earlier years' receipts."""
    return line.rlike(NOISE_LINE) | line.rlike(r"\d\s*%") | (line.rlike(HISTORICAL) & line.rlike(HISTORICAL_CONTEXT))


def interest_crumb(amount: Column, source: Column) -> Column:
    s = F.coalesce(source, F.lit(""))
    return s.rlike(INTEREST_CRUMB) | ((A.whole(amount.cast("double")) == 163) & s.rlike(r"(?i)OCR label match|fuzzy|tail scan"))


def rolled_up(label: Column, amount: Column) -> Column:
    """Whether a caption still holds the columns of a worksheet and the amount is their sum or the largest."""
    runs = F.transform(A.all_of(label, r"\d{1,3}(?:,\d{3})+"), lambda r: F.replace(r, F.lit(","), F.lit("")).cast("long"))

    def of(n: Column) -> Column:
        pair = F.exists(n, lambda a: F.exists(n, lambda b: F.abs(a + b - amount) <= 1) & ((F.size(F.filter(n, lambda c: c == a)) > 1) | (F.abs(a + a - amount) > 1)))
        top = F.sort_array(n, asc=False)
        return (F.size(n) >= 2) & (pair | ((F.get(top, 0) == amount) & (F.get(top, 1) >= 1)))

    return label.rlike(r"~~|\[\s*[~\d,]{3,}") | F.coalesce(A.let(runs, of), F.lit(False))


def ends_employer_number(label: Column, amount: Column) -> Column:
    """Whether an amount is the end of an employer's number on its line, or all of it."""
    number = F.regexp_extract(label, EMPLOYER_NUMBER, 2)
    digits = A.whole(F.abs(amount.cast("double"))).cast("string")
    ends = (number != "") & (F.endswith(number, digits) | (digits == F.concat(F.regexp_extract(label, EMPLOYER_NUMBER, 1), number)))
    return F.coalesce(ends, F.lit(False))


def caption_says(label: Column, source: Column | None = None) -> dict[str, Column]:
    """What ``illogical`` asks of a caption and its source alone, whatever the amount."""
    said = F.coalesce(source, F.lit("")) if source is not None else F.lit("")
    return {
        "payment": label.rlike(PAYMENT), "employer": label.rlike(EMPLOYER_NUMBER), "footer": is_footer(label), "anchor": ~said.rlike(ROW) & is_anchor(label) if source is not None else F.lit(False),
        **{f: label.rlike(p) for f, p in ANCHORS}, "pay": (label.rlike(r"(?i)salar|\bwage") | said.rlike(r"(?i)salaries_wages\s+row")) & ~said.rlike(r"(?i)form\s*1120"), "columns": label.rlike(r"~~|\[\s*[~\d,]{3,}|\d{1,3}(?:,\d{3})+"),
    }


def illogical(label: Column, amount: Column, sheet: dict[str, Column], source: Column | None = None, says: dict[str, Column] | None = None) -> Column:
    """Why a pool line's amount makes no sense beside the sheet's own values, or null; the first reason counts.

    ``sheet`` has columns of sales, cogs, gross_fixed_assets, inventory,
    officer_compensation and salaries_wages, as far as they are known.
    ``source`` is what the line was read from: rows of a worksheet with a
    field's name are trusted whatever their caption, and forms may sum up pay.
    ``says`` is what ``caption_says`` has found before, if it was asked.
    """
    says = says or caption_says(label, source)
    v = A.whole(amount.cast("double"))
    known = lambda f: A.whole(sheet[f].cast("double")) if f in sheet else F.lit(None).cast("long")
    steps = [
        ("below_min_amount", (v < 1) | A.is_form_number(v) | A.is_year(v)),
        ("unreasonable_digits", ~A.is_reasonable(v)),
        ("ein_or_payment_bleed", says["payment"] | (says["employer"] & ends_employer_number(label, v))),
        ("mailing_or_form_footer_noise", says["footer"]),
        ("non_expense_anchor", says["anchor"]),
        ("collides_with_sales", (known("sales") >= 1) & (v > known("sales"))),
        *[(f"collides_with_{f}", says[f] & (known(f) == v)) for f, _ in ANCHORS],
        ("collides_with_payroll_sum", (known("officer_compensation") >= 1) & (known("salaries_wages") >= 1) & (v == known("officer_compensation") + known("salaries_wages"))),
        ("uncorroborated_mega_payroll", says["pay"] & says["columns"] & rolled_up(label, v)),
    ]
    return F.nullif(decided([(name, F.coalesce(test, F.lit(False))) for name, test in steps], ""), F.lit(""))


def key_quality(key: Column) -> Column:
    """What a client key is worth: captions and preparers' names are unreliable, legal entities are strong."""
    t = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    return decided([("unreliable", (t == "") | t.rlike(BAD_KEY) | t.rlike(PREPARER_KEY)), ("strong-entity", t.rlike(ENTITY_KEY) & t.rlike("[a-z]{3,}"))], "plausible")


def shares_identity(a: Column, b: Column) -> Column:
    """Whether two client keys can be one company: equal, one in the other, or a telling word in common."""
    words = lambda k: F.filter(F.split(k, r"\s+"), lambda w: w.rlike("[a-z]{3,}") & ~w.isin(*GENERIC_WORDS))
    return (a == b) | F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(words(a), words(b))


def other_company(existing: Column, incoming: Column, overlap: Column) -> Column:
    """Whether an upload is of another company, whose years replace the ones there.

    Only for keys that share nothing and are both reliable; years that do not
    ``overlap`` are replaced only between two legal entities.
    """
    q = [key_quality(k) for k in (existing, incoming)]
    sure = (q[0] != "unreliable") & (q[1] != "unreliable") & F.when(overlap, F.lit(True)).otherwise((q[0] == "strong-entity") & (q[1] == "strong-entity"))
    return F.coalesce(~shares_identity(existing, incoming) & sure, F.lit(False))


def preferred_identity(rows: DataFrame, keys: Sequence[str], client: str, order: Sequence[str]) -> DataFrame:
    """(keys, client, quality): the best identity of each group; of equal ones the first."""
    q = F.col("quality")
    rank = F.when(q == "strong-entity", 0).when(q == "plausible", 1).otherwise(2)
    return best(rows.where(F.col(client).isNotNull()).withColumn("quality", key_quality(F.col(client))), keys, [F.asc(rank), *[F.asc(c) for c in order]]).select(*keys, client, "quality")


def needs_review(value: Column, status: Column, tier: Column, confidence: Column, flags: Column, verified: Column, corroborated: Column) -> Column:
    """Whether a person has to look at a cell that is neither verified nor corroborated by a formula."""
    doubt = value.isNull() | (status == "missing") | (tier == "empty") | (status == "review") | tier.isin("low", "ocr-only", "math-warning") | F.coalesce(confidence < 55, F.lit(False)) | F.exists(flags, lambda f: f.rlike(REVIEW_FLAG))
    return ~F.coalesce(verified, F.lit(False)) & ~F.coalesce(corroborated, F.lit(False)) & F.coalesce(doubt, F.lit(False))


def cost_of_goods(sales: Column, form: Column, comparison: Column, source: Column) -> Column:
    """struct(value, source) of two reads of the cost of goods, decided by identities and not by size."""
    as_is = lambda v, s: F.struct(v.alias("value"), s.alias("source"))
    s, compared = F.coalesce(source, F.lit("Form 1120-S line 2")), F.lit("Two-year comparison (COGS row)")
    profit = (sales > form) & (F.abs(comparison - (sales - form)) <= 1)
    both = form.isNotNull() & comparison.isNotNull()
    return (
        F.when(both & (F.abs(form - comparison) <= 1), F.lit(None).cast("struct<value: bigint, source: string>"))
        .when(both & profit, as_is(form, F.concat(s, F.lit(" (comparison row was gross profit)"))))
        .when(both & s.rlike(FORM_LINE_2), as_is(form, F.concat(s, F.lit(" (preferred over comparison disagreement)"))))
        .when(both, as_is(comparison, F.lit("Two-year comparison (COGS row — form year column mismatch)")))
        .when(form.isNotNull(), as_is(form, s))
        .when(comparison.isNotNull(), as_is(comparison, compared))
    )


def aliased(rows: DataFrame, label: str, aliases: DataFrame, into: str = "field_id") -> DataFrame:
    """Labels looked up in a small (label, field_id) dimension; without an entry the label in snake case."""
    key = F.lower(blanks(F.col(label)))
    snake = F.regexp_replace(F.regexp_replace(key, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    a = aliases.select(F.lower(blanks(F.col("label"))).alias("__label"), F.col("field_id").alias("__field"))
    return rows.withColumn("__key", key).join(a, F.col("__key") == F.col("__label"), "left").withColumn(into, F.coalesce("__field", snake)).drop("__key", "__label", "__field")


def filled(cells: DataFrame, catalogue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_filled, n_fields, ratio, missing): how much of a sheet's catalogue has values."""
    fields = catalogue.select("field_id", "label")  # the fields of a form: a fixed list
    known_fields = F.broadcast(fields.select("field_id").distinct().withColumn("__known", F.lit(True)))
    there = F.when(known(keys) & F.col("value").isNotNull() & F.col("__known"), F.col("field_id"))
    sheets = cells.join(known_fields, "field_id", "left").groupBy(*keys).agg(F.collect_set(there).alias("__there"))
    rows = sheets.crossJoin(F.broadcast(fields.agg(F.collect_list(F.struct("field_id", "label")).alias("__all")))).where(F.size("__all") > 0)
    filled = lambda f: F.coalesce(F.array_contains("__there", f["field_id"]), F.lit(False))
    missing = F.array_sort(F.array_compact(F.transform(F.filter("__all", lambda f: ~filled(f)), lambda f: f["label"])))
    rows = rows.select(*keys, F.size(F.filter("__all", filled)).cast("long").alias("n_filled"), F.size("__all").cast("long").alias("n_fields"), missing.alias("missing"))
    return rows.withColumn("ratio", F.round(F.col("n_filled") / F.col("n_fields"), 6))


def duplicate_periods(files: DataFrame, period: str, name: str) -> DataFrame:
    """(period, n, names): periods that several files claim."""
    return files.groupBy(period).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names")).where("n > 1")


def distinct_sum(rows: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """(keys, amount): different amounts added once each; repeated prints of a line do not count again."""
    return rows.groupBy(*keys).agg(F.sum_distinct(F.col(amount)).alias(amount))


def accuracy(scored: DataFrame, keys: Sequence[str], ok: str, error: str) -> DataFrame:
    """(keys, n, n_ok, rate, median_error, spread): how often and by how much values are off."""
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(ok).cast("int")).alias("n_ok"), F.round(F.avg(F.col(ok).cast("double")), 6).alias("rate"), F.median(error).alias("median_error"), F.round(F.stddev(error), 4).alias("spread"))


def rescan_needed(reports: DataFrame, facts: str = "n_facts", industry: str = "n_industry") -> DataFrame:
    """Reports of which too little was read without recognition."""
    return reports.where((F.col(facts) < 4) | (F.col(industry) < 3))


def all_fields(*tiers: DataFrame) -> DataFrame:
    """The fields that any tier is to fill."""
    return reduce(DataFrame.unionByName, [t.select("field_id") for t in tiers]).distinct()
