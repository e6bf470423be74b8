"""Evidence from lines and pages: corroborated amounts, scoped facts, routing of other income, coverage and rescans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions.gates import gated
from ..functions.labels import blanks
from .dealing import known

# Reads by caption alone, which need a line that has their amount: what such a line matches and must not match.
CAPTION_ONLY = "OCR label match"
CORROBORATION = {
    "other_assets": ((r"(?i)\b14\b", r"(?i)other\s+ass"), None),
    "other_current_assets": ((r"(?i)\b6\b|other\s+current\s+ass", r"(?i)other\s+current\s+ass|line\s*6"), None),
    "inventory": ((r"(?i)\b3\b", r"(?i)inventor"), r"(?i)lifo|beginning of year|end of year|determining quantities"),
}
NEVER_BY_CAPTION = ("gross_intangible_assets", "unclassified_equity")
TOTAL_ROW, LINE_14 = (r"(?i)\b1[57]\b", r"(?i)total\s+ass|totlassets|towlasses|liabilit.*equit"), r"(?i)\b14\b.{0,50}other\s+ass"
RETAINED = r"(?i)(?=.*schedule\s+l)(?=.*(?:line\s*24|23\+25|retained|unappropriated|apic \+ retained))"
# Pages of a report and what they say of a company's ratios.
RATIO_PAGE, RETURN_PAGE = 2, 8


class Scoped(NamedTuple):
    """A fact's pattern with one group, the page it belongs on, and its place among the fact's patterns."""

    fact: str
    pattern: str
    page: int | None = None
    order: int = 0


def _ratio(fact: str, label: str) -> tuple[Scoped, ...]:
    return (Scoped(fact, rf"(?im){label}\s+([\d.]+)\s+[\d.]+\s+to\s+[\d.]+", RATIO_PAGE, 0), Scoped(fact, rf"(?im){label}\s+([\d.]+)\s+[\d.]+(?!\s*%)(?!\s+to\s)", RATIO_PAGE, 1), Scoped(fact, rf"(?im){label}\s*([\d.]+)", RATIO_PAGE, 2))


def _return(fact: str, label: str) -> tuple[Scoped, ...]:
    return (Scoped(fact, rf"(?im){label}\s+([\d.]+)\s*%", RETURN_PAGE, 0), Scoped(f"{fact}_industry", rf"(?im){label}\s+[\d.]+\s*%\s+([\d.]+)\s*%", RETURN_PAGE, 0))


# The facts of a report's scorecard.
SCORECARD = (*_ratio("current_ratio", "Current Ratio"), *_ratio("quick_ratio", "Quick Ratio"), *_return("return_on_equity", "Return on Equity"), *_return("return_on_assets", "Return on Assets"), Scoped("naics", r"(?im)Industry:\s*([0-9]{5,6})\s*-"), Scoped("industry", r"(?im)Industry:\s*(?:[0-9]{5,6}\s*-\s*)?([^\n]+)"))
# Where a business's name stands, what is none, and what ends one.
NAME_PATTERNS = (
    r"(?i)PREPARED\s+FOR:\s*\n\s*([^\n]{3,80})",
    r"(?i)(?:name\s+of\s+corporation|business\s+name|name\s+of\s+partnership|partnership(?:'s)?\s+name)[^\n]{0,60}\n\s*([^\n]{3,80})",
    r"(?m)(?:^|\n)\s*([A-Z][A-Za-z0-9 &.,'()-]{4,70}(?:\s+LLC|\s+INC|\s+CORP|\s+LP|\s+LTD)\.?)\s*(?:\n|$)",
    r"(?m)(?:^|\n)\s*([A-Z][A-Za-z0-9 &.,'()-]{6,70})\s*\n\s*\d{3,5}\s+[A-Z]",
)
NO_NAME = r"(?i)^(?:do not send|keep for your records|officer'?s signature|under penalties|internal revenue|department of the treasury|form|schedule|see instructions|u\.?s\.?|identification|incorporation|stock\s+owned)|identification.*incorporation|incorporation.*stock\s+owned"
NAME_HEAD, FILE_NAME = 25_000, r"(?i)^(.+?)\s*(?:20\d{2}|tax|return)"
# What a document says of attachments and worksheets, the flags and what each asks for.
SAYS = {"statement": r"(?i)statement\s*2|stmt\s*2|other\s+deductions", "reference": r"(?i)see\s+stmt\s*[12]|statement\s*[12]|stmt\s*[12].*other\s+deduct|other\s+deduct.*statement", "worksheet": r"(?i)two\s*year|comparison\s+worksheet", "form": r"(?i)form\s+112", "schedule_l": r"(?i)schedule\s+l"}
FEW_PAGES = 4
HINTS = (
    ("comparison-missing-in-ocr", ("other_operating_expenses",), "worksheet"),
    ("comparison-worksheet-missing-other-deductions-row", ("other_operating_expenses",), "worksheet"),
    ("stmt2-detail-incomplete", ("other_operating_expenses", "taxes_licenses", "advertising"), "statement"),
    ("stmt2-missing-lines", ("other_operating_expenses", "taxes_licenses", "advertising"), "statement"),
    ("formula-inconsistency-opex-closure", ("other_operating_expenses", "taxes_licenses", "advertising"), "statement"),
    ("stmt2-total-unparseable", ("other_operating_expenses", "professional_fees", "utilities"), "reference"),
    ("schedule-l-not-detected", (), "form"),
    ("page-truncation-suspected", (), None),
)


def _caption_rows(lines: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """(keys, field_id, amount) of every line with a field's caption; amounts are read of these lines alone."""
    c = gated(F.col(line))

    def fits(needs: Sequence[str], unless: str | None) -> Column:
        test = reduce(Column.__and__, [c.rlike(p) for p in needs])
        return test & ~c.rlike(unless) if unless else test

    tests = {f: fits(*t) for f, t in CORROBORATION.items()} | {"__total": fits(TOTAL_ROW, None), "__line_14": c.rlike(LINE_14)}
    fields = F.array_compact(F.array(*[F.when(t, F.lit(f)) for f, t in tests.items()]))
    rows = lines.select(*keys, F.col(line).alias("__line"), F.explode(fields).alias("field_id"))
    text = F.col("__line")
    one = F.coalesce(A.schedule_amount(text), A.tail_amount(text))
    each = F.when(F.col("field_id") == "__total", A.money_tokens(text)).when(F.col("field_id") == "__line_14", F.array(F.lit(0).cast("long"))).otherwise(F.array(one))
    return rows.select(*keys, "field_id", F.explode(each).alias("amount")).where("amount is not null")


def caption_amounts(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """(keys, field_id, amount): an index of the amounts that lines with a field's caption have."""
    return _caption_rows(lines, keys, line).distinct()


def corroborated(cells: DataFrame, lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Cells with ``cleared``, the reason why a value goes, and null values where it does.

    A value read by its caption alone needs a line of its field with that
    amount; intangibles and equity never stand on a caption.  Other assets
    that are the total of all assets go where no line 14 is printed.  A value
    that another cell of the sheet has counts once.  Lines' amounts come
    beside the cells of the same sheet, field and amount by windows over one
    sort; where both were dealt by the keys they stay as they lie.
    """
    said = F.col("field_id")
    index = _caption_rows(lines, keys, line).where(known(keys)).select(*keys, F.when(said == "__total", "other_assets").otherwise(said).alias("field_id"), F.col("amount").alias("__amount"), F.when(said.isin("__total", "__line_14"), said).otherwise("__own").alias("__kind"))
    both = cells.withColumn("__amount", A.whole(F.col("value").cast("double"))).unionByName(index, allowMissingColumns=True)
    mine, sure = F.col("__kind").isNull(), known(keys)  # unknown keys meet nothing
    amounts = Window.partitionBy(*keys, "field_id", "__amount")
    seen = lambda kind: F.max(F.when(F.col("__kind") == kind, True))
    rows = both.withColumns({"__own": seen("__own").over(amounts), "__total": seen("__total").over(amounts)})
    of = lambda f, c: F.max(F.when(mine & sure & (said == f), F.col(c)))
    sheet = {"__printed": seen("__line_14"), "__debt": of("short_term_debt", "value"), "__equity": of("unclassified_equity", "value"), "__said": of("unclassified_equity", "source")}
    rows = rows.withColumns({name: c.over(Window.partitionBy(*keys)) for name, c in sheet.items()}).where(mine)
    value, field, source = F.col("value"), F.col("field_id"), F.coalesce("source", F.lit(""))
    by_caption = source == CAPTION_ONLY
    no = lambda c: F.col(c).isNull()
    reason = (
        F.when((field == "other_assets") & F.col("__total").isNotNull() & no("__printed"), "total of assets")
        .when(by_caption & field.isin(*CORROBORATION) & no("__own"), "uncorroborated caption").when(by_caption & field.isin(*NEVER_BY_CAPTION), "caption alone")
        .when((field == "unclassified_equity") & (value < 0), "negative equity").when((field == "other_income") & A.is_form_number(value), "form number")
        .when((field == "other_current_liabilities") & (value == F.col("__debt")), "counted as debt")
        .when((field == "other_stock_equity") & F.col("__said").rlike(RETAINED) & (F.col("__amount") == A.whole(F.col("__equity").cast("double"))), "counted as equity")
    )
    rows = rows.withColumn("cleared", F.when(value.isNotNull(), reason))
    return rows.withColumn("value", F.when(F.col("cleared").isNull(), value)).select(*cells.columns, "cleared")


def scoped_facts(pages: DataFrame, keys: Sequence[str], rules: Sequence[Scoped] = SCORECARD, page: str = "page_no", text: str = "text") -> DataFrame:
    """(keys, fact, value, page): each fact from its own page, or else from the first page that has it.

    A fact's patterns are tried in order, each on its own page before any
    other, so one pass over the pages and one minimum for each fact do.
    """
    def hit(r: Scoped) -> Column:
        value = F.regexp_extract(F.col(text), r.pattern, 1)
        scope = F.lit(1) if r.page is None else F.when(F.col(page) == r.page, 0).otherwise(1)
        return F.when(value != "", F.struct(F.lit(r.fact).alias("fact"), F.lit(r.order).alias("order"), scope.alias("scope"), F.col(page).alias("page"), F.trim(value).alias("value")))

    hits = pages.select(*keys, F.explode(F.array_compact(F.array(*map(hit, rules)))).alias("h"))
    first = F.min(F.struct("h.order", "h.scope", "h.page", "h.value"))
    return hits.groupBy(*keys, F.col("h.fact").alias("fact")).agg(first.alias("w")).select(*keys, "fact", "w.value", "w.page")


def year_headers(text: Column, most: int = 3) -> Column:
    """The first different year ends (12/31/20xx) of a text, in order."""
    return F.slice(F.array_distinct(F.transform(A.all_of(text, r"12\s*/\s*31\s*/\s*20\d{2}"), lambda d: F.regexp_replace(d, r"\s", ""))), 1, most)


def business_name(text: Column, file_name: Column) -> Column:
    """The first plausible name that a return's head prints, or else its file's."""
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(blanks(s), r"(?i)\b(?:OMB|EIN|DATE|SEE\s+INSTR|NUMBER)\b.*$", ""), r"^\d+\s*", ""))
    fine = lambda s: F.when(F.length(s).between(4, 80) & ~s.rlike(NO_NAME), s)
    head = F.substring(text, 1, NAME_HEAD)
    found = [fine(clean(F.regexp_extract(head, p, 1))) for p in NAME_PATTERNS]
    return F.coalesce(*found, fine(clean(F.regexp_extract(F.trim(F.regexp_replace(file_name, r"(?i)\.pdf$", "")), FILE_NAME, 1))))


def income_routing(of: Mapping[str, Column]) -> Column:
    """(other_income, other_operating_income, source): one amount of other income goes to one field.

    ``of`` holds, once for each sheet: ``form``, ``statement``, ``comparison``
    and ``books`` (amounts), ``kind`` of the form, and what was seen:
    ``points`` (the form's line names a statement), ``on_page`` (the line has
    the statement's amount), ``detail`` (the statement lists other income),
    ``reports`` (it belongs to other income), ``refund`` (it is a tax refund)
    and ``matched``, how many rows of the comparison were read.
    """
    is_ = lambda k: F.coalesce(of[k], F.lit(False))
    form, stmt, comp, books = (of[k] for k in ("form", "statement", "comparison", "books"))
    same = F.coalesce(A.whole(stmt.cast("double")) == A.whole(form.cast("double")), F.lit(False)) | (is_("on_page") & stmt.isNotNull())
    good = F.coalesce(comp.isNotNull() & A.keepable(comp), F.lit(False))
    read, plain = F.coalesce(of["matched"] >= 5, F.lit(False)), is_("reports") & ~is_("refund") & ~is_("detail")
    own = F.coalesce(of["kind"] == "1120", F.lit(False))
    operating = is_("points") & ~(plain & same) & ~is_("reports") & F.coalesce((comp > 0) & (form > 0) & (A.whole(comp.cast("double")) == A.whole(form.cast("double"))), F.lit(False)) & is_("refund") & (books.isNull() | (books > 0))
    to = lambda value, source: F.struct(value.cast("long").alias("other_income"), F.lit(source).alias("source"))
    nothing = F.lit(0)
    pointed = F.when(plain & same, to(stmt, "Statement 1 total (matches Form line 5)")).when(operating, to(F.lit(None), "Two-year comparison OTHER INCOME (Stmt 1 tax refund → other operating income)")).when(good, to(comp, "Two-year comparison (overrides Stmt 1 zero summary)")).when((stmt > 0) & is_("reports") & ~is_("detail"), to(stmt, "Statement 1")).otherwise(to(nothing, "Form 1120-S line 5 (Stmt 1 multi-line; summary zero)"))
    routed = (
        F.when(is_("points"), pointed).when(own & form.isNotNull() & is_("reports"), to(form, "Form 1120 line 5")).when(comp.isNotNull() & read, to(comp, "Two-year comparison"))
        .when(form.isNotNull() & is_("reports") & comp.isNull(), to(form, "Form 1120 line 5")).when(stmt.isNotNull() & plain, to(stmt, "Statement 1"))
    )
    return F.struct(routed["other_income"].alias("other_income"), F.when(operating, F.coalesce(books, comp)).cast("long").alias("other_operating_income"), routed["source"].alias("source"))


def coverage(pages: DataFrame, facts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, n_pages, closure, flags, hints): what a document's pages speak of that was not read.

    ``facts`` is (keys, statement_total, detail_sum, comparison_total,
    comparison_found, known, rest, schedule_found), as far as it was read.
    """
    seen = pages.groupBy(*keys).agg(F.count("*").alias("n_pages"), *[F.max(F.col(text).rlike(p)).alias(f"__{k}") for k, p in SAYS.items()])
    rows = seen.join(facts, list(keys), "left")
    c, yes = F.col, lambda k: F.coalesce(F.col(k), F.lit(False))
    closure = F.when(c("rest").isNotNull() & (c("statement_total") > 0), (F.abs(F.coalesce("known", F.lit(0)) + c("rest") - c("statement_total")) <= 1).cast("int"))
    rows = rows.withColumn("closure", closure)
    tests = {
        "comparison-missing-in-ocr": ~yes("comparison_found") & yes("__worksheet"), "comparison-worksheet-missing-other-deductions-row": yes("comparison_found") & c("comparison_total").isNull(),
        "stmt2-detail-incomplete": F.coalesce((c("comparison_total") >= 1) & (c("detail_sum") >= 1) & (c("detail_sum") < c("comparison_total")), F.lit(False)),
        "stmt2-missing-lines": c("statement_total").isNull() & yes("__statement"), "formula-inconsistency-opex-closure": F.coalesce(c("closure") == 0, F.lit(False)),
        "stmt2-total-unparseable": c("statement_total").isNull() & yes("__reference"), "schedule-l-not-detected": ~(yes("schedule_found") | yes("__schedule_l")) & yes("__form"), "page-truncation-suspected": c("n_pages") < FEW_PAGES,
    }
    flags = F.array_compact(F.array(*[F.when(tests[f], F.lit(f)) for f, _, _ in HINTS]))
    hints = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(tests[f], F.array(*map(F.lit, h)) if h else F.array().cast("array<string>")).otherwise(F.array().cast("array<string>")) for f, h, _ in HINTS]))))
    return rows.select(*keys, "n_pages", "closure", flags.alias("flags"), hints.alias("hints"))


def rescan(pages: DataFrame, found: DataFrame, done: DataFrame, keys: Sequence[str], page: str = "page_no", text: str = "text") -> DataFrame:
    """(keys, page): the pages that a document's flags name and that this tier has not read again."""
    wanted = reduce(Column.__or__, [F.array_contains("flags", f) & F.col(text).rlike(SAYS[k]) for f, _, k in HINTS if k])
    rows = pages.join(found.select(*keys, "flags"), list(keys)).where(wanted).select(*keys, page).distinct()
    return rows.join(done.select(*keys, page).distinct(), [*keys, page], "left_anti")
