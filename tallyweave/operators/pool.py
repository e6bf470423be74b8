"""The pool of expense lines of a sheet (one client's year): noise, groups, rewrite passes, partition.

Pool lines are (sheet keys, ord, label, amount, source).  Every line that does
not end up in the pool keeps the reason why, so each rewrite can be traced.
Captions and sources repeat from sheet to sheet: what they say by themselves is
asked once of each pair of them, and travels as marks in one number.  Lines are
dealt out by sheet; the best line of a group is found by a window, and the
passes are windows over the sheet that share that exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import labels as L
from ..functions.labels import POSITION_LABEL, ROW, blanks, is_anchor, is_footer
from .dealing import spread
from .rules import ANCHORS, caption_says, illogical

# Repairs of labels as scans spoil them, in order.
REPAIRS = (
    (r"\badetsing\b", "advertising"), (r"\badvert?is(?:ing|ng)\b", "advertising"), (r"\btees\s*and\s*li(?:c|es)(?:enses?)?\b", "taxes and licenses"), (r"\btaes\s*and\s*li(?:c|es)\b", "taxes and licenses"), (r"\bteesandlicenses?\b", "taxes and licenses"),
    (r"\botner\b", "other"), (r"\butilit(?:y|ies|es)\b", "utilities"), (r"\bprofes{1,2}ional\b", "professional"), (r"\bcompensat(?:ion)?\s*of\s*officers?\b", "compensation of officers"), (r"\bsalar(?:y|ies)\s*and\s*wages?\b", "salaries and wages"),
    (r"\bmerchant\s*svc\b", "merchant service"), (r"\baccounting\s*&\s*legal\b", "accounting legal"), (r"\blegal\s+and\s+professional\b", "legal and professional"), (r"\brepairs?\s+and\s+maint(?:enance)?\b", "repairs and maintenance"), (r"\bbank\s*&\s*credit\s+card\b", "bank credit card"),
    (r"\bcost\s+of\s+(?:goods|sales)\b", "cost of goods sold"), (r"\baxes\s+and\s+lic", "taxes and licenses"), (r"\bcontinuing\s+eduation\b", "continuing education"), (r"\bsection\s+a\s+w\s+wages?\b", "section a wages"), (r"\brepairs?\s+and\s+maint(?:enance)?\s+a\b", "repairs and maintenance"),
    (r"\brents?\s*\|", "rent"), (r"\bross\s+receipts?\b", "gross receipts"), (r"\bost\s+of\s+goods\b", "cost of goods"), (r"\bompensation\s+of\s+officers?\b", "compensation of officers"), (r"\balaries\s+and\s+wages?\b", "salaries and wages"),
    (r"\brofessional\b", "professional"), (r"\brofessional\s+fees?\b", "professional fees"), (r"\btilities\b", "utilities"), (r"\btatement\s*2\b", "statement 2"), (r"\bther\s+deduct", "other deduct"),
    (r"\bank\s*&\s*credit\s+card\s+charg", "bank credit card charges"), (r"\bdues\s*&\s*subscriptions?\b", "dues and subscriptions"), (r"\btravel\s*&\s*mileage\b", "travel and mileage"),
)
# Words of expenses; titles of returns.
EXPENSE_WORD = r"(?i)\b(?:fee|fees|rents?|utilit\w*|insur\w*|suppl\w*|office|bank|credit|merchant|profession\w*|legal|account\w*|repairs?|maint\w*|tax|licen\w*|benefit\w*|gasoline|payroll|salar\w*|wages?|officer|compens\w*|advert\w*|travel|telephone|dues|misc\w*|job|vehicle|fuel|amortization|janitorial|contract|labor|tolls|meals|education|software|equipment|recruit|auto|pension|profit-?shar\w*|charit\w*)\b"
TITLE = r"(?i)\b(?:income\s+tax\s+return|corporate\s+income\s+tax|business\s+tax\s+return)\b|^(?=.{26})(?=.*\bform\s+1120[-\s]?[sb]?\b)(?=.*\b\d{4}\b)|(?=.*\bk[-\s]?\d{2,4}[a-z]?\b)(?=.*\b(?:return|corporation|income\s+tax)\b)"
# What a source says.
ANY_ROW, FORM_LINE, STATEMENT = r"(?i)\(([a-z_]+)\s+row\)", r"(?i)form\s*1120[-\s]?[sb]?\s*line\s*(\d+)", r"(?i)(?:statement|stmt)\s*(\d+)"
DETAIL = r"(?i)statement\s*\d|stmt\s*\d|two.year\s+comparison|attachment|caps\s+label|ocr\s+caps|document[\s._-]*scan"
ITEMIZED = r"(?i)statement\s*\d|stmt\s*\d|form\s+attachment|attachment\s+table|ocr\s+caps|caps\s+label"
STATEMENT_DETAIL = r"(?i)statement\s*\d|stmt\s*\d|form\s+attachment|federal\s+statements"
SCAN, CAPS = r"(?i)document[\s._-]*scan", r"(?i)caps\s+label"
ALLOWED = r"(?i)form\s*1120|form\s*1125|statement\s*\d|stmt\s*\d|attachment|other\s+deduct|federal\s+statements|caps\s+label|comparison_rules|comparison\s*deduction|two[\s.-]?year\s+comparison|comparison\s*\(|document[\s._-]*scan|ocr\s+caps|ocr\s+label\s+match|parser\s+field"
CRUMB = "(residual crumb)"
TAX_SPLIT = r"(?i)statement\s*\d*\s*taxes|payroll\/sales|payroll\/licenses|taxes\s+minus\s+taxes\s+paid"
TAX_SOURCE = r"(?i)form\s*1120|two[\s.-]?year\s+comparison|statement\s*\d*\s*taxes|payroll\/sales|payroll\/licenses|taxes\s+minus\s+taxes\s+paid"
SLOT_SOURCE = r"(?i)\([a-z_]+\s+row\)|form\s*1120|ocr\s+label\s+match|two[\s.-]?year\s+comparison|statement\s*\d*\s*taxes|payroll\/sales|payroll\/licenses|taxes\s+minus\s+taxes\s+paid"


class Noise(NamedTuple):
    """A kind of line that is no expense of the pool: patterns that label and source have to match or must not match."""

    reason: str
    label: str = ""
    unless: str | None = None
    source: str | None = None
    unless_source: str | None = None
    row: bool | None = None  # False: not for a worksheet row with a field's name


# Kinds of noise, in order.
NOISE = (
    Noise("entity name", r"(?i)^(?=.{8})(?=(?:\S+\s+){2}).*\b(?:inc|llc|l\.l\.c|corp|corporation)\b\.?\s*$", r"(?i)\b(?:fee|rent|util|insur|repair|tax|bank|merchant|profession|suppl|benefit|gasoline|payroll|salar|wage|officer|compens|advert)\b"),
    Noise("payroll tax", r"(?i)payroll\s+tax", row=False),
    Noise("income tax", r"(?i)\b(?:based on income|state and city\s+tax|city\s+tax\s+based|profits?\s+tax)\b|^total\s+tax\b", r"(?i)payroll\s+tax|tax(?:es)?\s*(?:and|&)?\s*licen", row=False),
    Noise("other income", r"(?i)discount\s+income|cash\s+over\s*\/?\s*short", unless_source=r"(?i)other\s+deduct", row=False),
    Noise("other income", r"(?i)^other\s+income\b|^miscellaneous\b", source=r"(?i)statement\s*1\b|federal\s+statements|form\s+attachment", unless_source=r"(?i)other\s+deduct", row=False),
    Noise("wages of a schedule", r"(?i)section\s+199a"),
    Noise("wages of a schedule", r"(?i)\bw-?2\s+wages?\b", row=False),
    Noise("other tax", r"(?i)tax\s+deposited|deposited\s+with\s+form|property\s+tax|estimated\s+tax", r"(?i)tax(?:es)?\s*(?:and|&)?\s*licen", row=False),
    Noise("merchant of goods", r"(?i)merchant", source=r"(?i)total\s+to\s+line\s*5|form\s*1125|other\s+costs?\b|cogs|cost\s+of\s+(?:goods|sales)", unless_source=r"(?i)other\s+deduct|trade\s+or\s+business\s+deduct", row=False),
    Noise("merchant of goods", r"(?i)merchant\s+fees?\b", source=r"(?i)federal\s+statements\s+table", unless_source=r"(?i)other\s+deduct|trade\s+or\s+business\s+deduct", row=False),
    Noise("tax credit", r"(?i)bond\s+credits?|credit for tax withheld|overpayment\s+credited|section\s+\d+\s+tax from form|credits? from form|vehicles?\s*\/\s*\/"),
    Noise("cost of goods", r"(?i)total\s+to\s+line\s*5\b|other\s+costs?\b"),
    Noise("cost of goods", source=r"(?i)(?=.*line\s*5\b)(?=.*(?:other\s+cost|cogs|cost\s+of\s+(?:goods|sales)))|form\s*1120[-\s]?[sb]?\s*(?:page\s*\d+[.,]?\s*)?line\s*5\b"),
)
#: Lines that count for the rest only: page-one captions, and statement detail that is no top row.
PAGE_ONE = r"(?i)\bpension\b|profit[-\s]?shar|charit"
REST_ONLY, TOP_ROWS = r"(?i)payroll\s+tax|payroll\s+processing|charitable\s+contr|settlement|staff\s+meetings?|temporary\s+labor|equipment\s+rental|50\s*%\s*of\s+meals|telephone|tolls?|parking|software|dues\s*&?\s*subscriptions?|fuel\s+charg|continuing\s+edu", r"(?i)^(?:bank|credit\s*card|merchant|professional|legal|account|utilities|insurance|rent|repair|advert|officer|salar|wage)\b"


def said(source: Column) -> Column:
    return F.coalesce(source, F.lit(""))


def repaired(label: Column) -> Column:
    """A label in lower case, without marks before it, with the usual scanning errors mended."""
    bare = F.regexp_replace(label, r"^[\s|§£€\[\]{}#@*\\/>~_:=+]+", "")
    return blanks(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), REPAIRS, F.lower(blanks(bare))))


def label_quality(label: Column) -> Column:
    """(repaired, legible, weak, notes): how well a label reads; nothing is dropped for it."""
    r = blanks(F.regexp_replace(F.regexp_replace(repaired(F.trim(label)), r"\s*\|\s*\|?\s*$", ""), r"(?i)\s+a\s*\|$", ""))
    lead = F.trim(label).rlike(r"(?i)^w\s+wages?\b")
    text = F.when(lead, F.regexp_replace(r, r"(?i)^w\s+wages?\b", "wages")).otherwise(r)
    form = r.rlike(r"(?i)calendar year|tax year beginning|for calendar year ending")
    tests = (
        ("form_boilerplate_text", form), ("digits_only", r.rlike(r"^\d+$")), ("too_short", F.length(r) < 3), ("truncated_long", F.length(r) > 60), ("repaired_leading_w_wages", lead),
        ("missing_leading_char_guess", text.rlike(r"(?i)^[a-z]{1,2}\s+[a-z]") & ~text.rlike(EXPENSE_WORD)), ("no_word_chars", ~text.rlike(r"(?i)[a-z]{3,}")),
    )
    legible = (F.length(text) >= 3) & text.rlike(r"(?i)[a-z]{3,}") & ~text.rlike(r"(?i)^(?:form|schedule|total|description|amount)\b") & ~form & ~r.rlike(r"^\d+$")
    weak = legible & ~text.rlike(EXPENSE_WORD)
    notes = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests], F.when(weak, F.lit("no_expense_keyword_match"))))
    return F.struct(text.alias("repaired"), legible.alias("legible"), weak.alias("weak"), notes.alias("notes"))


def is_cross_reference(label: Column) -> Column:
    """Pieces of references to statements and forms without an expense's caption."""
    n = F.length(label)
    other = (label.rlike(r"(?i)^other\s+deductions?\b") & (n <= 40)) | (label.rlike(r"(?i)\b(?:attach|see\s+stmt|see\s+statement|as\s+shown|refer\s+to)\b") & (n <= 60)) | (label.rlike(r"(?i)^statement\s*\d{1,2}\b") & (n <= 30))
    return label.rlike(r"(?i)\btotal\s+to\s+form\b") | (~label.rlike(EXPENSE_WORD) & other)


def is_structural_noise(label: Column, source: Column) -> Column:
    """Lines that are no expense by the shape of label and source; known rows and captions with an expense's word stay."""
    row, any_row, word = source.rlike(ROW), source.rlike(ANY_ROW), label.rlike(EXPENSE_WORD)
    position = label.rlike(POSITION_LABEL)
    trusted = (source.rlike(FORM_LINE) | source.rlike(r"(?i)statement\s*\d|stmt\s*\d|attachment|caps\s+label|ocr\s+caps")) & word
    page = source.rlike(r"(?i)form\s*1120") & ~source.rlike(r"(?i)statement\s*\d|stmt\s*\d|attachment") & ~word
    raw = source.rlike(r"(?i)comparison_raw|comparison_deduction_schedule") & ~word
    compared = source.rlike(r"(?i)two.year\s+comparison|comparison\s*\(") & ~word & ~label.rlike(r"(?i)\b(?:officer|compens|salar|wage|payroll|rent|tax|licen|insur|benefit)\b")
    rest = label.rlike(r"(?i)paperwork\s+reduction|see\s+separate\s+instructions") | page | label.rlike(TITLE) | is_cross_reference(label) | is_footer(label) | is_anchor(label) | label.rlike(r"^\d{4}$") | raw | compared
    return F.when(row, position).when(any_row, position | is_anchor(label)).when(trusted, F.lit(False)).otherwise(rest)


def is_excluded_source(label: Column, source: Column, category: Column) -> Column:
    """Sources that are none of the pool's, and worksheet cells that hold changes, totals or unknown captions."""
    plausible = label.rlike(EXPENSE_WORD) & F.length(label).between(3, 80) & ~label.rlike(r"(?i)^total\b")
    raw = source.rlike(r"(?i)\(raw\s+row\)|comparison_raw|comparison_deduction_schedule") | source.rlike(SCAN)
    compared = source.rlike(r"(?i)comparison|two.year")
    change = label.rlike(r"(?i)\b(?:change|increase|decrease|variance|percent|%|difference|prior|column)\b|\btotal\s+(?:deduct|expense|income)\b")
    grid = compared & ~source.rlike(ANY_ROW) & category.isNull() & ~plausible
    return F.when(raw, category.isNull() & ~plausible).otherwise(((source != "") & ~source.rlike(ALLOWED)) | (~source.rlike(ROW) & is_anchor(label)) | (compared & change) | grid)


def noise(label: Column, source: Column) -> Column:
    """The first kind of noise that a line is, or null."""
    of_row = source.rlike(ANY_ROW) & ~source.rlike(r"(?i)\(raw\s+row\)")
    chain = F.when(F.lit(False), F.lit(""))
    for n in NOISE:
        test = label.rlike(n.label) if n.label else F.lit(True)
        test = test & ~label.rlike(n.unless) if n.unless else test
        test = test & source.rlike(n.source) if n.source else test
        test = test & ~source.rlike(n.unless_source) if n.unless_source else test
        chain = chain.when(test & ~of_row if n.row is False else test, n.reason)
    return chain


def keepable(amount: Column) -> Column:
    return F.coalesce((F.abs(amount) >= 1) & A.is_reasonable(amount) & ~A.is_form_number(amount) & ~A.is_year(amount), F.lit(False))


def crumb_row(label: Column, source: Column) -> Column:
    """The number of the row that a line says it is."""
    return F.coalesce(F.nullif(F.regexp_extract(source, r"(?i)\bline\s*(\d{1,3})\b", 1), F.lit("")), F.nullif(F.regexp_extract(label, r"^\s*(\d{1,3})\b", 1), F.lit(""))).cast("long")


def is_instruction(label: Column, source: Column) -> Column:
    """What a form says about itself."""
    return F.concat_ws(" ", source, label).rlike(r"(?i)see\s+instructions|reserved\s+for\s+future|paperwork\s+reduction")


def group_key(label: Column, source: Column, category: Column) -> Column:
    """What a line is a reading of: a worksheet's row, a form's line, a statement's item, a category, a label; null if nothing tells."""
    row, form, statement = (F.nullif(F.lower(F.regexp_extract(source, p, 1)), F.lit("")) for p in (ANY_ROW, FORM_LINE, STATEMENT))
    name = F.nullif(F.coalesce(category, L.expense_key(label)), F.lit(""))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.coalesce(
        F.when(row != "raw", join("row:", row)), join("spot:form1120:", form), F.when(statement.isNotNull(), F.concat_ws(":", F.lit("spot"), join("stmt", statement), name)),
        join("cat:", category), join("label:", name),
    )


def source_rank(source: Column) -> Column:
    """Form lines, then worksheet rows, then detail, then the rest."""
    return F.when(source.rlike(r"(?i)comparison\s*\([^)]+row\)"), 2).when(source.rlike(r"(?i)form\s*1120|form\s*1125"), 3).when(source.rlike(DETAIL), 1).otherwise(0)


#: What a caption and its source say by themselves, by bits of ``marks``.
MARKS = (
    "detail", "officer_form", "insured", "officer_row", "doubled", "instruction", "crumb", "boilerplate", "unknown_row", "structure", "excluded", "benefit_row", "rest_only", "page_one", "good", "read",
    "any_row", "scan", "form", "plain", "utilities_word", "itemized", "word", "repairs_listed", "listed", "roll_up", "payment", "employer", "footer", "anchor", "pay", "columns", *[f for f, _ in ANCHORS],
)


def marked(name: str, marks: Column | None = None) -> Column:
    return (F.col("marks") if marks is None else marks).bitwiseAND(F.lit(1 << MARKS.index(name)).cast("long")) != 0


def captions(lines: DataFrame) -> DataFrame:
    """(label, source, category, text, row, noise, name, rank, marks): each caption with its source, judged once.

    ``text`` is the repaired label, ``row`` the row's own number, ``name`` the
    group, ``rank`` that of the source and ``marks`` all that is yes or no.
    """
    rows = lines.select("label", "source").distinct().withColumn("category", L.expense_category(F.col("label"))).withColumn("text", repaired(F.col("label")))
    label, raw, source, category = F.col("text"), F.col("label"), F.col("source"), F.col("category")
    detail, any_row, row = source.rlike(STATEMENT_DETAIL), source.rlike(ANY_ROW), source.rlike(ROW)
    bad = is_anchor(raw) | raw.rlike(TITLE) | is_cross_reference(raw) | is_structural_noise(raw, source) | source.rlike(r"(?i)comparison_raw|comparison_deduction_schedule")
    flags = {
        "detail": detail, "officer_form": (category == "officer_compensation") & source.rlike(r"(?i)form\s*1120\s*line\s*12|form\s+1125|1125-?e|federal\s+statements\s+table"), "insured": label.rlike(r"(?i)^insurance\b") & detail,
        "officer_row": source.rlike(r"(?i)\(officer_compensation\s+row\)"), "doubled": label.rlike(r"(?i)employee\s+benefit") & ~any_row & source.rlike(r"(?i)form\s*1120|form\s+attachment|line\s*24"),
        "instruction": is_instruction(raw, source), "crumb": source.contains(CRUMB), "boilerplate": ~detail | is_footer(label) | label.rlike(TITLE), "unknown_row": any_row & ~row & ~source.rlike(r"(?i)\(raw\s+row\)"),
        "structure": is_structural_noise(label, source), "excluded": is_excluded_source(label, source, category), "benefit_row": source.rlike(r"(?i)\([a-z_]+\s+row\)") & label.rlike(r"(?i)employee\s+benefit"),
        "rest_only": source.rlike(rf"{ITEMIZED}|federal\s+statements\s+table") & label.rlike(REST_ONLY) & ~label.rlike(TOP_ROWS), "page_one": label.rlike(PAGE_ONE), "good": ~bad, "read": ~(source.rlike(CAPS) & category.isNull()),
        "any_row": any_row, "scan": source.rlike(SCAN), "form": source.rlike(r"(?i)form\s*1120[-\s]?[sb]?\s*line\s*\d|form\s*1125"), "plain": raw.rlike(r"(?i)^utilities\b"), "utilities_word": (category == "utilities") & raw.rlike(r"(?i)^utilities\b"),
        "itemized": source.rlike(ITEMIZED), "word": raw.rlike(EXPENSE_WORD) & ~is_anchor(raw), "repairs_listed": source.rlike(r"(?i)form\s*1120|statement\s*\d|stmt\s*\d"), "listed": source.rlike(r"(?i)statement\s*\d|stmt\s*\d|form\s+attachment"),
        "roll_up": (category == "taxes_licenses") & ~raw.rlike(r"(?i)payroll|sales\s+and\s+use"), **caption_says(label, source),
    }
    marks = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(flags[k], F.lit(False)), F.lit(1 << i)).otherwise(0).cast("long") for i, k in enumerate(MARKS)])
    return rows.select("label", "source", "category", "text", crumb_row(raw, source).alias("row"), noise(label, source).alias("noise"), group_key(raw, source, category).alias("name"), source_rank(source).alias("rank"), marks.alias("marks"))


def better(a: Column, b: Column) -> Column:
    """Whether reading ``a`` takes the place of ``b``: rows before scans, form lines before rows, plain utilities, then quality."""
    row, scan, form, plain = ((lambda x, k=k: marked(k, x["marks"])) for k in ("any_row", "scan", "form", "plain"))
    return (
        F.when(row(a) & scan(b), True).when(scan(a) & row(b), False).when(form(a) & row(b) & a["category"].isNotNull(), True).when(row(a) & form(b) & b["category"].isNotNull(), False)
        .when((plain(a) != plain(b)) & F.coalesce(a["category"] == "utilities", F.lit(False)), plain(a)).otherwise(a["quality"] > b["quality"])
    )


def with_slots(lines: DataFrame, slots: DataFrame, sheet: Sequence[str], titles: Mapping[str, str]) -> DataFrame:
    """Pool lines with those that the sheet's own slots stand for.

    ``slots`` is (sheet, field_id, value, source); of fields without a title
    none comes in.  Slots come after all lines, in the order of ``titles``.
    """
    value = A.whole(F.abs(F.col("value").cast("double")))
    at = F.create_map(*[F.lit(x) for i, f in enumerate(titles) for x in (f, i)]).cast("map<string, int>")
    title = F.create_map(*[F.lit(x) for f, t in titles.items() for x in (f, t)]).cast("map<string, string>")
    fits = said(F.col("source")).rlike(SLOT_SOURCE) & keepable(value) & title[F.col("field_id")].isNotNull()
    own = slots.where(fits).select(*sheet, (F.lit(1 << 40) + at[F.col("field_id")]).alias("ord"), title[F.col("field_id")].alias("label"), value.alias("amount"), said(F.col("source")).alias("source"))
    return lines.select(*sheet, F.col("ord").cast("long").alias("ord"), F.coalesce("label", F.lit("")).alias("label"), "amount", said(F.col("source")).alias("source")).unionByName(own)


def judged(lines: DataFrame, sheet: Sequence[str], year: Column, anchors: Mapping[str, Column]) -> DataFrame:
    """Pool lines with group, quality, ``rest`` (for the remainder only) and ``reason``, why a line does not count.

    The lines have what ``captions`` says of them.
    """
    w = Window.partitionBy(*sheet)
    rows = lines.withColumn("amount", A.whole(F.abs(F.col("amount").cast("double"))))
    category, amount, fine, own = F.col("category"), F.col("amount"), F.col("__fine"), marked("crumb")
    rows = rows.withColumn("__fine", keepable(amount))
    # what other lines of the sheet say
    officer = F.array_agg(F.when(marked("officer_form") & fine, amount)).over(w)
    rows = rows.withColumns({"__officer": officer, "__insured": F.max(F.when(marked("insured") & fine, 1)).over(w)})
    discredited = marked("officer_row") & F.exists("__officer", lambda v: v != amount)
    doubled = marked("doubled") & F.col("__insured").isNotNull()
    crumb = F.coalesce((amount == year) | (amount == year % 100), F.lit(False)) | own | F.coalesce(amount == F.col("row"), F.lit(False)) | marked("instruction")
    rows = rows.withColumns({"__doubled": doubled, "__crumb": crumb})
    doubled, crumb = F.col("__doubled"), F.col("__crumb")
    says = {k: marked(k) for k in ("payment", "employer", "footer", "anchor", "pay", "columns", *[f for f, _ in ANCHORS])}
    reason = (
        F.when(F.col("replaced"), "replaced by a split").when(~fine, "no amount").when(crumb & ~own, F.when(marked("boilerplate"), "crumb"))
        .when(~own, F.coalesce(
            illogical(F.col("text"), amount, dict(anchors), says=says), F.when(marked("unknown_row"), "unknown row"), F.when(marked("structure"), "structure"),
            F.when(marked("excluded"), "source"), F.col("noise"), F.when(discredited, "other officer total"),
            F.when(~doubled & ~marked("page_one") & marked("benefit_row") & (F.length(amount.cast("string")) == 7), "employer number"),
            F.when(~doubled & ~marked("page_one") & marked("rest_only"), "rest of the statement"),
        ))
    )
    rest = fine & (own | crumb | doubled | marked("page_one"))
    rows = rows.withColumn("reason", reason).withColumn("rest", F.coalesce(rest, F.lit(False)) & F.col("reason").isNull())
    rows = rows.withColumn("source", F.when(F.col("rest") & ~own, F.concat_ws(" ", F.coalesce(F.nullif("source", F.lit("")), F.lit("expense")), F.lit(CRUMB))).otherwise(F.col("source")))
    quality = F.struct(marked("good").cast("int").alias("good"), "rank", category.isNotNull().cast("int").alias("known"), marked("read").cast("int").alias("read"), "amount")
    return rows.withColumn("key", F.coalesce("name", F.concat(F.lit("raw:"), amount.cast("string")))).withColumn("quality", F.when(F.col("reason").isNull(), quality)).drop("text", "row", "noise", "name", "rank", "__fine", "__officer", "__insured", "__doubled", "__crumb")


def best_of_groups(rows: DataFrame, sheet: Sequence[str]) -> DataFrame:
    """Lines without a reason that are not the best of their group get one: plain utilities, then quality, of equal ones the first.

    ``ord`` of the best line becomes that of the group's first line.  Other
    lines keep their reason, and no line is left out.
    """
    live = F.col("reason").isNull()
    rows = rows.withColumn("__order", F.when(live, F.struct(marked("utilities_word").cast("int").alias("plain"), "quality", (-F.col("ord")).alias("ord"), F.struct("label", "amount", "source").alias("line"))))
    w = Window.partitionBy(*sheet, "key")
    rows = rows.withColumns({"__best": F.max("__order").over(w), "__ord": F.min(F.when(live, F.col("ord"))).over(w)})
    best = F.col("__order").eqNullSafe(F.col("__best"))
    rows = rows.withColumn("reason", F.when(live & ~best, "another line of its group").otherwise(F.col("reason")))
    return rows.withColumn("ord", F.when(F.col("reason").isNull(), F.col("__ord")).otherwise(F.col("ord"))).drop("__order", "__best", "__ord")


def override_passes(groups: DataFrame, sheet: Sequence[str], taxes: Column) -> DataFrame:
    """The rewrite passes over a sheet's groups, in order; ``reason`` names the pass that drops a line.

    Lines that have a reason before take no part and keep it.

    1. A category's line and its worksheet row become one, under the row.
    2. A scan's repairs go where a form or statement has some.
    3. A statement's rent goes where a worksheet or form has one.
    4. Pay on a form's line drops statements of the same pay; against rows and categories the better stays.
    5. Rent and taxes on a form's line drop rows and categories.
    6. Statement detail against rows and categories: the better stays.
    7. Taxes become the sheet's own amount (``taxes``), in one line.

    A key has one live line.  Passes 3 to 5 drop no line of a form but their
    own, so all their references are found by one window before them; the
    contests of pass 6 are of different lines each, and one of them.
    """
    w = Window.partitionBy(*sheet)
    line = F.struct("key", "amount", "category", "quality", "ord", "marks")
    key, category = F.col("key"), F.col("category")
    alive = F.col("reason").isNull()
    rows = groups

    def drop(rows: DataFrame, test: Column, name: str) -> DataFrame:
        return rows.withColumn("reason", F.when(alive & F.coalesce(test, F.lit(False)), name).otherwise(F.col("reason")))

    def first(test: Column, over=w, value: Column = line) -> Column:
        return F.max_by(value, F.when(alive & F.coalesce(test, F.lit(False)), -F.col("ord"))).over(over)

    def there(test: Column) -> Column:
        return F.max(F.when(alive & F.coalesce(test, F.lit(False)), True)).over(w)

    def contest(rows: DataFrame, ref: str, others: Column, name: str, over=w) -> DataFrame:
        """Lines that the reference beats go; it goes itself if one is not beaten."""
        ref_key = F.col(f"{ref}.key")
        other = F.coalesce(alive & others & (key != ref_key) & F.col(ref).isNotNull(), F.lit(False))
        rows = rows.withColumn("__beaten", F.when(other, better(F.col(ref), line)))
        rows = rows.withColumn("__unbeaten", F.max(F.when(~F.col("__beaten"), True)).over(over))
        lost = F.coalesce((key == ref_key) & F.col("__unbeaten"), F.lit(False))
        return drop(rows, F.col("__beaten") | lost, name).drop(ref, "__beaten", "__unbeaten")

    of = Window.partitionBy(*sheet, F.when(key.rlike("^(cat|row):"), F.substring_index("key", ":", -1)).otherwise(key))
    rows = rows.withColumns({"__row": first(key.startswith("row:"), of), "__cat": first(key.startswith("cat:"), of)})
    both = F.col("__row").isNotNull() & F.col("__cat").isNotNull()
    take = ((F.col("__row.amount") != F.col("__cat.amount")) & marked("itemized", F.col("__cat.marks")) & marked("any_row", F.col("__row.marks")) & marked("word", F.col("__cat.marks"))) | better(F.col("__cat"), F.col("__row"))
    rows = rows.withColumn("__take", F.when(both & alive, take))
    moved = F.coalesce(F.col("__take") & key.startswith("cat:"), F.lit(False))
    rows = drop(rows, (F.col("__take") & key.startswith("row:")) | (~F.col("__take") & key.startswith("cat:")), "merged into its row")
    rows = rows.withColumn("ord", F.when(moved, F.col("__row.ord")).otherwise(F.col("ord"))).withColumn("key", F.when(moved, F.col("__row.key")).otherwise(key)).drop("__row", "__cat", "__take")

    rows = drop(rows.withColumn("__ref", first((category == "repairs") & marked("repairs_listed"), value=key)), (category == "repairs") & marked("scan") & (key != F.col("__ref")), "repairs of a scan").drop("__ref")
    pay = (("7", "officer_compensation"), ("8", "salaries_wages"), ("12", "officer_compensation"), ("13", "salaries_wages"))
    form = (("11", "rent", None), ("12", "taxes_licenses", None), ("16", "rent", ("row:rent", "cat:rent")))
    at = lambda spot, cat: (key == f"spot:form1120:{spot}") & (category == cat)
    rows = rows.withColumns({"__rent": there(key.isin("row:rent", "spot:form1120:16")), **{f"__pay{s}": first(at(s, c)) for s, c in pay}, **{f"__form{s}": there(at(s, c)) for s, c, _ in form}})
    rows = drop(rows, F.col("__rent") & key.isin("cat:rent", "spot:stmt2:rent"), "rent of a statement").drop("__rent")
    for spot, cat in pay:
        same = F.coalesce(((category == cat) | key.endswith(f":{cat}")) & ~key.startswith("spot:form1120:"), F.lit(False))
        rows = drop(rows, F.col(f"__pay{spot}").isNotNull() & same & marked("listed"), "pay of a statement")
        rows = contest(rows, f"__pay{spot}", same & ~marked("listed") & key.isin(f"row:{cat}", f"cat:{cat}"), "pay of a form's line")
    for spot, cat, names in form:
        same = key.isin(*names) if names else key.rlike("^(row|cat):") & ((category == cat) | key.isin(f"row:{cat}", f"cat:{cat}"))
        rows = drop(rows, F.col(f"__form{spot}") & same, "form's line").drop(f"__form{spot}")
    cats = ("bank_credit_card", "professional_fees", "utilities", "insurance", "officer_compensation", "salaries_wages")
    listed, other = key.startswith("spot:stmt") & category.isin(*cats), key.isin(*[f"{x}:{c}" for c in cats for x in ("row", "cat")])
    group = Window.partitionBy(*sheet, F.when(listed, category).when(other, F.substring_index("key", ":", -1)))
    rows = contest(rows.withColumn("__ref", first(listed, group)), "__ref", other, "statement detail", group)
    known = keepable(taxes)
    mine = F.coalesce(category == "taxes_licenses", F.lit(False))
    rows = rows.withColumn("__taxes", F.when(known, taxes))
    rows = rows.withColumns({"__same": first(mine & (F.col("amount") == F.col("__taxes")), value=key), "__any": first(mine, value=key)})
    rows = drop(rows, mine & F.col("__taxes").isNotNull() & (key != F.coalesce("__same", "__any")), "other taxes")
    amount = F.when(alive & mine & F.col("__taxes").isNotNull(), F.col("__taxes")).otherwise(F.col("amount"))
    return rows.withColumn("amount", amount).drop("__same", "__any", "__taxes")


def rank_pool(lines: DataFrame, slots: DataFrame, sheet: Sequence[str], year: str, titles: Mapping[str, str]) -> DataFrame:
    """(sheet, ord, key, label, amount, source, rest, reason): the pool of each sheet, and why every other line is not in it.

    Lines in the pool have no reason.  ``slots`` are the sheet's own values
    (sheet, field_id, value, source); sales, cogs, fixed assets, inventory and
    pay are what a line is held against, taxes only from a source that can be
    trusted.  Repeated lines are one reading; lines without an amount, and null
    labels and sources, have their reasons like others.  The
    captions' marks are kept in the session's cache, whose size says how they
    are joined.
    """
    of = lambda f: F.max(F.when(F.col("field_id") == f, F.col("value")))
    anchors = ("sales", "cogs", "gross_fixed_assets", "inventory", "officer_compensation", "salaries_wages")
    tax, value = F.col("field_id") == "taxes_licenses", A.whole(F.abs(F.col("value").cast("double")))
    split = F.when(tax & said(F.col("source")).rlike(TAX_SPLIT) & keepable(value), value)
    wide = slots.groupBy(*sheet).agg(*[of(f).alias(f"__{f}") for f in anchors], F.max(F.when(tax & said(F.col("source")).rlike(TAX_SOURCE), value)).alias("__taxes"), F.min(split).alias("__least"), F.max(split).alias("__most"))
    rows = with_slots(lines, slots, sheet, titles)
    marks = captions(rows).cache()
    marks.count()
    rows = spread(rows, *sheet).groupBy(*sheet, "label", "amount", "source").agg(F.min("ord").alias("ord")).join(marks, ["label", "source"], "left").join(wide, list(sheet), "left")
    # a total of taxes that a split stands for
    amount = A.whole(F.abs(F.col("amount").cast("double")))
    rows = rows.withColumn("replaced", F.coalesce(marked("roll_up") & ((amount != F.col("__least")) | (amount != F.col("__most"))), F.lit(False))).drop("__least", "__most")
    rows = best_of_groups(judged(rows, sheet, F.col(year), {f: F.col(f"__{f}") for f in anchors}), sheet)
    return override_passes(rows, sheet, F.col("__taxes")).select(*sheet, "ord", "key", "label", "amount", "source", "rest", "reason")


def partition_rest(pool: DataFrame, tops: DataFrame, totals: DataFrame, sheet: Sequence[str]) -> DataFrame:
    """(sheet, total, inside, rest, source): what is left of the printed total outside the top rows.

    ``pool`` is (sheet, label, amount, source), ``tops`` (sheet, amount) the
    top rows and ``totals`` (sheet, total).  Amortization leaves the total
    first; a statement's line counts as inside if its amount is a top row's,
    each amount once.  Without a total, or where more is inside than it has,
    the rest is the pool without the top rows.  It is never below 0.  All three
    are brought together by unions, which leave inputs that were dealt by the
    same keys where they lie.
    """
    label, source, amount = blanks(F.col("label")), said(F.col("source")), F.col("amount")
    detail = source.rlike(STATEMENT_DETAIL)
    written_off = label.rlike(r"(?i)^amortization\b")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in sheet])
    top = tops.where(keepable(F.col("amount")) & known).select(*sheet, "amount", F.lit(1).alias("top"))
    counted = pool.select(*sheet, "amount", (detail & written_off & (amount > 99) & ((amount != 100) | source.rlike(r"(?i)form\s*4562")) & keepable(amount)).alias("off"), (detail & ~written_off).alias("in"), F.lit(1).alias("n"))
    distinct = counted.unionByName(top, allowMissingColumns=True).groupBy(*sheet, "amount").agg(F.max("off").alias("off"), F.max("in").alias("in"), F.count("n").alias("n"), F.count("top").alias("top"))
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("amount"))), F.lit(0))
    sums = distinct.groupBy(*sheet).agg(of(F.col("off")).alias("__off"), of(F.col("in") & (F.col("top") > 0)).alias("inside"), F.sum(F.when(F.col("n") > 0, F.col("amount") * F.col("n"))).alias("__pool"), F.sum(F.col("amount") * F.col("top")).alias("__tops"), F.max(F.when(F.col("n") > 0, 1)).alias("__there"))
    both = sums.unionByName(totals.where(known).select(*sheet, "total"), allowMissingColumns=True)
    rows = both.groupBy(*sheet).agg(*[F.max(c).alias(c) for c in ("__off", "inside", "__pool", "__tops", "__there", "total")]).where("__there = 1")
    rows = rows.withColumn("total", F.when(F.col("total").isNotNull(), F.greatest(F.lit(0), F.col("total") - F.col("__off"))))
    split = keepable(F.col("total")) & keepable(F.col("inside")) & (F.col("total") >= F.col("inside"))
    rest = F.when(split, F.col("total") - F.col("inside")).otherwise(F.greatest(F.lit(0), F.col("__pool") - F.coalesce("__tops", F.lit(0))))
    said_ = F.when(split, "Operating expenses (stmt total − stmt lines in top-8)").otherwise("Operating expenses residual (sum(pool) − sum(top-8))")
    return rows.select(*sheet, "total", "inside", rest.alias("rest"), said_.alias("source"))
