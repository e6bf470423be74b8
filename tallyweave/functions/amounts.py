"""Money amounts inside text lines, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gates import Text

# Numbers on a line that name a form and are no amounts.
FORM_NUMBERS = (1040, 1099, 1120, 1125, 4562, 8990, 3800, 7004, 2220)
# Amounts in this range are years, not dollars.
FIRST_YEAR, LAST_YEAR = 1990, 2035
# An amount has nine digits at most.
MOST_DIGITS = 9

# How amounts look on a line: grouped by commas or stops, grouped by blanks (not right after "line"), plain.
RUN = r"(?i)\d{1,3}(?:[.,]\d{3})+(?:\.\d{2})?|(?<!line\s)\d{1,3}(?:\s+\d{3})+(?:\.\d{2})?|\d[\d,]{1,}(?:\.\d{2})?"
# The same with short cells that end in a stop (``8.``), as attachments print them.
CELL = r"(?i)\d{1,3}(?:[.,]\d{3})+(?:\.\d{2})?|(?<!line\s)\d{1,3}(?:\s+\d{3})+(?:\.\d{2})?|\d{1,7}\.(?!\d)|\d[\d,]{1,}(?:\.\d{2})?"
# A blank after a thousands comma, as in ``2,539, 740``.
SPLIT_GROUP = r"(\d{1,3}(?:,\d{3})*),\s+(\d{3})\b"
# Where a row's own number, and numbers of rows, pages and statements, stand.
LEADING = r"(?i)^\s*[\W_]*(\d{1,2})(?:[a-z])?(?=\s|[_\]\[|.:])"
REFERENCES = (r"(?i)\[\s*(\d{1,3})[a-z]?(?=\s*[|\]])", r"(?i)\|\s*(\d{1,3})[a-z]?\s*(?=[_|])", r"(?i)\bline\s*(\d{1,3})\b", r"(?i)\bpage\s*(\d{1,3})\b", r"(?i)\b(?:stat(?:ement)?|stmt)\s*(\d{1,3})\b")
GLUED = r"(?i)^\s*[\W_]*(\d{3,})\s+(?=[a-z])"
BRACKETED = r"\[\s*(\d{1,3})\s*\]"
ROW_NUMBERS = r"(?i)(?:^\s*[\W_]*|\[|\bline\s*)(\d{1,3})(?=\s|[_\]\[|.:,])"
# Employer numbers, whole or cut.
EIN = (r"\b\d{1,2}\s*[-–—]\s*\d{7}\b", r"\b-?\d{7}\b")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def whole(amount: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(amount + F.lit(0.5)).cast("long")


def all_of(line: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(line, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def last(tokens: Column) -> Column:
    return let(tokens, lambda t: F.get(t, F.size(t) - 1))


def parse_money(text: Column) -> Column:
    """A whole amount; null for blanks, a dash and what is no number.

    Currency signs and commas go; stops before groups of three digits are
    separators; an amount in brackets is negative, and halves go upwards.
    """
    number = lambda s: F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s).try_cast("double")

    def of(bare: Column) -> Column:
        stops = bare.rlike(r"^\d{1,3}(\.\d{3})+(?:\.\d{2})?$")
        bracketed = F.startswith(bare, F.lit("(")) & F.endswith(bare, F.lit(")"))
        return whole(F.when(bracketed, -number(F.trim(F.regexp_replace(bare, r"^\(|\)$", "")))).when(stops, F.replace(bare, F.lit("."), F.lit("")).try_cast("double")).otherwise(number(bare)))

    return let(F.trim(F.regexp_replace(F.trim(text), r"[$,]", "")), of)


def grouped_by_blanks(text: Column) -> Column:
    """``12 345`` as 12345; null for anything else."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^\d{1,3}(\s+\d{1,3})+$"), F.regexp_replace(bare, r"\s+", "")).try_cast("long")


def amount_of(run: Column) -> Column:
    return F.coalesce(parse_money(run), grouped_by_blanks(run))


def is_form_number(amount: Column) -> Column:
    return F.abs(amount).isin(*FORM_NUMBERS)


def is_year(amount: Column) -> Column:
    return F.abs(amount).between(FIRST_YEAR, LAST_YEAR)


def is_reasonable(amount: Column) -> Column:
    """Longer digit runs are amounts glued together."""
    return F.abs(amount) < 10**MOST_DIGITS


def digits(run: Column) -> Column:
    return F.length(F.regexp_replace(run, r"\D", ""))


def run_amount(run: Column) -> Column:
    """``amount_of`` a run; digits and commas alone, few enough for a double to hold, need no pattern."""
    plain = (F.length(run) <= 15) & ~F.contains(run, F.lit(".")) & ~F.contains(run, F.lit(" "))
    return F.coalesce(F.when(plain, F.replace(run, F.lit(","), F.lit("")).try_cast("long")), amount_of(run))


def number(found: Column) -> Column:
    """The whole number that a pattern's group found; null where it found none."""
    return let(found, lambda x: F.when(x != "", x.cast("long")))


def money_tokens(line: Column, least_digits: int = 2) -> Column:
    """All amounts of a line from left to right, without form numbers."""
    runs = all_of(F.regexp_replace(line, SPLIT_GROUP, "$1,$2"), RUN)
    if least_digits == 2:  # only a digit and commas have fewer
        runs = F.filter(runs, lambda r: F.length(F.replace(r, F.lit(","), F.lit(""))) >= 2)
    elif least_digits > 2:
        runs = F.filter(runs, lambda r: digits(r) >= least_digits)
    return F.filter(F.transform(runs, run_amount), lambda v: v.isNotNull() & ~is_form_number(v))


def leading_number(line: Column) -> Column:
    """The row number that a line begins with."""
    return number(F.regexp_extract(line, LEADING, 1))


def holds(line: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern is in a line; looked for only where ``low`` (the line in lower case) has a piece that it needs."""
    return F.coalesce(Text(line, low).rlike(pattern), F.lit(False))


def numbers_where(line: Column, pattern: str) -> Column:
    return F.transform(all_of(line, pattern, 1), lambda x: x.cast("long"))


def references(line: Column) -> Column:
    """Numbers that refer to rows, lines, pages or statements rather than amounts."""
    lead = F.array(leading_number(line))
    every = F.array_distinct(F.array_compact(F.concat(lead, *[numbers_where(line, p) for p in REFERENCES])))
    there = lambda low: reduce(Column.__or__, [holds(line, low, p) for p in REFERENCES])
    return F.when(let(F.lower(line), there), every).otherwise(F.array_compact(lead))


def substantial_tokens(line: Column) -> Column:
    """The amounts of a line that refer to nothing."""

    def without(found: Column) -> Column:
        refs, glued = found["refs"], found["glued"]
        own = lambda v: (F.abs(v) == glued) & F.exists(refs, lambda r: F.endswith(F.abs(v).cast("string"), r.cast("string")))
        return F.filter(money_tokens(line, 1), lambda v: ~F.array_contains(refs, F.abs(v)) & ~F.coalesce(own(v), F.lit(False)))

    glued = number(F.regexp_extract(line, GLUED, 1))
    return let(references(line), lambda refs: F.when(F.size(refs) == 0, money_tokens(line, 1)).otherwise(let(F.struct(refs.alias("refs"), glued.alias("glued")), without)))


amounts = substantial_tokens


def attachment_tokens(line: Column) -> Column:
    """Amounts of an attachment's line, short cells with a stop included; all of them if only the row number is left."""
    short = lambda r: F.trim(r).rlike(r"^\d{1,7}\.$")
    runs = F.filter(all_of(F.regexp_replace(line, SPLIT_GROUP, "$1,$2"), CELL), lambda r: short(r) | (digits(r) >= 2))
    values = F.filter(F.transform(runs, amount_of), lambda v: v.isNotNull() & ~is_form_number(v) & ~is_year(v))

    def but_own(found: Column) -> Column:
        rest = F.filter(found, lambda v: F.abs(v) != leading_number(line))
        return F.when(leading_number(line).isNotNull() & (F.size(rest) > 0), rest).otherwise(found)

    return let(values, but_own)


def tail_amount(line: Column) -> Column:
    """The rightmost amount; none if the line holds but its own number."""

    def of(tokens: Column) -> Column:
        sizes = F.array_distinct(F.transform(tokens, F.abs))
        own = F.coalesce(leading_number(line) == F.get(sizes, 0), F.lit(False)) | (F.contains(line, F.lit("[")) & F.array_contains(numbers_where(line, BRACKETED), F.get(sizes, 0)))
        return F.when((F.size(sizes) == 1) & F.coalesce(own, F.lit(False)), F.lit(None).cast("long")).otherwise(last(tokens))

    return let(money_tokens(line), of)


def schedule_amount(line: Column) -> Column:
    """The rightmost substantial amount; before a closing 0 on lines of accumulated depreciation."""

    def of(t: Column) -> Column:
        less = (F.size(t) >= 2) & (last(t) == 0) & line.rlike(r"(?i)less\s+accumulated\s+depreciation")
        return F.when(less, F.get(t, F.size(t) - 2)).otherwise(last(t))

    return let(substantial_tokens(line), of)


def tagged_amount(line: Column, tag: str) -> Column:
    """The amount after a bracketed tag such as ``[1c]``."""
    raw = F.trim(F.nullif(F.regexp_extract(line, rf"(?i)\[\Q{tag}\E\][^\d]{{0,48}}([\d\s,'\.]+)", 1), F.lit("")))
    good = lambda v: F.when(is_reasonable(v) & ~is_form_number(v), v)
    bare = F.regexp_replace(raw, r"\D", "")
    return F.coalesce(good(amount_of(raw)), good(F.when(F.length(bare) >= 4, bare).try_cast("long")))


def form_amount(line: Column, tag: str) -> Column:
    return F.coalesce(tagged_amount(line, tag), schedule_amount(line), tail_amount(line))


def only_amount(tokens: Column) -> Column:
    """The amount of a line that has exactly one."""
    return let(tokens, lambda t: F.when(F.size(t) == 1, F.get(t, 0)))


def single_amount(line: Column, tag: str | None = None) -> Column:
    """The tagged amount, or that of a line with exactly one: several are columns run together."""
    only = only_amount(substantial_tokens(line))
    return F.coalesce(tagged_amount(line, tag), only) if tag else only


def last_amount(tokens: Column) -> Column:
    return last(tokens)


def largest_amount(tokens: Column) -> Column:
    """The amount of largest magnitude, sign kept; of equal ones the first."""

    def of(found: Column) -> Column:
        size = F.array_max(F.transform(found, F.abs))
        return F.get(F.filter(found, lambda v: F.abs(v) == size), 0)

    return let(tokens, of)


def keepable(amount: Column) -> Column:
    """Worksheet dollars: no form number, year or glued run."""
    return (F.abs(amount) >= 1) & is_reasonable(amount) & ~is_form_number(amount) & ~is_year(amount)


def keepable_tokens(line: Column) -> Column:
    """Substantial amounts of a worksheet line; a printed row number counts only beside another amount."""

    def but_rows(found: Column) -> Column:
        rows, every = found["rows"], found["every"]
        return F.filter(substantial_tokens(line), lambda n: keepable(n) & (~F.array_contains(rows, F.abs(n)) | F.exists(every, lambda t: F.abs(t) != F.abs(n))))

    def of(rows: Column) -> Column:
        every = F.filter(money_tokens(line), keepable)
        return F.when(F.size(rows) == 0, F.filter(substantial_tokens(line), keepable)).otherwise(let(F.struct(rows.alias("rows"), every.alias("every")), but_rows))

    return let(F.transform(all_of(line, ROW_NUMBERS, 1), lambda x: x.cast("long")), of)


def is_row(line: Column, n: int) -> Column:
    """Whether a form line has row number ``n`` in its head, with one digit of bleed at most."""
    head = F.substring(line, 1, 35)
    at = F.regexp_instr(head, F.lit(rf"(?i)(?<![\d.])\[?{n}(?:\](?!\d)|\b(?!\d))"))
    lead = F.regexp_extract(head, r"^(\d{1,3})\b", 1)
    return at.between(1, 31) | (lead == str(n)) | ((F.length(lead) == len(str(n)) + 1) & F.endswith(lead, F.lit(str(n))))


def without_ein(line: Column) -> Column:
    """A line without employer numbers (``12-3456789``)."""
    return F.regexp_replace(F.regexp_replace(line, EIN[0], " "), EIN[1], " ")


def money_line(line: Column) -> Column:
    """The amount (a double) of a line that holds nothing else; null for percentages."""
    t = F.trim(line)
    bare = F.replace(F.regexp_replace(t, r"^\$", ""), F.lit(","), F.lit(""))
    bracketed = bare.rlike(r"^\(.*\)$")
    inner = F.trim(F.when(bracketed, F.regexp_replace(bare, r"^\(|\)$", "")).otherwise(bare))
    number = F.when(inner.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$") & ~F.endswith(t, F.lit("%")), inner).try_cast("double")
    return F.when(bracketed, -number).otherwise(number)


def percent_line(line: Column) -> Column:
    """A line's percentage as a ratio; a bare number from 0 to 100 is one too."""
    t = F.regexp_replace(F.trim(line), r"^\$", "")
    marked = F.replace(F.nullif(F.regexp_extract(t, r"(-?\d[\d,]*(?:\.\d+)?)\s*%", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    tight = F.regexp_replace(t, r"\s", "")
    bare = F.when(tight.rlike(r"^\(?-?\d[\d,]*(?:\.\d+)?\)?$"), F.regexp_replace(tight, r"[(),]", "")).try_cast("double")
    return F.when(t.rlike(r"\d\s*%"), marked / 100).otherwise(F.when(bare.between(0, 100), bare / 100))


def percents(line: Column) -> Column:
    """Percentages of a line as ratios; ``--`` stands for a missing one."""
    runs = F.regexp_extract_all(line, F.lit(r"(-?\d+(?:\.\d+)?)\s*%|--"), F.lit(0))
    return F.transform(runs, lambda r: F.round(F.regexp_replace(r, r"[%\s]", "").try_cast("double") / 100, 6))
