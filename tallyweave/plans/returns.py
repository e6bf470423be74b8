"""Queries over sheets of fields and years: tokens, formulas, sources, agreement, candidates, rule tables.

The tables have no such sheets, so each query builds its lines or cells from
whole tables first; the SQL twins say what has to come out by other means
(the numbers that a line was made of, a table of what each source is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, labels
from ..functions.amounts import whole
from ..operators import candidates, compare, formulas, rules, trust
from .registry import query, spread, table

FIELDS = ("sales", "cogs", "rent", "depreciation", "amortization", "officer_compensation", "salaries_wages", "advertising", "taxes_licenses", "bank_credit_card", "professional_fees", "utilities", "interest_expense", "taxes_paid", "other_income", "other_operating_expenses", "cash", "accounts_receivable", "inventory", "other_current_assets", "gross_fixed_assets", "accumulated_depreciation", "accumulated_amortization", "other_assets", "accounts_payable", "short_term_debt", "other_current_liabilities", "notes_minus_short_term", "common_stock", "other_stock_equity", "unclassified_equity")
SOURCES = ("Form 1120 page 1 block", "Two-year comparison (rent row)", "OCR label match", "Schedule L line 14", "Statement (line 18)", "Statement 2 (total minus util)", "Summed detail lines", "Structured financial report", "Coherence: cleared", "Operating expenses (top-8 slot 3)", "manual entry")
SNAP_FAMILIES = ("form", "comparison", "statement", "schedule-l", "ocr")


LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def sql_list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def pick(items: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), at.cast("int"))


#: What each source is: (weak, authoritative, residual, closes, subtractive, line 18, comparison, structured, coherence, expenses, family).
SOURCE_SQL = """src(i, weak, auth, resid, closes, subt, l18, comp, struc, coh, opx, fam) as (values
  (0, false, true, false, false, false, false, false, false, false, false, 'form'), (1, false, true, false, false, false, false, true, false, false, false, 'comparison'),
  (2, true, false, false, false, false, false, false, false, false, false, 'ocr'), (3, false, true, false, false, false, false, false, false, false, false, 'schedule-l'),
  (4, false, false, false, false, false, true, false, false, false, false, 'statement'), (5, false, true, false, false, true, false, false, false, false, false, 'statement'),
  (6, false, false, true, true, false, false, false, false, false, false, 'other'), (7, false, false, false, false, false, false, false, true, false, false, 'structured'),
  (8, false, false, false, false, false, false, false, false, true, false, 'other'), (9, false, false, false, false, false, false, false, false, false, true, 'other'),
  (10, false, false, false, false, false, false, false, false, false, false, 'other'))"""
CELLS_SQL = f"""raw as (select o_custkey as client, year(o_orderdate) as year, {sql_list(FIELDS)}[1 + (l_partkey * 3 + l_linenumber) % {len(FIELDS)}] as field_id,
  case when l_partkey % 7 = 0 then cast(l_quantity as bigint) else cast(floor(l_extendedprice + 0.5) as bigint) end as value, cast(55 + l_quantity % 45 as int) as conf, (l_suppkey + l_linenumber) % {len(SOURCES)} as i, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity from lineitem join orders on l_orderkey = o_orderkey),
cells as (select client, year, field_id, value, conf, i from (select *, row_number() over (partition by client, year, field_id order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) as rn from raw) where rn = 1),
snaps as (select distinct client, year, field_id, value as chosen, {sql_list(SNAP_FAMILIES)}[1 + (value + 2 * j) % 5] as family, value + case when (value // 10 + j) % 4 = 0 then 7 else 0 end as v from cells, range(0, 3) r(j) where (value + j) % 3 <> 0)"""
SUSPICIOUS_SQL = """(abs(value) in (1040, 1099, 1120, 1125, 4562, 8990, 3800, 7004, 2220) or abs(value) = year or abs(value) = year % 100 or abs(value) between 2020 and 2035 or (i = 3 and value = 14) or (i = 4 and value = 18)
  or (field_id in ('cogs', 'rent', 'sales', 'depreciation') and value between 1 and 99 and not auth) or (field_id = 'interest_expense' and value between 1 and 50)
  or (field_id in ('depreciation', 'amortization') and value in (1986, 1987))
  or (field_id in ('sales', 'cogs', 'rent', 'depreciation', 'amortization', 'officer_compensation', 'salaries_wages', 'advertising', 'taxes_licenses', 'gross_fixed_assets', 'accumulated_depreciation', 'accounts_receivable', 'cash', 'inventory', 'notes_minus_short_term', 'other_stock_equity') and value = 1)
  or (field_id in ('amortization', 'other_operating_expenses', 'accounts_payable', 'advertising', 'bank_credit_card', 'professional_fees', 'utilities', 'other_current_liabilities', 'short_term_debt', 'current_portion_ltd', 'other_current_assets', 'notes_minus_short_term', 'other_stock_equity', 'unclassified_equity') and value between 1 and 99)
  or (field_id = 'common_stock' and value between 1 and 99 and i <> 3) or (weak and abs(value) <= 99))"""


def cells(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """(client, year, field_id, value, confidence, source): the last line of each customer's year and field.

    Lines are dealt as numbers, by sheet or ``by`` less than that, and cells
    stay where they lie: what is grouped by sheet later needs no other shuffle.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("client"), F.year("o_orderdate").alias("year"))
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = spread(rows.select("client", "year", *LINE_KEYS, "l_extendedprice", "l_quantity"), *(by or ("client", "year")))
    field = ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % len(FIELDS)).alias("field")
    last = rows.groupBy("client", "year", field).agg(F.max(F.struct(*LINE_KEYS, "l_extendedprice", "l_quantity")).alias("w")).select("client", "year", "field", "w.*")
    value = F.when(F.col("l_partkey") % 7 == 0, F.col("l_quantity").cast("long")).otherwise(whole(F.col("l_extendedprice")))
    source = pick(SOURCES, (F.col("l_suppkey") + F.col("l_linenumber")) % len(SOURCES))
    return last.select("client", "year", pick(FIELDS, F.col("field")).alias("field_id"), value.alias("value"), (55 + F.col("l_quantity") % 45).cast("int").alias("confidence"), source.alias("source"))


def snapshots(rows: DataFrame) -> DataFrame:
    """Up to three reads of each cell, some of them off by 7."""
    j = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")
    s = rows.select("client", "year", "field_id", F.col("value").alias("chosen"), j).where((F.col("chosen") + F.col("j")) % 3 != 0)
    off = F.when((F.floor(F.col("chosen") / 10) + F.col("j")) % 4 == 0, 7).otherwise(0)
    s = s.select("client", "year", "field_id", pick(SNAP_FAMILIES, (F.col("chosen") + 2 * F.col("j")) % 5).alias("family"), (F.col("chosen") + off).alias("value"), F.lit(80).alias("confidence"), F.lit(None).cast("string").alias("label"))
    return trust.distinct_snapshots(s, ["client", "year"])


@query("""
with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey + l_linenumber) % 6 as k, cast(floor(l_extendedprice + 0.5) as bigint) as p from lineitem),
f as (select *, case when p in (1040, 1099, 1120, 1125, 4562, 8990, 3800, 7004, 2220) then [] else [p] end as amount from r)
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  array_to_string(case when k = 1 then list_concat([20 + l_linenumber], amount) when k = 5 then list_concat([12], amount, amount, [500]) else amount end, ' ') as tokens,
  array_to_string(case when k = 5 then list_concat(amount, amount, [500]) else amount end, ' ') as substantial,
  case when k = 5 then 500 else list_last(case when k = 1 then list_concat([20 + l_linenumber], amount) else amount end) end as tail
from f
""")
def money_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "lineitem").select(*LINE_KEYS, whole(F.col("l_extendedprice")).alias("p"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).alias("k")))
    comma, n = F.format_number("p", 0), F.col("l_linenumber").cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    line = (
        F.when(F.col("k") == 0, say(n, " Compensation of officers ", comma))
        .when(F.col("k") == 1, say("LINE 2", n, " ", comma))
        .when(F.col("k") == 2, say("Form 1120 line 8 total ", F.translate(comma, ",", ".")))
        .when(F.col("k") == 3, say("Rent paid ", F.translate(comma, ",", " ")))
        .when(F.col("k") == 4, say(n, " Total deductions (", comma, ") | 7 |_"))
        .otherwise(say("Statement 3 [12] ", comma, " change ", F.regexp_replace(comma, ",", ", "), "; 500.00"))
    )
    rows = rows.withColumn("line", line)
    show = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return rows.select(*LINE_KEYS, show(amounts.money_tokens(F.col("line"), 2)).alias("tokens"), show(amounts.substantial_tokens(F.col("line"))).alias("substantial"), amounts.tail_amount(F.col("line")).alias("tail"))


def _formula_sql() -> str:
    n = lambda *fs: " + ".join(f"coalesce({f}, 0)" for f in fs)
    some = lambda *fs: "coalesce(" + ", ".join(fs) + ") is not null"
    inputs = sorted({t for f in formulas.WORKBOOK for t in (*f.plus, *f.minus)} - {f.name for f in formulas.WORKBOOK})
    slots = ("officer_compensation", "salaries_wages", "advertising", "rent", "taxes_licenses", "bank_credit_card", "professional_fees", "utilities")
    pivot = ", ".join(f"max(value) filter (field_id = '{f}') as {f}" for f in inputs)
    return f"""with {CELLS_SQL}, w as (select client, year, {pivot} from cells group by 1, 2),
a as (select *, case when {some('sales', 'cogs')} then {n('sales')} - {n('cogs')} end as gross_profit, case when {some('depreciation', 'amortization')} then {n('depreciation', 'amortization')} end as depreciation_amortization,
  case when {some(*slots)} then {n(*slots)} end as overhead_sga, case when {some('cash', 'accounts_receivable', 'inventory', 'other_current_assets')} then {n('cash', 'accounts_receivable', 'inventory', 'other_current_assets')} end as total_current_assets,
  case when {some('gross_fixed_assets', 'accumulated_depreciation')} then {n('gross_fixed_assets')} - abs({n('accumulated_depreciation')}) end as net_fixed_assets, case when {some('gross_intangible_assets', 'accumulated_amortization')} then {n('gross_intangible_assets')} - abs({n('accumulated_amortization')}) end as net_intangible_assets,
  case when {some('accounts_payable', 'short_term_debt', 'current_portion_ltd', 'other_current_liabilities')} then {n('accounts_payable', 'short_term_debt', 'current_portion_ltd', 'other_current_liabilities')} end as total_current_liabilities,
  case when {some('notes_minus_short_term', 'subordinated', 'other_long_term_liabilities')} then {n('notes_minus_short_term', 'subordinated', 'other_long_term_liabilities')} end as long_term_liabilities,
  case when {some('preferred_stock', 'common_stock', 'additional_paid_in_capital', 'other_stock_equity', 'unclassified_equity')} then {n('preferred_stock', 'common_stock', 'additional_paid_in_capital', 'other_stock_equity', 'unclassified_equity')} end as total_equity from w),
b as (select *, case when {some('gross_profit', 'overhead_sga', 'other_operating_income', 'other_operating_expenses', 'depreciation_amortization')} then {n('gross_profit', 'other_operating_income')} - {n('depreciation_amortization')} - {n('overhead_sga')} - {n('other_operating_expenses')} end as operating_profit,
  case when {some('total_current_assets', 'net_fixed_assets')} then {n('total_current_assets', 'net_fixed_assets', 'net_intangible_assets', 'other_assets')} end as total_assets, case when {some('total_current_liabilities', 'long_term_liabilities')} then {n('total_current_liabilities', 'long_term_liabilities')} end as total_liabilities from a),
c as (select *, case when {some('operating_profit', 'interest_expense', 'other_income', 'other_expenses')} then {n('operating_profit', 'other_income')} - {n('interest_expense')} - {n('other_expenses')} end as net_profit_before_taxes,
  case when {some('total_liabilities', 'total_equity')} then {n('total_liabilities', 'total_equity')} end as total_liabilities_equity from b),
d as (select *, case when {some('net_profit_before_taxes', 'adjusted_owner_compensation')} then {n('net_profit_before_taxes', 'adjusted_owner_compensation')} end as adjusted_net_profit_before_taxes from c)
select client, year, gross_profit, depreciation_amortization, overhead_sga, operating_profit, net_profit_before_taxes, adjusted_net_profit_before_taxes, case when {some('adjusted_net_profit_before_taxes', 'taxes_paid', 'extraordinary_gain', 'extraordinary_loss')} then {n('adjusted_net_profit_before_taxes', 'extraordinary_gain')} - {n('taxes_paid')} - {n('extraordinary_loss')} end as net_income,
  total_current_assets, net_fixed_assets, net_intangible_assets, total_assets, total_current_liabilities, long_term_liabilities, total_liabilities, total_equity, total_liabilities_equity from d"""


@query(_formula_sql())
def workbook_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = formulas.wide(cells(spark, sf_dir), ["client", "year"], FIELDS)
    return formulas.evaluated(wide).select("client", "year", *[f.name for f in formulas.WORKBOOK])


@query("""
select c_custkey, case c_custkey % 5 when 0 then 'blue river ' || c_custkey when 1 then 'north ' || c_custkey || ' trading' when 2 then 'dr smith ' || c_custkey || ' p c' when 3 then 'identification of ' || c_custkey else 'hill services ' || c_custkey end as key,
  case c_custkey % 5 when 0 then 'plausible' when 1 then 'plausible' when 2 then 'plausible' when 3 then 'unreliable' else 'strong-entity' end as quality from customer
""")
def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("string")
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.concat(F.lit("Blue  River "), n, F.lit(" Co., Inc."))).when(k == 1, F.concat(F.lit("NORTH #"), n, F.lit(" Trading Company, L.L.C"))).when(k == 2, F.concat(F.lit("Dr. Smith "), n, F.lit(", CPA P.C."))).when(k == 3, F.concat(F.lit("Identification of "), n, F.lit(" Corp"))).otherwise(F.concat(F.lit("Hill Services "), n, F.lit(", LLC")))
    key = labels.client_key(name)
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), rules.key_quality(key).alias("quality"))


EXPENSES = ("Compensation of officers", "Salaries and wages", "Officers' compensation and wages", "Adetsing", "Repairs & maint.", "Net rental income repairs", "Taxes and licenses", "Payroll processing", "Bank charges", "Other expenses: Tree trimming", "Telephone", "Job supplies", "Apportionment payroll", "Fuel", "Rent expense")
EXPENSE_KEYS = ("officer_compensation", "salaries_wages", "officers compensation and wages", "advertising", "repairs", "repairs", "taxes_licenses", "payroll processing", "bank_credit_card", "tree trimming", "utilities", "supplies", "apportionment payroll", "gasoline", "rent")


@query(f"select p_partkey, {sql_list(EXPENSE_KEYS)}[1 + p_partkey % {len(EXPENSES)}] as key from part")
def expense_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", labels.expense_key(pick(EXPENSES, F.col("p_partkey") % len(EXPENSES))).alias("key"))


@query(f"""
with {CELLS_SQL}, {SOURCE_SQL}
select client, year, field_id, fam as family, weak, auth as authoritative, resid as residual, {SUSPICIOUS_SQL} as suspicious from cells join src using (i)
""")
def suspicious_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    odd = trust.suspicious(F.col("field_id"), F.col("value"), s, F.col("year"))
    return cells(spark, sf_dir).select("client", "year", "field_id", trust.family(s).alias("family"), trust.is_weak(s).alias("weak"), trust.is_authoritative(s).alias("authoritative"), trust.is_residual(s).alias("residual"), odd.alias("suspicious"))


@query(f"""
with {CELLS_SQL}, {SOURCE_SQL}, j as (select *, {SUSPICIOUS_SQL} as odd, client % 2 = 0 as strict from cells join src using (i)),
v as (select *, case when not (odd or (weak and abs(value) <= 1)) then 'keep'
  when odd and ((auth and value <= 99) or (field_id in ('depreciation', 'amortization') and value in (1986, 1987)) or (field_id = 'interest_expense' and value <= 999) or (field_id = 'accounts_payable' and value <= 99 and not auth)) then 'clear'
  when strict and not auth then 'clear' else 'cap' end as verdict from j)
select client, year, field_id, verdict, case when verdict <> 'clear' then value end as value, case verdict when 'keep' then conf when 'cap' then least(conf, 42) end as confidence from v
""")
def confidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trust.gated(cells(spark, sf_dir), F.col("year"), F.col("client") % 2 == 0)
    return rows.select("client", "year", "field_id", "verdict", "value", "confidence")


@query(f"""
with {CELLS_SQL}, {SOURCE_SQL}, j as (select *, {SUSPICIOUS_SQL} as odd from cells join src using (i)),
n as (select client, year - 1 as year, field_id, value as c from cells),
t as (select coalesce(j.client, n.client) as client, coalesce(j.year, n.year) as year, coalesce(j.field_id, n.field_id) as field_id, j.value as old, j.odd, j.weak, n.c from j full join n on j.client = n.client and j.year = n.year and j.field_id = n.field_id),
u as (select *, c as value, 1 as i, true as auth from (select * exclude (weak), weak as old_weak, false as weak from t)),
d as (select *, c is not null and not {SUSPICIOUS_SQL.replace('i = 3', 'false').replace('i = 4', 'false')} and not (field_id = 'other_current_liabilities' and c > 0) and (old is null or odd or old_weak) as take from u)
select client, year, field_id, case when take then c else old end as value, take from d
""")
def comparison_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    later = own.select("client", (F.col("year") - 1).alias("year"), "field_id", "value", F.lit(88).alias("confidence"))
    out = trust.refilled(own, later, ["client", "year"], F.col("year"))
    return out.select("client", "year", "field_id", "value", F.coalesce(F.contains("source", F.lit("cross-reference")), F.lit(False)).alias("take"))


@query(f"""
with {CELLS_SQL}, {SOURCE_SQL},
fields as (select unnest({sql_list(FIELDS)}) as field_id), sheets as (select distinct client, year from cells),
w as (select client, year, max(value) filter (field_id = 'sales') as sales, max(value) filter (field_id = 'cogs') as cogs, max(value) filter (field_id = 'amortization') as am, max(value) filter (field_id = 'accumulated_amortization') as aam, max(value) filter (field_id = 'depreciation') as de, max(value) filter (field_id = 'accumulated_depreciation') as ade, max(value) filter (field_id = 'gross_fixed_assets') as gfa,
  coalesce(sum(value) filter (field_id in ('cash', 'accounts_receivable', 'inventory', 'other_current_assets', 'gross_fixed_assets', 'other_assets')), 0) - coalesce(sum(value) filter (field_id in ('accumulated_depreciation', 'accumulated_amortization')), 0) as assets,
  count(*) filter (field_id in ('cash', 'accounts_receivable', 'inventory', 'other_current_assets', 'gross_fixed_assets', 'accumulated_depreciation')) as n_assets,
  coalesce(sum(value) filter (field_id in ('accounts_payable', 'short_term_debt', 'other_current_liabilities', 'notes_minus_short_term', 'common_stock', 'other_stock_equity', 'unclassified_equity')), 0) as claims, count(*) filter (field_id in ('accounts_payable', 'short_term_debt', 'other_current_liabilities', 'notes_minus_short_term', 'common_stock', 'other_stock_equity', 'unclassified_equity')) as n_claims from cells group by 1, 2),
g as (select s.client, s.year, field_id, value, conf, i from sheets s cross join fields left join cells using (client, year, field_id)),
a as (select client, year, field_id, count(*) as reads, count(distinct family) filter (v = chosen) as agree_all, count(distinct family) filter (v = chosen and family in ('form', 'comparison')) as agree_p, count(*) filter (family in ('form', 'schedule-l', 'comparison')) as credible, count(distinct family) filter (v = chosen and family in ('form', 'schedule-l', 'comparison')) as agree_c,
  coalesce(bool_or(v <> chosen and family in ('form', 'schedule-l', 'comparison')), false) as differ,
  'Other reads: ' || string_agg(family || ': ' || format('{{:,}}', v), ' · ' order by case family when 'form' then 1 when 'schedule-l' then 2 when 'comparison' then 3 when 'statement' then 4 else 6 end, v) filter (v <> chosen) as others from snaps group by 1, 2, 3),
r as (select g.*, src.* exclude (i), w.* exclude (client, year), coalesce(reads, 0) as n_reads, coalesce(agree_all, 0) as aa, coalesce(agree_p, 0) as ap, coalesce(credible >= 2 and agree_c < 2 and differ, false) as material, others from g left join src using (i) left join a using (client, year, field_id) left join w using (client, year)),
q as (select *, l18 and ap = 0 as isolated, case when l18 and ap = 0 then ap else aa end as agree, {SUSPICIOUS_SQL} as odd,
  not l18 and case when auth then conf >= 65 else (comp and conf >= 84) or struc or (opx and conf >= 70) or (coh and conf >= 80) end as single from r),
f as (select *, list_sort(list_filter([
  case when field_id in ('sales', 'cogs') and cogs > sales then 'COGS exceeds sales' end,
  case when n_assets > 0 and n_claims > 0 and abs(assets - claims) > 1 and field_id in ('cash', 'accounts_receivable', 'inventory', 'other_current_assets', 'gross_fixed_assets', 'other_assets', 'accounts_payable', 'other_current_liabilities', 'notes_minus_short_term', 'common_stock', 'other_stock_equity', 'unclassified_equity') then 'Balance sheet does not balance (assets ' || format('{{:,}}', cast(assets as bigint)) || ' vs liabilities+equity ' || format('{{:,}}', cast(claims as bigint)) || ', gap ' || format('{{:,}}', cast(assets - claims as bigint)) || ')' end,
  case when field_id = 'amortization' and am = aam then 'P&L amortization equals accumulated amortization — likely wrong field' end,
  case when field_id = 'depreciation' and de = ade and (gfa is null or de = gfa) then 'P&L depreciation equals accumulated depreciation — likely wrong field' end,
  case when isolated then 'low_trust_source' end,
  case when agree >= 2 then null when fam = 'ocr' then 'OCR label match only — no corroboration' when subt then 'Subtractive formula — verify against detail lines' when l18 and n_reads > 0 and material then 'Statement Line 18 — corroborating source disagrees' when not resid and not single and not closes then 'Low-trust source — verify manually' end,
  case when field_id = 'other_operating_expenses' and subt then 'formula-disagreement — subtractive vs detail lines may diverge' end,
  case when odd then 'Likely form line number or OCR noise — verify' end,
  case when odd and field_id = 'depreciation' then 'Value looks like OCR noise or form line number — verify' end, case when odd and field_id = 'amortization' then 'Value looks like balance-sheet line or OCR noise — verify' end,
  case when material then others end], lambda x: x is not null)) as flags,
  least(conf, case when resid then 58 when isolated then 85 when agree >= 2 then 99 when material then 85 when single then case when conf >= 92 then 92 else 95 end when closes then 95 when subt then 78 else 85 end) as shown from q),
h as (select *, len(list_filter(flags, lambda x: contains(x, 'exceeds sales') or contains(x, 'does not balance') or contains(x, 'formula-disagreement'))) > 0 as hard from f)
select client, year, field_id, value, case when value is null then '' else array_to_string(flags, '; ') end as flags,
  case when value is null then 'missing' when hard or odd or material or conf < 65 or (fam = 'ocr' and agree < 2) or weak or isolated or (agree < 2 and not single and not closes and not (fam = 'statement' and conf >= 88 and not subt and not l18)) then 'review' else 'verified' end as status,
  case when value is not null then shown end as confidence, case when value is not null then agree end as agreement,
  case when value is null then 'empty' when hard or len(list_filter(flags, lambda x: contains(x, 'Subtractive formula'))) > 0 then 'math-warning' when len(list_filter(flags, lambda x: contains(x, 'Other reads'))) > 0 then 'moderate' when odd then 'low'
    when len(list_filter(flags, lambda x: contains(x, 'verify manually') or contains(x, 'verify against'))) > 0 then case when conf >= 80 then 'moderate' else 'low' end when resid then case when shown >= 80 then 'moderate' else 'low' end
    when opx and conf >= 70 then case when shown >= 75 then 'single-good' else 'moderate' end when agree >= 2 then 'multi-source' when fam = 'ocr' then 'ocr-only' when conf < 65 then 'low' when auth then case when shown >= 80 then 'authoritative' else 'single-good' end
    when closes and conf >= 85 then 'single-good' when (struc or (coh and conf >= 80)) then case when shown >= 70 then 'single-good' else 'moderate' end else 'moderate' end as tier from h
""")
def reconcile_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    fields = spark.createDataFrame([(f,) for f in FIELDS], "field_id string")
    out = trust.reconciled(own, snapshots(own), ["client"], fields)
    return out.withColumn("flags", F.array_join("flags", "; "))


@query(f"""
with {CELLS_SQL}, n as (select client, year, field_id, v, count(*) as n, min(case family when 'form' then 1 when 'schedule-l' then 2 when 'comparison' then 3 when 'statement' then 4 else 6 end) as place from snaps group by 1, 2, 3, 4),
b as (select *, row_number() over (partition by client, year, field_id order by n >= 2 desc, case when n >= 2 then n else 0 end desc, place, v) as rn, sum(n) over (partition by client, year, field_id) as reads, count(*) over (partition by client, year, field_id) as vals from n)
select client, year, field_id, v as value, case place when 1 then 'form' when 2 then 'schedule-l' when 3 then 'comparison' when 4 then 'statement' else 'ocr' end as family, case when reads >= 2 then vals < reads end as agree from b where rn = 1
""")
def snapshot_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = snapshots(cells(spark, sf_dir))
    agree = trust.schedule_agreement(reads, ["client", "year"]).drop("reads")
    return trust.picked_read(reads, ["client", "year"]).drop("confidence").join(agree, ["client", "year", "field_id"])


#: Sources of candidates, and what each is worth: (evidence, detail, weak residual, residual, comparison).
CANDIDATE_SOURCES = (
    ("Statement 2 (summed detail lines)", 95, True, False, False, False),
    ("Two-year comparison (OTHER OPERATING EXPENSES)", 82, False, False, False, True),
    ("Two-year comparison (OTHER DEDUCTIONS residual, full exclusions)", 88, False, True, True, True),
    ("Form line 20 residual (Stmt 2 attachment total)", 85, False, True, True, False),
    ("Statement 2 (federal table minus slot lines)", 93, True, False, False, False),
    ("P&L reverse math (Form ordinary income)", 72, False, False, False, False),
    ("Statement 2 (misc detail closes Stmt 2 total)", 95, True, False, False, False),
    ("Statement 2 (misc detail sum)", 95, False, False, False, False),
    ("Statement other deductions (office/supplies/telephone/travel/bank detail)", 96, True, False, False, False),
    ("Statement 2 (total minus util/auto/licenses)", 75, True, False, False, False),
    ("Statement 3 (total minus util/merchant/auto/licenses)", 94, True, False, False, False),
    ("Document-wide exclusion residual", 68, False, True, True, False),
    ("Stmt 2 residual (minus known attachment lines)", 72, False, True, True, False),
    ("manual entry", 65, False, False, False, False),
)
_KINDS = ", ".join(f"({i}, {e}, {str(d).lower()}, {str(w).lower()}, {str(r).lower()}, {str(c).lower()})" for i, (_, e, d, w, r, c) in enumerate(CANDIDATE_SOURCES))
CANDIDATES_SQL = f"""src(i, evidence, detail, weak, resid, comp) as (values {_KINDS}),
base as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as ord, cast(floor(l_extendedprice + 0.5) as bigint) as p, cast(l_quantity as bigint) as q, l_partkey % {len(CANDIDATE_SOURCES)} as i from lineitem),
sheet as (select k, sum(p) as total, max(p) filter (ord = 0) as known, max(p) filter (ord = 1) as rival, max(p) as form, max(q) as q from base group by 1),
g as (select b.k, s.total, s.known, s.rival, s.form, b.ord, b.i, case when (b.p + b.ord) % 4 = 0 then s.total - s.known when b.q % 9 = 1 then s.total when b.q % 9 = 2 then s.rival when b.q % 9 = 3 then s.form when b.q % 9 = 4 then s.known else b.p end as value, case when s.q % 3 = 0 then null else (b.q % 3 = 0) end as closes_income, s.q % 5 = 0 as incomplete from base b join sheet s using (k)),
c as (select g.*, src.* exclude (i) from g join src using (i) where value is not null and not (comp and exists (select 1 from g o where o.k = g.k and o.value = g.value and o.ord < g.ord))),
f as (select *, abs(known + value - total) <= 1 as fits, abs(value - total) <= 1 as echo from c),
s as (select *, case when total > 0 and fits then 1 else 0 end as closure, list_filter([case when value = rival then 'pnl_collision' end, case when value = total and not fits and total > 0 and value <> 0 then 'implausible' end, case when echo then 'stmt2_total_trap' end, case when abs(value - form) <= 1 then 'form_line_total_trap' end,
  case when echo or (not fits and (value >= total or (known >= 1 and abs(value - known) <= 1))) or (incomplete and i in (2, 11)) then 'comparison_reject' end, case when i = 8 and total > 0 and (value >= total or (known > 0 and known + value > total)) then 'weak_block_closure' end], lambda x: x is not null) as hard from f),
z as (select *, closure * 1000 + evidence + case when closes_income then 25 when not closes_income then -8 else 0 end as score, array_to_string(list_concat(hard, case when closes_income then ['pnl_identity_close'] when not closes_income then ['pnl_identity_gap'] else [] end), ',') as flags, len(hard) = 0 as valid from s),
o as (select *, row_number() over (partition by k order by score desc, ord) as place, closure * 1000 + detail::int * 500 + evidence as rather from z)"""


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every order is a candidate, from one of fourteen sources; some are the total, the remainder or another field."""
    from pyspark.sql.window import Window

    lines = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), *LINE_KEYS[1:], "l_extendedprice", "l_quantity"), "k")
    lines = lines.withColumns({"p": whole(F.col("l_extendedprice")), "q": F.col("l_quantity").cast("long")})
    of_order = Window.partitionBy("k")
    lines = lines.withColumn("ord", F.row_number().over(of_order.orderBy(*LINE_KEYS[1:], "l_extendedprice", "l_quantity")) - 1)
    at = lambda n: F.max(F.when(F.col("ord") == n, F.col("p"))).over(of_order)
    rows = lines.select("k", "ord", "p", "q", "l_partkey", F.sum("p").over(of_order).alias("total"), at(0).alias("known"), at(1).alias("rival"), F.max("p").over(of_order).alias("form"), F.max("q").over(of_order).alias("mq"))
    k = F.col("q") % 9
    value = F.when((F.col("p") + F.col("ord")) % 4 == 0, F.col("total") - F.col("known")).when(k == 1, F.col("total")).when(k == 2, F.col("rival")).when(k == 3, F.col("form")).when(k == 4, F.col("known")).otherwise(F.col("p"))
    source = pick(tuple(s[0] for s in CANDIDATE_SOURCES), F.col("l_partkey") % len(CANDIDATE_SOURCES))
    rows = rows.select("k", value.alias("value"), source.alias("source"), "ord", "total", "known", "rival", "form", F.when(F.col("mq") % 3 != 0, F.col("q") % 3 == 0).alias("closes_income"), (F.col("mq") % 5 == 0).alias("incomplete"))
    return candidates.scored(candidates.distinct_candidates(rows, ["k"]), rivals=F.array("rival"), form_total=F.col("form"), incomplete=F.col("incomplete"))


@query(f"with {CANDIDATES_SQL} select k, ord, value, closure, evidence, score, flags, valid from z")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_rows(spark, sf_dir).select("k", "ord", "value", "closure", "evidence", "score", F.array_join("flags", ",").alias("flags"), "valid")


def _ranking_sql() -> str:
    """The winner step by step: a table of the places of each kind, then one join for each way in which it gives way."""
    first = lambda name, test: f"{name} as (select k, arg_min(ord, place) as ord, arg_min(rather, place) as rather from o where valid and {test} group by 1)"
    liked = lambda name, test: f"{name} as (select k, arg_max(ord, rather * 100000 + place) as ord, max(rather) as rather from o where {test} group by 1)"
    step = lambda n, join, case: f"w{n} as (select w.k, case {case} else w.ord end as ord from w{n - 1} w join o on o.k = w.k and o.ord = w.ord {join})"
    with_ = lambda *names: " ".join(f"left join {n} on {n}.k = w.k" for n in names)
    parts = [
        liked("shut", "valid and closes_income"), liked("open", "valid"), first("fed", "i = 4"), first("misc", "i = 6 and closure = 1"), liked("det", "valid and detail"), first("office", "i = 8"), first("struct", "i in (4, 9, 10)"), first("summed", "i = 0"),
        liked("unsure", "not valid and i in (0, 4, 6, 9, 10) and not contains(flags, 'comparison_reject')"), liked("compared", "not valid and comp and value >= 1 and not contains(flags, 'pnl_collision') and not contains(flags, 'form_line_total_trap')"),
        "w0 as (select open.k, coalesce(shut.ord, open.ord) as ord from open left join shut using (k))",
        step(1, with_("fed"), "when o.weak and fed.k is not null then fed.ord"),
        step(2, with_("misc"), "when o.resid and o.closure = 1 and misc.k is not null then misc.ord"),
        step(3, with_("det"), "when o.i in (5, 7) and det.k is not null then det.ord"),
        step(4, with_("office", "struct"), "when o.i = 2 and office.rather >= o.rather then office.ord when o.i = 2 and struct.rather >= o.rather then struct.ord"),
        step(5, with_("summed"), "when o.i in (9, 10) and summed.rather >= o.rather then summed.ord"),
        "won as (select k, coalesce(w5.ord, unsure.ord, compared.ord) as ord from (select distinct k from o) left join w5 using (k) left join unsure using (k) left join compared using (k))",
    ]
    return f"with {CANDIDATES_SQL}, {', '.join(parts)} select k, o.value, ord from won join o using (k, ord)"


@query(_ranking_sql())
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidate_rows(spark, sf_dir).drop("total", "known", "rival", "form", "closes_income", "incomplete")  # what the winner does not need
    return candidates.ranked(rows, ["k"]).select("k", "value", "ord")


@query(f"""with {CANDIDATES_SQL}, p as (select *, closure >= 1 and not contains(flags, 'pnl_collision') and not contains(flags, 'comparison_reject') as exact, i in (2, 3) and not contains(flags, 'pnl_collision') and not contains(flags, 'implausible') as identity from z)
select k, value, exact from (select *, row_number() over (partition by k order by exact desc, case when exact then evidence end desc nulls last, ord) as rn from p where exact or identity) where rn = 1""")
def candidate_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.pasted(candidate_rows(spark, sf_dir), ["k"]).select("k", "value", "exact")


REJECT_CASES = (("sales", "Gross receipts or sales", None), ("sales", "Total income", "caption"), ("cogs", "Cost of goods sold less gross profit", "gross profit"), ("depreciation", "Less accumulated depreciation", "accumulated"), ("rent", "Rents", None), ("inventory", "Inventory at end of year", "question"), ("bank_credit_card", "Credit card payable", "payable"), ("other_assets", "Total assets", "other caption"), ("taxes_licenses", "13 interest", "interest"))


@query(f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when p in (1040, 1099, 1120, 1125, 4562, 8990, 3800, 7004, 2220) then 'form number' when p = y or p = y % 100 then 'year' when k = 8 and p = 13 then 'row number'
  else [{', '.join('null' if r is None else f"'{r}'" for _, _, r in REJECT_CASES)}][1 + k] end as reason from (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % {len(REJECT_CASES)} as k, case when l_suppkey % 4 = 0 then year(l_shipdate) else cast(floor(l_extendedprice + 0.5) as bigint) end as p, year(l_shipdate) as y from lineitem)
""")
def line_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("l_partkey") % len(REJECT_CASES), F.year("l_shipdate")
    value = F.when(F.col("l_suppkey") % 4 == 0, y).otherwise(whole(F.col("l_extendedprice")))
    field, caption = pick(tuple(f for f, _, _ in REJECT_CASES), k), pick(tuple(c for _, c, _ in REJECT_CASES), k)
    rows = table(spark, sf_dir, "lineitem").select(*LINE_KEYS, field.alias("field"), F.concat(caption, F.lit(" "), F.format_number(value, 0)).alias("line"), value.cast("long").alias("value"), y.alias("y"))
    accepted, refused = rules.split_rejects(rows, rules.rejected(F.col("field"), F.col("line"), F.col("value"), F.col("y")))
    return refused.select(*LINE_KEYS, "reason").unionByName(accepted.select(*LINE_KEYS, F.lit(None).cast("string").alias("reason")))


@query("""
with s as (select l_orderkey, max(p) as sales, min(p) as cogs from (select l_orderkey, cast(floor(l_extendedprice + 0.5) as bigint) as p from lineitem) group by 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when v < 1 or v in (1040, 1099, 1120, 1125, 4562, 8990, 3800, 7004, 2220) or v between 1990 and 2035 then 'below_min_amount' when v >= 1000000000 then 'unreasonable_digits' when v > sales then 'collides_with_sales'
  when l_linenumber % 3 = 0 and v = sales then 'collides_with_sales' when l_linenumber % 3 = 1 and v = cogs then 'collides_with_cogs' end as reason from (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice + 0.5) as bigint) * case when l_suppkey % 9 = 0 then 0 when l_suppkey % 9 = 1 then 2 when l_suppkey % 9 = 2 then 2000000 else 1 end as v from lineitem) join s using (l_orderkey)
""")
def illogical_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("p", whole(F.col("l_extendedprice")))
    sheet = rows.groupBy("l_orderkey").agg(F.max("p").alias("sales"), F.min("p").alias("cogs"))
    k = F.col("l_suppkey") % 9
    v = F.col("p") * F.when(k == 0, 0).when(k == 1, 2).when(k == 2, 2_000_000).otherwise(1)
    label = F.when(F.col("l_linenumber") % 3 == 0, "Gross receipts or sales").when(F.col("l_linenumber") % 3 == 1, "Cost of goods sold").otherwise("Rent")
    reason = rules.illogical(label, v, {"sales": F.col("sales"), "cogs": F.col("cogs")})
    return rows.join(sheet, "l_orderkey").select(*LINE_KEYS, reason.alias("reason"))


@query("""
select o_custkey, arg_min(key, o_orderkey) filter (q = best) as key, case best when 0 then 'strong-entity' when 1 then 'plausible' else 'unreliable' end as quality from (
  select *, min(q) over (partition by o_custkey) as best from (select o_custkey, o_orderkey, case o_orderkey % 7 when 0 then 'hill services ' when 1 then 'smith smith' when 2 then 'schedule a ' else 'green ' end || case when o_orderkey % 7 = 1 then '' else o_orderpriority end as key, case o_orderkey % 7 when 0 then 0 when 1 then 2 when 2 then 2 else 1 end as q from orders)) group by o_custkey, best
""")
def preferred_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    key = F.concat(F.when(k == 0, "hill services ").when(k == 1, "smith smith").when(k == 2, "schedule a ").otherwise("green "), F.when(k == 1, "").otherwise(F.col("o_orderpriority")))
    return rules.preferred_identity(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", key.alias("key")), ["o_custkey"], "key", ["o_orderkey"])


@query(f"""
with {CELLS_SQL}, w as (select client, year, max(value) filter (field_id = 'sales') as s, max(value) filter (field_id = 'cogs') as f, max(value) filter (field_id = 'inventory') as x, max(i) filter (field_id = 'cogs') as i from cells group by 1, 2),
c as (select client, year, s, f, i, case when client % 3 = 0 and s > f then s - f else x end as x from w)
select client, year, case when f is null then x when x is null then f when abs(f - x) <= 1 then null when s > f and abs(x - (s - f)) <= 1 then f when i = 0 then f else x end as value from c
""")
def cost_of_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    of = lambda f, c: F.max(F.when(F.col("field_id") == f, F.col(c)))
    w = own.groupBy("client", "year").agg(of("sales", "value").alias("s"), of("cogs", "value").alias("f"), of("inventory", "value").alias("x"), of("cogs", "source").alias("source"))
    x = F.when((F.col("client") % 3 == 0) & (F.col("s") > F.col("f")), F.col("s") - F.col("f")).otherwise(F.col("x"))
    return w.select("client", "year", rules.cost_of_goods(F.col("s"), F.col("f"), x, F.col("source"))["value"].alias("value"))


@query("""
select p_partkey, case when p_brand = 'Brand#1' then 'first_maker' when p_brand = 'Brand#12' then 'second_maker' else regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') end as field_id from part
""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("brand#1", "first_maker"), ("Brand#12 ", "second_maker")], "label string, field_id string")
    return rules.aliased(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_brand").alias("label")), "label", aliases).select("p_partkey", "field_id")


@query(f"""
with {CELLS_SQL}, f as (select unnest({sql_list(FIELDS)}) as field_id), s as (select distinct client, year from cells)
select client, year, count(value) as n_filled, count(*) as n_fields, round(count(value) / count(*), 6) as ratio, coalesce(string_agg(field_id, ',' order by field_id) filter (value is null), '') as missing from s cross join f left join cells using (client, year, field_id) group by 1, 2
""")
def sheet_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = spark.createDataFrame([(f, f) for f in FIELDS], "field_id string, label string")
    return rules.filled(cells(spark, sf_dir), fields, ["client", "year"]).withColumn("missing", F.array_join("missing", ","))


@query("""
select period, n, names from (select o_custkey * 10000 + year(o_orderdate) as period, count(*) as n, string_agg(cast(o_orderkey as varchar), ', ' order by cast(o_orderkey as varchar)) as names from orders group by 1) where n > 1
""")
def duplicate_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("period"), F.col("o_orderkey").cast("string").alias("name"))
    return rules.duplicate_periods(files, "period", "name")


@query("select l_suppkey, cast(sum(distinct cast(l_quantity as bigint)) as bigint) as q from lineitem group by 1")
def distinct_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.distinct_sum(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q")), ["l_suppkey"], "q")


@query("select l_returnflag, count(*) as n, cast(sum(cast(l_discount >= 0.05 as int)) as bigint) as n_ok, round(avg(cast(l_discount >= 0.05 as int)), 6) as rate, median(l_quantity) as median_error, round(stddev(l_quantity), 4) as spread from lineitem group by 1")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_discount") >= 0.05).alias("ok"), F.col("l_quantity").alias("error"))
    return rules.accuracy(rows, ["l_returnflag"], "ok", "error")


@query("""
select p_partkey, case p_partkey % 5 when 0 then p_size * 1000.0 when 1 then -p_size * 1000.0 when 3 then cast(p_size as double) end as amount, case p_partkey % 5 when 2 then p_size / 100.0 when 3 then p_size / 100.0 end as share from part
""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    line = F.when(k == 0, F.concat(F.lit("$"), n, F.lit(",000"))).when(k == 1, F.concat(F.lit("("), n, F.lit(",000)"))).when(k == 2, F.concat(n, F.lit(".0 %"))).when(k == 3, n).otherwise("Net sales")
    return table(spark, sf_dir, "part").select("p_partkey", amounts.money_line(line).alias("amount"), amounts.percent_line(line).alias("share"))


@query(f"""
with {CELLS_SQL}, w as (select client, year, max(value) filter (field_id = 'sales') as sales, max(value) filter (field_id = 'cogs') as cogs from cells group by 1, 2),
g as (select *, case when sales is not null or cogs is not null then coalesce(sales, 0) - coalesce(cogs, 0) end as g from w),
o as (select *, case when client % 3 = 0 then g + client % 5 end as override, case when client % 4 = 0 then g - client % 7 end as parsed from g)
select client, year, coalesce(override, g) as gross_profit, array_to_string(list_filter([case when abs(override - g) > 1 then 'gross_profit: Formula expects ' || g end, case when abs(g - parsed) > 1 then 'gross_profit: From extraction ' || parsed end], lambda x: x is not null), '; ') as hints from o
""")
def formula_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = formulas.wide(cells(spark, sf_dir), ["client", "year"], ["sales", "cogs"])
    g = F.col("gross_profit")
    w = formulas.evaluated(w, formulas.WORKBOOK[:1]).withColumn("override", F.when(F.col("client") % 3 == 0, g + F.col("client") % 5)).withColumn("parsed", F.when(F.col("client") % 4 == 0, g - F.col("client") % 7))
    out = formulas.displayed(w, {"gross_profit": "override"}, {"gross_profit": "parsed"}, formulas.WORKBOOK[:1])
    return out.select("client", "year", "gross_profit", F.array_join("hints", "; ").alias("hints"))


@query(f"""
with f as ({_formula_sql()}), {CELLS_SQL}, w as (select client, year, sum(value) filter (field_id in {tuple(formulas.SLOTS)}) as slots, max(value) filter (field_id = 'other_operating_expenses') as other, max(value) filter (field_id = 'taxes_paid') as taxes from cells group by 1, 2),
j as (select *, case when client % 3 = 0 then net_profit_before_taxes when client % 3 = 1 then net_profit_before_taxes + 10 end as income, case when client % 2 = 0 then gross_profit + client % 4 end as form from f join w using (client, year))
select client, year, array_to_string(list_filter([
  case when form <> gross_profit then 'Gross profit mismatch: form ' || format('{{:,}}', cast(form as bigint)) || ' vs sales−COGS ' || format('{{:,}}', cast(gross_profit as bigint)) end,
  case when net_profit_before_taxes <> income then 'P&L does not close to Form ordinary income (workbook NPBT ' || format('{{:,}}', cast(net_profit_before_taxes as bigint)) || ' vs form ' || format('{{:,}}', cast(income as bigint)) || ', gap -10; top-8 sum ' || format('{{:,}}', cast(coalesce(slots, 0) as bigint)) || ', other_opex ' || format('{{:,}}', coalesce(other, 0)) || ')' end,
  case when net_profit_before_taxes <> income and other is not null then 'other_operating_expenses may be wrong (gap -10)' end,
  case when not coalesce(net_profit_before_taxes <> income, false) and net_income <> income and coalesce(taxes, 0) = 0 then 'Net income ' || format('{{:,}}', cast(net_income as bigint)) || ' ≠ Form ordinary income ' || format('{{:,}}', cast(income as bigint)) || ' (top-8 sum ' || format('{{:,}}', cast(coalesce(slots, 0) as bigint)) || ', other_opex ' || format('{{:,}}', coalesce(other, 0)) || ')' end], lambda x: x is not null), '; ') as warnings from j
""")
def identity_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = formulas.evaluated(formulas.wide(cells(spark, sf_dir), ["client", "year"], FIELDS))
    k = F.col("client") % 3
    w = w.withColumn("income", F.when(k == 0, F.col("net_profit_before_taxes")).when(k == 1, F.col("net_profit_before_taxes") + 10)).withColumn("form", F.when(F.col("client") % 2 == 0, F.col("gross_profit") + F.col("client") % 4))
    return formulas.identity_warnings(w, "income", "form").select("client", "year", F.array_join("warnings", "; ").alias("warnings"))


COMPANIES = ("hill services llc", "hill services", "green corp", "green", "blue supply inc", "smith smith", "schedule a", "red company")
#: Of which pairs (existing, incoming) the second is another company where years overlap, and which of both are legal entities.
ENTITIES, RELIABLE, STEMS = (0, 1, 2, 4, 7), (0, 1, 2, 3, 4, 7), ("hill", "hill", "green", "green", "blue", "smith", "schedule", "red")


@query(f"""
with k as (select o_orderkey, o_custkey % {len(COMPANIES)} as a, o_orderkey % {len(COMPANIES)} as b, o_orderkey % 2 = 0 as overlap from orders),
n as (select unnest(range(0, {len(COMPANIES)})) as i, {sql_list(STEMS)}[i + 1] as stem, list_contains({list(ENTITIES)}, i) as entity, list_contains({list(RELIABLE)}, i) as reliable)
select o_orderkey, x.stem <> y.stem and x.reliable and y.reliable and (overlap or (x.entity and y.entity)) as other from k join n x on x.i = a join n y on y.i = b
""")
def company_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = pick(COMPANIES, F.col("o_custkey") % len(COMPANIES)), pick(COMPANIES, F.col("o_orderkey") % len(COMPANIES))
    return o.select("o_orderkey", rules.other_company(a, b, F.col("o_orderkey") % 2 == 0).alias("other"))


@query("""
with v as (select p_brand as section, p_type as label, count(*) as value from part group by 1, 2), s as (select section, label, value, row_number() over (order by section, label) as n from v)
select cast(2 * n as int) as row, case when n % 4 = 0 then '  ' || label || chr(9) else '  ' || label || chr(9) || value end as line from s union all select cast(2 * n + 1 as int), '' from s union all select 0, 'All' || chr(9) || 'Count'
""")
def benchmark_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    from ..sources import sheets

    values = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("section"), F.col("p_type").alias("label")).agg(F.count("*").cast("string").alias("value"))
    n = F.row_number().over(Window.orderBy("section", "label"))  # a template: a few rows
    rows = values.select(n.alias("n"), "section", "label", "value")
    value = rows.select((2 * F.col("n")).alias("row"), F.lit("value").alias("kind"), "section", "label", F.lit(2).alias("indent"))
    blank = rows.select((2 * F.col("n") + 1).alias("row"), F.lit("blank").alias("kind"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("indent"))
    head = spark.createDataFrame([(0, "section", "All", None, 0)], "row int, kind string, section string, label string, indent int")
    return sheets.template_lines(head.unionByName(value).unionByName(blank), rows.where("n % 4 <> 0"), "Count").select("row", "line")


@query("""
select o_orderkey, cast(case o_orderkey % 6 when 0 then y when 1 then y + 1 when 2 then y + 1 when 3 then y when 4 then y end as int) as year from (select o_orderkey, year(o_orderdate) + 10 as y from orders)
""")
def tax_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, k = F.year("o_orderdate") + 10, F.col("o_orderkey") % 6
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    text = (
        F.when(k == 0, say("Filed 2030. Calendar year ", y, " and 2030"))
        .when(k == 1, say("years ", y, " - ", y + 1, " and ", y, " ", y))
        .when(k == 2, say("Worksheet of ", y, " ", y, " with ", y + 1))
        .when(k == 3, say("seen ", y, " ", y, " then ", y + 1))
        .otherwise("no date here")
    )
    name = F.when(k == 4, say("return_", y - 1, "_", y, ".pdf")).otherwise(F.lit("return.pdf"))
    return table(spark, sf_dir, "orders").select("o_orderkey", compare.tax_year(text, name).alias("year"))


@query("""
with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey + l_linenumber) % 5 as k, l_suppkey % 2 as col, cast(floor(l_extendedprice + 0.5) as bigint) as p, cast(floor(l_extendedprice * (1 - l_discount) / 2 + 0.5) as bigint) as q from lineitem),
c as (select *, case k when 0 then [p, p] when 1 then [p] when 2 then [p, q] when 3 then [p, q, abs(p - q)] else [p, q, p + q] end as cells from r),
t as (select *, list_filter(cells, lambda x: x > 9 and x not in (1040, 1099, 1120, 1125, 4562, 8990, 3800, 7004, 2220) and x not between 1990 and 2035 and not (k >= 3 and q < 1000 and x = q)) as t from c)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when k = 0 and col = 1 and p >= 1000 then null else t[1 + least(col, len(t) - 1)] end as amount from t
""")
def comparison_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worksheet rows of two years, some with a column of changes or totals, some with a blank current year.

    Form numbers and years are no amounts, and neither is a short number
    between bars, which refers to a row; a row may be left with one column.
    """
    rows = spread(table(spark, sf_dir, "lineitem").select(*LINE_KEYS, ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).alias("k"), (F.col("l_suppkey") % 2).cast("int").alias("col"), whole(F.col("l_extendedprice")).alias("p"), whole(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 2).alias("q")))
    n = lambda c: F.format_number(c, 0)
    p, q = F.col("p"), F.col("q")
    line = (
        F.when(F.col("k") == 0, F.concat(F.lit("Rents "), n(p), F.lit("  -"), n(p)))
        .when(F.col("k") == 1, F.concat(F.lit("Rents "), n(p)))
        .when(F.col("k") == 2, F.concat(F.lit("Rents "), n(p), F.lit(" | "), n(q)))
        .when(F.col("k") == 3, F.concat(F.lit("Rents "), n(p), F.lit(" | "), n(q), F.lit(" | "), n(F.abs(p - q))))
        .otherwise(F.concat(F.lit("Rents "), n(p), F.lit(" | "), n(q), F.lit(" | "), n(p + q)))
    )
    rows = rows.select(*LINE_KEYS, "col", line.alias("line"))  # written once, however often it is read
    return rows.select(*LINE_KEYS, compare.comparison_amount(F.col("line"), F.col("col")).alias("amount"))


@query("""
with t as (select p_brand, p_type, min(p_size) as a, max(p_size) as z from part group by 1, 2)
select p_brand, p_type as label, round(z / 100.0, 6) as ratio from t where p_type not like 'S%'
""")
def common_size_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section of percentages between a header and a terminator for each brand; what stands before and after is none."""
    t = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_size").alias("a"), F.max("p_size").alias("z"))
    row = F.concat(F.col("p_type"), F.lit(" "), F.col("a").cast("string"), F.lit("% -- "), F.col("z").cast("string"), F.lit(".0 %"))
    inside = t.where("p_type not like 'S%'").select("p_brand", F.concat(F.lit("2"), F.col("p_type")).alias("at"), row.alias("line"))
    outside = t.where("p_type like 'S%'").select("p_brand", F.concat(F.when(F.col("a") % 2 == 0, "0").otherwise("4"), F.col("p_type")).alias("at"), row.alias("line"))
    again = inside.select("p_brand", F.concat("at", F.lit("~")).alias("at"), F.replace("line", F.lit(".0 %"), F.lit("9 %")).alias("line"))
    mark = lambda at, line: t.select("p_brand").distinct().select("p_brand", F.lit(at).alias("at"), F.lit(line).alias("line"))
    lines = inside.unionByName(outside).unionByName(again).unionByName(mark("1", "Income Statement Data 12/31/2020 Industry*")).unionByName(mark("3", "Industry Scorecard"))
    out = compare.section_ratios(lines, ["p_brand"], "at", F.col("line").rlike("(?i)income statement data"), F.col("line").rlike("(?i)^industry scorecard"), 2)
    return out.select("p_brand", "label", "ratio")


@query(f"""
with {CELLS_SQL}, s as (select client, year, field_id, v, family, chosen, row_number() over (partition by client, year, field_id order by family, v) as ord from snaps),
c as (select *, case when family = 'ocr' then 'comparison' when family = 'schedule-l' then 'form4562' else family end as fam, cast(60 + v % 40 as int) as conf from s),
ok as (select *, case fam when 'form' then 1 when 'form4562' then 2 when 'statement' then 3 else 4 end as place from c where v <> chosen + 7 and v < 1000000000 and not (fam = 'comparison' and (v between 2020 and 2035 or v in (1986, 1987)))),
g as (select *, place = 4 and count(*) over (partition by client, year, field_id, v, place = 4) > 1 as agreed from ok)
select client, year, field_id, v as value, fam as family from (select *, row_number() over (partition by client, year, field_id order by place, agreed desc, case when agreed then conf end desc nulls last, ord) as rn from g) where rn = 1
""")
def cross_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    own = cells(spark, sf_dir)
    reads = snapshots(own).join(own.select("client", "year", "field_id", F.col("value").alias("chosen")), ["client", "year", "field_id"])
    order = F.row_number().over(Window.partitionBy("client", "year", "field_id").orderBy("family", "value"))
    fam = F.when(F.col("family") == "ocr", "comparison").when(F.col("family") == "schedule-l", "form4562").otherwise(F.col("family"))
    rows = reads.withColumn("ord", order).select("client", "year", "field_id", "value", F.lit("line 14").alias("source"), fam.alias("family"), (60 + F.col("value") % 40).cast("int").alias("confidence"), "ord", F.array(F.col("chosen") + 7).alias("traps"))
    return compare.cross_referenced(rows, ["client", "year", "field_id"]).drop("source")


@query(f"""
with {CELLS_SQL}, {SOURCE_SQL}, e as (select * replace (case when field_id = 'depreciation' and client % 3 = 0 then coalesce((select max(value) from cells o where o.client = c.client and o.year = c.year and o.field_id = 'gross_fixed_assets'), value) when field_id = 'common_stock' and client % 2 = 0 then coalesce((select max(value) from cells o where o.client = c.client and o.year = c.year and o.field_id = 'unclassified_equity'), value) else value end as value) from cells c),
j as (select *, {SUSPICIOUS_SQL} as odd from e join src using (i))
select client, year, field_id, value, case when odd then 'suspicious magnitude/source'
  when field_id = 'depreciation' and exists (select 1 from e o where o.client = j.client and o.year = j.year and o.field_id in ('accumulated_depreciation', 'gross_fixed_assets') and o.value = j.value) then 'matched balance-sheet line'
  when field_id = 'amortization' and exists (select 1 from e o where o.client = j.client and o.year = j.year and o.field_id = 'accumulated_amortization' and o.value = j.value) then 'matched balance-sheet line'
  when field_id = 'common_stock' and weak and exists (select 1 from e o where o.client = j.client and o.year = j.year and o.field_id in ('unclassified_equity', 'other_stock_equity') and o.value = j.value) then 'weak duplicate' end as cleared from j
""")
def coherence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    of = lambda f: own.where(F.col("field_id") == f).select("client", "year", F.col("value").alias(f))
    rows = own.join(of("gross_fixed_assets"), ["client", "year"], "left").join(of("unclassified_equity"), ["client", "year"], "left")
    value = F.when((F.col("field_id") == "depreciation") & (F.col("client") % 3 == 0), F.coalesce("gross_fixed_assets", "value")).when((F.col("field_id") == "common_stock") & (F.col("client") % 2 == 0), F.coalesce("unclassified_equity", "value")).otherwise(F.col("value"))
    rows = rows.withColumn("value", value).drop("gross_fixed_assets", "unclassified_equity")
    return compare.coherent(rows, ["client"], "year").select("client", "year", "field_id", "value", "cleared")
