"""Queries over pools of expense lines: the sheets are a customer's years, the lines those of the orders.

What a line says depends on its part alone, so the SQL twins know every
caption's category, group and fate by number and never look at the words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import FORM_NUMBERS, whole
from ..operators import finalize as final
from ..operators import pool, ranking
from . import returns
from .registry import query, spread, table

#: (label, source, category, group, fate): a fate is why the line is out, or "rest" for the remainder only.
LINES = (
    ("Rents", "two-year comparison (rent row)", "rent", "row:rent", None),
    ("Rent", "document scan", "rent", "cat:rent", None),
    ("Rents", "Statement 2", "rent", "spot:stmt2:rent", None),
    ("Repairs", "document scan", "repairs", "cat:repairs", None),
    ("Repairs", "Statement 2", "repairs", "spot:stmt2:repairs", None),
    ("Utilities", "Statement 2", "utilities", "spot:stmt2:utilities", None),
    ("Electric", "two-year comparison (utilities row)", "utilities", "row:utilities", None),
    ("Bank charges", "Statement 2", "bank_credit_card", "spot:stmt2:bank_credit_card", None),
    ("Bank fees", "two-year comparison (bank_credit_card row)", "bank_credit_card", "row:bank_credit_card", None),
    ("Salaries and wages", "Form 1120 line 13", "salaries_wages", "spot:form1120:13", None),
    ("Wages", "Statement 7", "salaries_wages", "spot:stmt7:salaries_wages", None),
    ("Salaries and wages", "two-year comparison (salaries_wages row)", "salaries_wages", "row:salaries_wages", None),
    ("Taxes and licenses", "Form 1120 line 17", "taxes_licenses", "spot:form1120:17", None),
    ("Taxes and licenses", "two-year comparison (taxes_licenses row)", "taxes_licenses", "row:taxes_licenses", None),
    ("Payroll tax", "Statement 2", None, "spot:stmt2:payroll tax", "payroll tax"),
    ("Telephone", "Statement 2", "utilities", "spot:stmt2:utilities", "rest of the statement"),
    ("Gross receipts", "Statement 2", None, "spot:stmt2:gross receipts", "non_expense_anchor"),
    ("Misc fees", "browser", None, "label:misc fees", "source"),
    ("Pension plan", "Form 1120 line 23", None, "spot:form1120:23", "rest"),
    ("Rents", "Form 1120 line 16", "rent", "spot:form1120:16", None),
    ("Advertising", "", "advertising", "cat:advertising", None),
    ("Widgets", "Statement 2", None, "spot:stmt2:widgets", None),
    ("Bank and credit card", "OCR caps label", "bank_credit_card", "cat:bank_credit_card", None),
)
TAXES_AT = len(LINES)
SLOT_LINES = (("Taxes and Licenses", "Form 1120 line 12", "taxes_licenses", "spot:form1120:12", None), ("Taxes and Licenses", "Statement 2 taxes", "taxes_licenses", "spot:stmt2:taxes_licenses", None))
TITLES = {"taxes_licenses": "Taxes and Licenses"}


def pool_lines(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """The lines of each customer's years, dealt ``by`` them while they are numbers, if at all."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("client"), F.year("o_orderdate").alias("year"))
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % len(LINES)).cast("int").alias("i"), whole(F.col("l_extendedprice")).alias("amount"))
    at = lambda n: F.get(F.array(*[F.lit(x[n]) for x in LINES]), F.col("i"))
    rows = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("client", "year", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "i", "amount")
    return (spread(rows, *by) if by else rows).select("client", "year", "ord", at(0).alias("label"), "amount", at(1).alias("source"))


def slots(lines: DataFrame) -> DataFrame:
    """Taxes of two thirds of the clients: from the form, or from a statement that splits them."""
    k = F.col("client") % 3
    return lines.where(k < 2).select("client", "year", F.lit("taxes_licenses").alias("field_id"), (F.when(k == 0, 12345).otherwise(777) + F.col("year") % 10).cast("long").alias("value"), F.when(k == 0, SLOT_LINES[0][1]).otherwise(SLOT_LINES[1][1]).alias("source")).distinct()


_text = lambda v: "null" if v is None else f"'{v}'"
_LINES = ", ".join(f"({i}, {', '.join(map(_text, x))})" for i, x in enumerate((*LINES, *SLOT_LINES)))


def _has(*numbers: int) -> str:
    return f"max(case when live and i in ({', '.join(map(str, numbers))}) then 1 end) over s is not null"


def _step(n: int, test: str, reason: str) -> str:
    """One pass: lines for which ``test`` holds are out; ``live`` is what no pass before has taken."""
    return f"p{n} as (select * replace (case when live and ({test}) then '{reason}' else reason end as reason, live and not coalesce({test}, false) as live) from p{n - 1} window s as (partition by client, year))"


_BANK = "max(case when live and i = 7 then amount end) over s"
_OTHER_BANK = "max(case when live and i in (8, 22) then case i when 8 then 1000000000 else amount end end) over s"
_TAXES = "(case client % 3 when 0 then 12345 when 1 then 777 end + year % 10)"
_PASSES = (
    ("i = 1 and " + _has(0), "merged into its row"),
    # caps against the worksheet's row: unlike amounts give caps, equal ones the row
    ("(i = 8 and amount <> max(case when i = 22 then amount end) over s) or (i = 22 and amount = max(case when i = 8 then amount end) over s)", "merged into its row"),
    ("i = 3 and " + _has(4), "repairs of a scan"),
    (f"i in (1, 2) and {_has(0, 19)}", "rent of a statement"),
    ("i = 10 and " + _has(9), "pay of a statement"),
    ("i = 11 and " + _has(9), "pay of a form''s line"),
    (f"i = 13 and {_has(TAXES_AT)}", "form''s line"),
    (f"i in (0, 1) and {_has(19)}", "form''s line"),
    (f"(i in (8, 22) and {_BANK} > case i when 8 then 1000000000 else amount end) or (i = 7 and {_OTHER_BANK} >= amount)", "statement detail"),
    ("i = 6 and " + _has(5), "statement detail"),
    ("i = 10 and " + _has(11), "statement detail"),
    (f"{_TAXES} is not null and category = 'taxes_licenses' and ord <> coalesce(min(case when live and category = 'taxes_licenses' and amount = {_TAXES} then ord end) over s, min(case when live and category = 'taxes_licenses' then ord end) over s)", "other taxes"),
)


def _pool_sql() -> str:
    steps = ",\n".join(_step(n + 1, test, reason) for n, (test, reason) in enumerate(_PASSES))
    return f"""
with kinds(i, label, source, category, key, fate) as (values {_LINES}),
raw as (select o_custkey as client, year(o_orderdate) as year, l_orderkey * 10 + l_linenumber as ord, l_partkey % {len(LINES)} as i, cast(floor(l_extendedprice + 0.5) as bigint) as amount from lineitem join orders on l_orderkey = o_orderkey),
own as (select distinct client, year, {1 << 40} as ord, {TAXES_AT} + client % 3 as i, {_TAXES} as amount from raw where client % 3 < 2),
u as (select client, year, i, amount, min(ord) as ord from (select * from raw union all select * from own) group by 1, 2, 3, 4),
j as (select u.*, kinds.* exclude (i, fate), case when client % 3 = 1 and category = 'taxes_licenses' and amount <> {_TAXES} then 'replaced by a split' when amount in {FORM_NUMBERS} or amount between 1990 and 2035 then 'no amount' when fate <> 'rest' then fate end as reason, coalesce(fate = 'rest', false) as is_rest from u join kinds using (i)),
g as (select *, reason is null as fine, row_number() over (partition by client, year, key, reason is null order by amount desc, ord) as place, min(ord) over (partition by client, year, key, reason is null) as first_ord from j),
p0 as (select client, year, i, amount, first_ord as ord, label, source, category, key, is_rest, null::varchar as reason, true as live from g where fine and place = 1),
{steps}
select client, year, case when i = 22 and reason is distinct from 'merged into its row' and exists (select 1 from p0 where p0.client = z.client and p0.year = z.year and p0.i = 8) then 'row:bank_credit_card' else key end as key, label, amount, case when is_rest then source || ' (residual crumb)' else source end as source, is_rest as rest, reason from p{len(_PASSES)} z
union all select client, year, key, label, amount, case when is_rest and reason is null then source || ' (residual crumb)' else source end, is_rest and reason is null, coalesce(reason, 'another line of its group') from g where not fine or place > 1
"""


@query(_pool_sql())
def rank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pool_lines(spark, sf_dir)
    return pool.rank_pool(lines, slots(lines), ["client", "year"], "year", TITLES).drop("ord")


@query(f"""
with kinds(i, label, source, category, key, fate) as (values {_LINES}),
raw as (select o_custkey as client, year(o_orderdate) as year, l_partkey % {len(LINES)} as i, cast(floor(l_extendedprice + 0.5) as bigint) as amount from lineitem join orders on l_orderkey = o_orderkey),
tops as (select distinct client, year, amount, dense_rank() over (partition by client, year order by amount desc) as place from raw), top8 as (select * from tops where place <= 8 and amount not in {FORM_NUMBERS} and amount not between 1990 and 2035),
t as (select client, year, sum(amount) as pool, sum(amount) // 2 as total from raw group by 1, 2),
d as (select client, year, amount, bool_or(source like 'Statement%') as stmt from raw join kinds using (i) group by 1, 2, 3),
x as (select d.client, d.year, coalesce(sum(d.amount) filter (stmt and top8.amount is not null), 0) as inside, coalesce(sum(top8.amount), 0) as tops from d left join top8 using (client, year, amount) group by 1, 2)
select client, year, t.total::bigint as total, inside::bigint as inside, (case when split then t.total - inside else greatest(0, pool - tops) end)::bigint as rest, case when split then 'Operating expenses (stmt total − stmt lines in top-8)' else 'Operating expenses residual (sum(pool) − sum(top-8))' end as source
from (select *, t.total not in {FORM_NUMBERS} and t.total not between 1990 and 2035 and inside >= 1 and inside not in {FORM_NUMBERS} and inside not between 1990 and 2035 and t.total >= inside as split from x join t using (client, year)) t
""")
def partition_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = ["client", "year"]
    lines = pool_lines(spark, sf_dir, *sheet)
    tops = ranking.top_distinct(lines, sheet, "amount", 8)
    totals = lines.groupBy(*sheet).agg(F.floor(F.sum("amount") / 2).cast("long").alias("total"))
    return pool.partition_rest(lines, tops, totals, sheet)


def final_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Read cells with some edits, each year's worksheet of the year before, the pool, and printed totals, dealt by sheet and client.

    Totals go by way of the labels' sums, so that they read the pool's lines as they were dealt.
    """
    own = returns.cells(spark, sf_dir)
    edited = (F.col("field_id") == "rent") & ((F.col("client") + F.col("year")) % 11 == 0)
    base = own.select("client", "year", "field_id", F.col("value").alias("baseline"), F.col("confidence").alias("baseline_confidence"), F.col("source").alias("baseline_source"))
    state = base.withColumns({"value": F.when(edited, 4242).otherwise(7).cast("long"), "confidence": F.lit(99), "source": F.when(edited, "manual entry").otherwise("an earlier run"), "edited": edited})
    comparisons = own.select("client", "year", (F.col("year") - 1).alias("prior_year"), "field_id", (F.col("value") + 5).alias("value"))
    lines = pool_lines(spark, sf_dir, "client")
    sums = lines.groupBy("client", "year", "label").agg(F.sum("amount").alias("amount"))
    return state, comparisons, lines, sums.groupBy("client", "year").agg(F.floor(F.sum("amount") / 2).cast("long").alias("total"))


_SLOTS = ", ".join(f"({i + 1}, '{f}')" for i, f in enumerate(final.SLOTS))
_ODD = returns.SUSPICIOUS_SQL


@query(f"""
with {returns.CELLS_SQL}, {returns.SOURCE_SQL},
base as (select client, year, field_id, case when field_id = 'rent' and (client + year) % 11 = 0 then 4242 else value end as value, case when field_id = 'rent' and (client + year) % 11 = 0 then 99 else conf end as conf, i, field_id = 'rent' and (client + year) % 11 = 0 as edited from cells),
prior as (select client, year - 1 as year, field_id, value + 5 as value, year as said, 1 as i, true as auth, false as weak from cells),
fill as (select * from prior where not {_ODD} and field_id not in ('depreciation', 'amortization', 'other_income', 'other_operating_income') and (client, year) in (select (client, year) from cells)),
meet as (select client, year, field_id, coalesce(b.edited, false) as edited, b.value, b.conf, b.i, f.value as new, f.said, f.value is not null and not coalesce(b.edited, false) and (b.value is null or (b.i = 2 and b.conf < 85)) as take from base b full join fill f using (client, year, field_id)),
shown as (select client, year, field_id, edited, case when take then new else value end as value, case when take then 88 else conf end as conf, case when edited then 10 when take then 1 else i end as i, case when edited then 'manual entry' when take then 'Two-year comparison (from ' || said || ' return)' else {returns.sql_list(returns.SOURCES)}[i + 1] end as source from meet),
kept as (select s.* exclude (value, conf, source), case when not edited and odd then null else value end as value, case when not edited and odd then null else conf end as conf, case when not edited and odd then null else source end as source from (select shown.*, {_ODD} as odd from shown join src using (i)) s),
kinds(n, label, said, category, key, fate) as (values {_LINES}), slot(place, field_id) as (values {_SLOTS}),
lines as (select o_custkey as client, year(o_orderdate) as year, label, said, cast(floor(l_extendedprice + 0.5) as bigint) as amount from lineitem join orders on l_orderkey = o_orderkey join kinds on n = l_partkey % {len(LINES)}),
top as (select client, label, row_number() over (partition by client order by sum(amount) desc, label) as place from lines group by 1, 2),
seats as (select s.client, s.year, field_id, place, coalesce(sum(l.amount), 0) as amount from (select distinct client, year from lines) s join top on top.client = s.client and place <= 8 join slot using (place) left join lines l on l.client = s.client and l.year = s.year and l.label = top.label group by all),
tops as (select distinct client, year, amount from seats where amount >= 1 and amount < 1000000000 and amount not in {FORM_NUMBERS} and amount not between 1990 and 2035),
sums as (select client, year, sum(amount) as pool, sum(amount) // 2 as total from lines group by 1, 2),
d as (select client, year, amount, bool_or(said like 'Statement%') as stmt from lines group by 1, 2, 3),
x as (select d.client, d.year, coalesce(sum(d.amount) filter (stmt and tops.amount is not null), 0) as inside from d left join tops using (client, year, amount) group by 1, 2),
y as (select client, year, coalesce(sum(amount), 0) as tops from (select distinct client, year, place, amount from seats where amount in (select amount from tops t where t.client = seats.client and t.year = seats.year)) group by 1, 2),
r as (select client, year, case when t.total not in {FORM_NUMBERS} and t.total not between 1990 and 2035 and inside >= 1 and inside not in {FORM_NUMBERS} and inside not between 1990 and 2035 and t.total >= inside then t.total - inside else greatest(0, pool - coalesce(y.tops, 0)) end as rest, t.total >= inside and inside >= 1 and t.total not in {FORM_NUMBERS} and t.total not between 1990 and 2035 and inside not in {FORM_NUMBERS} and inside not between 1990 and 2035 as split from x join sums t using (client, year) left join y using (client, year)),
own as (select client, year, field_id, amount::bigint as value, 90 as conf, 'Operating expenses (top-8 slot ' || place || ')' as source from seats union all select client, year, 'other_operating_expenses', rest::bigint, 88, case when split then 'Operating expenses (stmt total − stmt lines in top-8)' else 'Operating expenses residual (sum(pool) − sum(top-8))' end from r)
select client, year, field_id, case when own.value is not null and not coalesce(edited, false) then own.value else kept.value end as value, (case when own.value is not null and not coalesce(edited, false) then own.conf else kept.conf end)::int as confidence, case when own.value is not null and not coalesce(edited, false) then own.source else kept.source end as source, coalesce(edited, false) as edited from kept full join own using (client, year, field_id)
""")
def finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finalized twice: the second run starts from the first one's result."""
    state, *rest = final_inputs(spark, sf_dir)
    out = final.finalize(final.finalize(state, *rest), *rest)
    return out.select("client", "year", "field_id", "value", "confidence", "source", "edited")
