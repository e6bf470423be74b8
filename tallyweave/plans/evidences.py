"""Queries over evidence: lines and pages are built from whole orders and their lines; the SQL twins know what each says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import FORM_NUMBERS, whole
from ..operators import evidence
from .registry import query, spread, table

FIELDS = ("inventory", "other_assets", "other_current_assets", "gross_intangible_assets", "unclassified_equity", "cash", "other_income")
CAPTIONS = ("3 Inventories", "14 Other assets", "6 Other current assets", "13 Intangibles", "24 Retained", "1 Cash", "5 Other income")


@query(f"""
with r as (select l_orderkey as k, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice + 0.5) as bigint) as p, l_partkey % 7 as i, l_suppkey % 2 = 0 as ocr, l_suppkey % 3 as shown from lineitem),
c as (select k, i, arg_min(p, (l_linenumber, l_partkey, l_suppkey, p)) as value, arg_min(ocr, (l_linenumber, l_partkey, l_suppkey, p)) as ocr from r group by 1, 2),
l as (select distinct k, i, case when p in {FORM_NUMBERS} then null else case when shown = 0 then p + 1 else p end end as amount from r where not (case when shown = 0 then p + 1 else p end in {FORM_NUMBERS}))
select k, ['inventory', 'other_assets', 'other_current_assets', 'gross_intangible_assets', 'unclassified_equity', 'cash', 'other_income'][i + 1] as field_id, case when ocr and i < 3 and not exists (select 1 from l where l.k = c.k and l.i = c.i and l.amount = c.value) then 'uncorroborated caption' when ocr and i in (3, 4) then 'caption alone' when i = 6 and value in {FORM_NUMBERS} then 'form number' end as cleared from c
""")
def uncorroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of an order, and a line for each of its items, a third of them a dollar off."""
    r = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", whole(F.col("l_extendedprice")).alias("p")), "k").withColumn("i", (F.col("l_partkey") % 7).cast("int"))
    at = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("i"))
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p"))
    cells = r.groupBy("k", "i").agg(first.alias("w")).select("k", at(FIELDS).alias("field_id"), F.col("w.p").alias("value"), F.when(F.col("w.l_suppkey") % 2 == 0, evidence.CAPTION_ONLY).otherwise("Schedule L").alias("source"))
    lines = r.select("k", F.concat(at(CAPTIONS), F.lit(" "), F.format_number(F.col("p") + F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0), 0)).alias("line"))
    return evidence.corroborated(cells, lines, ["k"]).select("k", "field_id", "cleared")


@query("""
with p as (select l_orderkey as k, l_linenumber as page, min(cast(l_quantity as int)) as q, min(l_partkey) % 4 as kind from lineitem group by 1, 2),
h as (select k, page, q, kind, case kind when 0 then 0 when 1 then 1 when 2 then 2 end as ord, case when page = 2 then 0 else 1 end as scope from p),
c as (select k, 'current_ratio' as fact, arg_min(case when kind = 0 then q || '.5' else q || '.25' end, (ord, scope, page)) as value, arg_min(page, (ord, scope, page)) as page from h where kind < 3 group by 1),
e as (select k, 'return_on_equity' as fact, arg_min(q || '.0', (case when page = 8 then 0 else 1 end, page)) as value, arg_min(page, (case when page = 8 then 0 else 1 end, page)) as page from h where kind = 3 group by 1),
i as (select k, 'return_on_equity_industry' as fact, arg_min((q + 1) || '.5', (case when page = 8 then 0 else 1 end, page)) as value, arg_min(page, (case when page = 8 then 0 else 1 end, page)) as page from h where kind = 3 and q % 2 = 0 group by 1)
select k, fact, value, cast(page as int) as page from (select * from c union all select * from e union all select * from i)
""")
def scoped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of an order's report, each with one of four ways to say a ratio.

    Items are dealt by order before they are grouped: few of them share a page,
    so that groups on the reading side would hold nearly all rows of a split.
    """
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("page_no"), F.col("l_quantity").cast("int").alias("q"), "l_partkey")
    p = spread(items, "k").groupBy("k", "page_no").agg(F.min("q").alias("q"), (F.min("l_partkey") % 4).alias("kind"))
    q = F.col("q").cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    text = (
        F.when(F.col("kind") == 0, say("Ratios\nCurrent Ratio ", q, ".5 1.0 to 2.0")).when(F.col("kind") == 1, say("Current Ratio ", q, ".25 4.5\nend")).when(F.col("kind") == 2, say("current ratio ", q, ".25"))
        .otherwise(say("Return on Equity ", q, ".0 %", F.when(F.col("q") % 2 == 0, say(" ", (F.col("q") + 1).cast("string"), ".5 %")).otherwise(" -")))
    )
    return evidence.scoped_facts(p.select("k", "page_no", text.alias("text")), ["k"])


@query("""
with g as (select l_orderkey as k, sum(cast(floor(l_extendedprice + 0.5) as bigint)) as s, min(cast(floor(l_extendedprice + 0.5) as bigint)) as b, sum(l_suppkey) as x from lineitem group by 1),
v as (select *, case when x % 2 = 0 then s end as form, case x % 3 when 0 then s when 1 then b end as stmt, case x % 5 when 0 then s when 1 then b end as comp, case when x % 7 = 0 then -1 when x % 7 = 1 then b end as books, x % 11 < 4 as points, x % 13 = 0 as detail, x % 4 <> 1 as reports, x % 6 = 5 as refund, x % 9 as matched, x % 8 < 4 as own from g),
w as (select *, coalesce(stmt = form, false) as same, reports and not refund and not detail as plain, comp is not null and comp not between 1990 and 2035 and comp not in (1040, 1099, 1120, 1125, 4562, 8990, 3800, 7004, 2220) as good from v),
z as (select *, points and not (plain and same) and not reports and coalesce(comp > 0 and comp = form, false) and refund and (books is null or books > 0) as op from w)
select k, case when points then case when plain and same then stmt when op then null when good then comp when stmt > 0 and reports and not detail then stmt else 0 end when own and form is not null and reports then form when comp is not null and matched >= 5 then comp when form is not null and reports and comp is null then form when stmt is not null and plain then stmt end as other_income, case when op then coalesce(books, comp) end as other_operating_income from z
""")
def income_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), whole(F.col("l_extendedprice")).alias("p"), "l_suppkey").groupBy("k").agg(F.sum("p").alias("s"), F.min("p").alias("b"), F.sum("l_suppkey").alias("x"))
    s, b, x = F.col("s"), F.col("b"), F.col("x")
    routed = evidence.income_routing({
        "form": F.when(x % 2 == 0, s), "statement": F.when(x % 3 == 0, s).when(x % 3 == 1, b), "comparison": F.when(x % 5 == 0, s).when(x % 5 == 1, b), "books": F.when(x % 7 == 0, -1).when(x % 7 == 1, b),
        "kind": F.when(x % 8 < 4, "1120").otherwise("1120-s"), "points": x % 11 < 4, "on_page": F.lit(False), "detail": x % 13 == 0, "reports": x % 4 != 1, "refund": x % 6 == 5, "matched": x % 9,
    })
    return g.select("k", routed.alias("r")).select("k", "r.other_income", "r.other_operating_income")


@query("""
with p as (select l_orderkey as k, l_linenumber as page, min(l_partkey) % 6 as kind from lineitem group by 1, 2),
d as (select k, count(*) as n, bool_or(kind in (0, 1)) as stmt, bool_or(kind = 0) as ref, bool_or(kind = 2) as sheet, bool_or(kind = 3) as form, bool_or(kind = 4) as sched from p group by 1),
f as (select k, case when k % 3 = 0 then 100 end as total, case when k % 2 = 0 then 40 end as comp, k % 5 < 3 as found, 30 as detail, case when k % 4 = 0 then 70 when k % 4 = 1 then 60 end as rest, 30 as known from d),
g as (select *, case when rest is not null and total > 0 then abs(known + rest - total) <= 1 end as closes from d join f using (k)),
flags as (select k, list_filter([case when not found and sheet then 'comparison-missing-in-ocr' end, case when found and comp is null then 'comparison-worksheet-missing-other-deductions-row' end, case when detail < comp then 'stmt2-detail-incomplete' end, case when total is null and stmt then 'stmt2-missing-lines' end, case when not closes then 'formula-inconsistency-opex-closure' end, case when total is null and ref then 'stmt2-total-unparseable' end, case when not sched and form then 'schedule-l-not-detected' end, case when n < 4 then 'page-truncation-suspected' end], lambda q: q is not null) as flags from g)
select p.k, cast(page as int) as page_no from p join flags using (k) where not (page = 1) and ((kind = 2 and (list_contains(flags, 'comparison-missing-in-ocr') or list_contains(flags, 'comparison-worksheet-missing-other-deductions-row'))) or (kind in (0, 1) and (list_contains(flags, 'stmt2-detail-incomplete') or list_contains(flags, 'stmt2-missing-lines') or list_contains(flags, 'formula-inconsistency-opex-closure'))) or (kind = 0 and list_contains(flags, 'stmt2-total-unparseable')) or (kind = 3 and list_contains(flags, 'schedule-l-not-detected')))
""")
def coverage_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages to read again, where the first page of each document has been read again before."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("page_no")).agg((F.min("l_partkey") % 6).cast("int").alias("kind"))
    words = ("see stmt 2", "Other deductions", "Comparison worksheet", "Form 1120", "Schedule L", "Notes")
    pages = p.select("k", "page_no", F.get(F.array(*map(F.lit, words)), F.col("kind")).alias("text"))
    k = F.col("k")
    facts = pages.select("k").distinct().select("k", F.when(k % 3 == 0, 100).alias("statement_total"), F.when(k % 2 == 0, 40).alias("comparison_total"), (k % 5 < 3).alias("comparison_found"), F.lit(30).alias("detail_sum"), F.when(k % 4 == 0, 70).when(k % 4 == 1, 60).alias("rest"), F.lit(30).alias("known"), F.lit(False).alias("schedule_found"))
    found = evidence.coverage(pages, facts, ["k"])
    return evidence.rescan(pages, found, pages.where("page_no = 1"), ["k"])
