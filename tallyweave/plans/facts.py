"""Queries that merge, rank and verify amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import whole
from ..operators import consensus, formulas, matching, merging, ranking, verify
from ..sources import sheets
from .registry import query, table

YEARS = tuple(range(1995, 2002))
PRICE = "cast(floor(l_extendedprice + 0.5) as bigint)"
TOTAL = "cast(floor(o_totalprice + 0.5) as bigint)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("amount", whole(F.col("l_extendedprice")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("amount", whole(F.col("o_totalprice"))).withColumn("year", F.year("o_orderdate"))


@query(f"""
with c as (select p_brand, year(l_shipdate) as year, sum({PRICE}) as amount from lineitem join part on l_partkey = p_partkey group by all),
w as (select p_brand from (select p_brand, sum(amount) as t from c group by 1) order by t desc, p_brand limit 8),
y as (select distinct year from c)
select y.year, w.p_brand as label, cast(coalesce(c.amount, 0) as bigint) as amount from y cross join w left join c on c.year = y.year and c.p_brand = w.p_brand
union all
select y.year, 'other', cast(coalesce(sum(c.amount) filter (c.p_brand not in (select p_brand from w)), 0) as bigint) from y left join c on c.year = y.year group by y.year
""")
def shared_topn_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return ranking.shared_top(rows.select("p_brand", F.year("l_shipdate").alias("year"), "amount"), "p_brand", "year", "amount", 8)


@query(f"""
select o_custkey, o_orderpriority, n, strength from (
  select *, row_number() over (partition by o_custkey order by n desc, strength desc, o_orderpriority) as rn from (
    select o_custkey, o_orderpriority, count(*) as n, round(avg({TOTAL}), 4) as strength from orders group by 1, 2)) where rn = 1
""")
def modal_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.modal(orders(spark, sf_dir), ["o_custkey"], "o_orderpriority", "amount")


@query("""
select l_partkey, bucket, weight from (
  select *, row_number() over (partition by l_partkey order by weight desc, bucket desc) as rn from (
    select l_partkey, cast(floor(l_extendedprice / 10000) as bigint) as bucket, cast(sum(cast(l_quantity as bigint)) as bigint) as weight from lineitem group by 1, 2)) where rn = 1
""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.floor(F.col("l_extendedprice") / 10000).alias("bucket"), F.col("l_quantity").cast("long").alias("q"))
    return consensus.weighted(rows, ["l_partkey"], "bucket", "q")


FAMILIES = {"A": 0, "N": 1, "R": 2}


@query("""
with r as (select l_partkey, l_returnflag, cast(floor(l_quantity + 0.5) as bigint) as value, cast(floor(100 * (1 - l_discount) + 0.5) as bigint) as conf from lineitem),
c as (select l_partkey, value, count(*) as reads, count(distinct l_returnflag) as families, max(conf) as confidence, min(case l_returnflag when 'A' then 0 when 'N' then 1 when 'R' then 2 else 3 end) as p from r group by 1, 2)
select l_partkey, value, reads, families, confidence, n as values from (select *, row_number() over (partition by l_partkey order by reads desc, families desc, confidence desc, p, value) as rn, count(*) over (partition by l_partkey) as n from c) where rn = 1
""")
def multi_source_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", whole(F.col("l_quantity")).alias("value"), whole(100 * (1 - F.col("l_discount"))).alias("conf"))
    return consensus.majority(rows, ["l_partkey"], "l_returnflag", "value", "conf", FAMILIES)


TIERS = (merging.Tier("lines", 50), merging.Tier("header", 84), merging.Tier("urgent", 95, authoritative=True))


@query(f"""
with r as (
  select o_orderkey, 'header' as tier, {TOTAL} as value, 80 + cast(o_orderkey % 20 as int) as confidence from orders
  union all select l_orderkey, 'lines', cast(sum({PRICE}) as bigint), 60 + cast(count(*) as int) * 5 from lineitem group by 1
  union all select o_orderkey, 'urgent', {TOTAL} + 1, 90 + cast(o_orderkey % 10 as int) from orders where o_orderpriority = '1-URGENT'
), k as (select *, case tier when 'lines' then 0 when 'header' then 1 else 2 end as rank from r where confidence >= case tier when 'lines' then 50 when 'header' then 84 else 95 end)
select o_orderkey, tier, value, confidence from (select *, row_number() over (partition by o_orderkey order by tier = 'urgent' desc, confidence desc, rank desc) as rn from k) where rn = 1
""")
def tiered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    header = o.select("o_orderkey", F.lit("header").alias("tier"), F.col("amount").alias("value"), (80 + F.col("o_orderkey") % 20).cast("int").alias("confidence"))
    summed = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit("lines").alias("tier"), F.sum("amount").alias("value"), (60 + F.count("*") * 5).cast("int").alias("confidence"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("urgent").alias("tier"), (F.col("amount") + 1).alias("value"), (90 + F.col("o_orderkey") % 10).cast("int").alias("confidence"))
    return merging.tiered(header.unionByName(summed).unionByName(urgent), ["o_orderkey"], TIERS)


@query(f"""
with b as (select o_custkey, max({TOTAL}) as value, cast(count(*) as int) as conf from orders where year(o_orderdate) <= 1998 group by 1),
i as (select o_custkey, max({TOTAL}) as value, cast(count(*) as int) as conf from orders where year(o_orderdate) > 1998 group by 1)
select o_custkey, case when w then iv else bv end as value, case when w then ic else bc end as confidence from (
  select coalesce(b.o_custkey, i.o_custkey) as o_custkey, b.value as bv, b.conf as bc, i.value as iv, i.conf as ic,
    i.value is not null and not coalesce(b.o_custkey % 10 = 0, false) and (b.value is null or i.conf >= coalesce(b.conf, -1)) as w
  from b full join i on b.o_custkey = i.o_custkey)
""")
def upsert_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    half = lambda part: part.groupBy("o_custkey").agg(F.max("amount").alias("value"), F.count("*").cast("int").alias("confidence"))
    base = half(o.where("year <= 1998")).withColumn("edited", F.col("o_custkey") % 10 == 0)
    return merging.upsert(base, half(o.where("year > 1998")), ["o_custkey"], protected="edited")


@query(f"""
with t as (select o_custkey, year(o_orderdate) as year, cast(sum({TOTAL}) as bigint) as total from orders group by 1, 2),
r as (select o_custkey, year, case when (o_custkey + year) % 3 = 0 then null else total end as value, lag(total) over (partition by o_custkey order by year) as prior from t)
select r.o_custkey, r.year, coalesce(r.value, n.prior) as value, r.prior from r left join r n on n.o_custkey = r.o_custkey and n.year - 1 = r.year
""")
def prior_period_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders(spark, sf_dir).groupBy("o_custkey", "year").agg(F.sum("amount").alias("total"))
    prior = F.lag("total").over(merging.Window.partitionBy("o_custkey").orderBy("year"))
    rows = t.select("o_custkey", "year", F.when((F.col("o_custkey") + F.col("year")) % 3 != 0, F.col("total")).alias("value"), prior.alias("prior"))
    return merging.backfilled(rows, ["o_custkey"], "year", "value", "prior").select("o_custkey", "year", "value", "prior")


@query(f"""
with t as (select o_custkey, year(o_orderdate) as year, cast(sum({TOTAL}) * case when o_custkey % 11 = 0 and year(o_orderdate) = 1997 then -1 when o_custkey % 13 = 0 and year(o_orderdate) = 1998 then 0 else 1 end as bigint) as total from orders group by o_custkey, year(o_orderdate)),
n as (select *, lag(total) over w as a, lead(total) over w as b from t window w as (partition by o_custkey order by year)),
f as (select o_custkey, year, total, x.s as s, case when greatest(abs(total), abs(x.s)) >= 1000 and total * x.s < 0 then 'sign' when greatest(abs(total), abs(x.s)) >= 1000 and (total = 0) <> (x.s = 0) then 'zero' when greatest(abs(total), abs(x.s)) >= 1000 and total * x.s > 0 and greatest(abs(total), abs(x.s)) >= 5 * least(abs(total), abs(x.s)) then 'jump' end as flag from n, (select unnest([a, b]) as s) x)
select o_custkey, year, total, coalesce(string_agg(distinct flag, ',' order by flag), '') as flags from f group by 1, 2, 3
""")
def yoy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when((F.col("o_custkey") % 11 == 0) & (F.col("year") == 1997), -1).when((F.col("o_custkey") % 13 == 0) & (F.col("year") == 1998), 0).otherwise(1)
    t = orders(spark, sf_dir).groupBy("o_custkey", "year").agg(F.sum("amount").alias("s")).select("o_custkey", "year", (F.col("s") * sign).alias("total"))
    return verify.change_flags(t, ["o_custkey"], "year", "total").withColumn("flags", F.concat_ws(",", "flags"))


INVOICE = (
    formulas.Formula("net", ("gross",), ("discount",)),
    formulas.Formula("total", ("net", "tax")),
    formulas.Formula("margin", ("total", "returned"), ("cost",), present=("total", "cost"), least=2),
)


@query("""
with s as (select l_orderkey, cast(sum(cast(floor(l_extendedprice + 0.5) as bigint)) as bigint) as gross, cast(sum(cast(floor(l_extendedprice * l_discount + 0.5) as bigint)) as bigint) as discount,
  cast(sum(cast(floor(l_extendedprice * l_tax + 0.5) as bigint)) filter (l_returnflag <> 'N') as bigint) as tax, cast(sum(cast(l_quantity as bigint)) filter (l_linestatus = 'F') as bigint) as cost from lineitem group by 1)
select l_orderkey, gross, discount, tax, cost, gross - discount as net, gross - discount + coalesce(tax, 0) as total, case when cost is not null then gross - discount + coalesce(tax, 0) - cost end as margin from s
""")
def formula_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda e: whole(F.expr(e))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(money("l_extendedprice")).alias("gross"), F.sum(money("l_extendedprice * l_discount")).alias("discount"),
        F.sum(F.when(F.col("l_returnflag") != "N", money("l_extendedprice * l_tax"))).alias("tax"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("long"))).alias("cost"))
    return formulas.evaluated(sums, INVOICE).drop("returned")


@query(f"""
select o_orderkey, total, lines, case when lines is null then 'unknown' when abs(total - lines) <= 100000 then 'closes' else 'open' end as state
from (select o_orderkey, {TOTAL} as total from orders) left join (select l_orderkey, cast(sum({PRICE}) as bigint) as lines from lineitem group by 1) on o_orderkey = l_orderkey
""")
def identity_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("amount").alias("lines"))
    rows = orders(spark, sf_dir).select("o_orderkey", F.col("amount").alias("total")).join(summed, "o_orderkey", "left")
    return rows.withColumn("state", formulas.closure(F.col("total"), F.col("lines"), 100_000))


@query(f"""
select l_suppkey, cast(sum({PRICE}) as bigint) as total, cast(coalesce(sum({PRICE}) filter (l_returnflag = 'R'), 0) as bigint) as chosen,
  cast(greatest(0, sum({PRICE}) - coalesce(sum({PRICE}) filter (l_returnflag = 'R'), 0)) as bigint) as residual from lineitem group by 1
""")
def residual_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.residual(lines(spark, sf_dir), ["l_suppkey"], "amount", F.col("l_returnflag") == "R")


@query("""
with r as (select l_orderkey, list(cast(l_quantity as bigint) order by l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint)) as q from lineitem group by 1)
select l_orderkey, f.claimed as claimed, f.used as used from (
  select l_orderkey, list_reduce(list_transform(q, lambda x: {'claimed': x, 'used': 1::bigint}), lambda a, x: case when a.claimed + x.claimed <= 60 then {'claimed': a.claimed + x.claimed, 'used': a.used + 1} else a end, {'claimed': 0::bigint, 'used': 0::bigint}) as f from r)
""")
def capped_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return ranking.capped_sum(rows, ["l_orderkey"], "q", ["l_linenumber", "l_partkey", "l_suppkey"], 60)


@query(f"select p_brand, cast(sum(m) as bigint) as amount from (select p_brand, p_type, max({PRICE}) as m from lineitem join part on l_partkey = p_partkey group by 1, 2) group by 1")
def max_per_key_then_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The largest amount of each part first, so that the join sees one row for each.
    tops = lines(spark, sf_dir).groupBy("l_partkey").agg(F.max("amount").alias("amount"))
    rows = tops.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return ranking.max_then_sum(rows, ["p_brand"], ["p_type"], "amount")


@query(f"""
select l_orderkey, case when count(*) filter (l_returnflag = 'A') >= 2 then cast(sum({PRICE}) filter (l_returnflag = 'A') as bigint) end as a_amount,
  case when count(*) filter (l_returnflag = 'N') >= 2 then cast(sum({PRICE}) filter (l_returnflag = 'N') as bigint) end as n_amount from lineitem group by 1
""")
def conditional_sum_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    def gated(flag: str):
        mine = F.when(F.col("l_returnflag") == flag, F.col("amount"))
        return F.when(F.count(mine) >= 2, F.sum(mine))

    return lines(spark, sf_dir).groupBy("l_orderkey").agg(gated("A").alias("a_amount"), gated("N").alias("n_amount"))


@query(f"""
with s as (select n_name, sum({TOTAL}) filter (c_mktsegment = 'BUILDING') as building, sum({TOTAL}) filter (c_mktsegment = 'MACHINERY') as machinery, sum({TOTAL}) as total
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1)
select n_name, cast(building as bigint) as building, cast(machinery as bigint) as machinery, cast(total as bigint) as total, round(building / nullif(total, 0), 6) as building_share, round(machinery / nullif(total, 0), 6) as machinery_share from s
""")
def common_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_customer = orders(spark, sf_dir).groupBy("o_custkey").agg(F.sum("amount").alias("amount"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = by_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    part = lambda s: F.sum(F.when(F.col("c_mktsegment") == s, F.col("amount")))
    wide = rows.groupBy("n_name").agg(part("BUILDING").alias("building"), part("MACHINERY").alias("machinery"), F.sum("amount").alias("total"))
    return formulas.common_size(wide, ["building", "machinery"], "total")


@query("""
select n_name, c_nationkey, n from nation left join (select c_nationkey, count(*) as n from customer where c_acctbal > 9000 and c_mktsegment = 'BUILDING' group by 1) on c_nationkey = n_nationkey
""")
def catalogue_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").where("c_acctbal > 9000 and c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nation = table(spark, sf_dir, "nation")
    return nation.join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_name", "c_nationkey", "n")


@query("select o_orderpriority as label, " + ", ".join(f"cast(sum({TOTAL}) filter (year(o_orderdate) = {y}) as bigint) as y{y}" for y in YEARS) + " from orders group by 1")
def pivot_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("field_id"), "year").agg(F.sum("amount").alias("value"))
    catalogue = cells.select("field_id", F.col("field_id").alias("label")).distinct()
    return sheets.sheet(cells, catalogue, YEARS).select("label", *[F.col(str(y)).alias(f"y{y}") for y in YEARS])


@query("""
select c_custkey, case when n is null then 'missing' else 'low confidence' end as reason from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey where n is null or n < 5
""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return verify.gaps(table(spark, sf_dir, "customer").select("c_custkey"), counts.withColumn("conf", F.col("n")), ["c_custkey"], "n", "conf", least=5)


@query("""
select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(floor(l_extendedprice + 0.5) as bigint) as amount from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by cast(floor(l_extendedprice + 0.5) as bigint) desc, l_partkey, l_suppkey) as rn from lineitem) where rn = 1
""")
def dedupe_key_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "amount")
    return ranking.deduped(rows, ["l_orderkey", "l_linenumber"], [F.desc("amount"), F.asc("l_partkey"), F.asc("l_suppkey")])


@query("""
select 'customer' as pool, c_custkey as key, c_name as label, cast(floor(c_acctbal + 0.5) as bigint) as amount from customer union all select 'supplier', s_suppkey, s_name, cast(floor(s_acctbal + 0.5) as bigint) from supplier
""")
def pool_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pool(name: str, p: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(name).alias("pool"), F.col(key).alias("key"), F.col(f"{p}_name").alias("label"), whole(F.col(f"{p}_acctbal")).alias("amount"))

    return pool("customer", "c", "c_custkey").unionByName(pool("supplier", "s", "s_suppkey"))


@query(f"""
with r as (select distinct l_orderkey, l_linenumber, l_partkey, {PRICE} as amount from lineitem)
select * from r where not exists (select 1 from r o where o.l_orderkey = r.l_orderkey and o.amount > r.amount)
""")
def anti_exists_other_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "amount").distinct()
    return matching.without_larger(rows, ["l_orderkey"], "amount")


@query(f"""
select o_custkey, amount, cast(rank as int) as rank from (select *, row_number() over (partition by o_custkey order by amount desc) as rank from (select distinct o_custkey, {TOTAL} as amount from orders)) where rank <= 8
""")
def topn_distinct_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_distinct(orders(spark, sf_dir), ["o_custkey"], "amount", 8)


@query(f"""
with r as (select o_custkey, o_orderstatus, row_number() over w as n, first(o_orderstatus) over w as top from orders window w as (partition by o_custkey order by {TOTAL} desc, o_orderkey))
select o_custkey, any_value(top) as o_orderstatus, arg_min(o_orderstatus, n) filter (o_orderstatus <> top) as other from r group by 1
""")
def runner_up_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.runner_up(orders(spark, sf_dir), ["o_custkey"], "o_orderstatus", [F.desc("amount"), F.asc("o_orderkey")])


@query("""
with e as (select l_suppkey, cast(l_quantity as bigint) as q, count(*) as e from lineitem where l_returnflag = 'A' group by 1, 2), a as (select l_suppkey, cast(l_quantity as bigint) as q, count(*) as a from lineitem where l_returnflag = 'N' group by 1, 2)
select l_suppkey, cast(sum(coalesce(e, 0)) as bigint) as expected, cast(sum(coalesce(a, 0)) as bigint) as actual, cast(sum(least(coalesce(e, 0), coalesce(a, 0))) as bigint) as matched, cast(sum(greatest(coalesce(a, 0) - coalesce(e, 0), 0)) as bigint) as surplus
from e full join a using (l_suppkey, q) group by 1
""")
def multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return matching.multiset_match(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'N'"), ["l_suppkey"], "q")


@query("""
select p_brand, p_partkey, price from (select p_brand, p_partkey, price, row_number() over (partition by p_brand order by abs(price - target), p_partkey) as rn from (
  select p_brand, p_partkey, cast(floor(p_retailprice * 100 + 0.5) as bigint) as price, 100000 as target from part)) where rn = 1
""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", whole(F.col("p_retailprice") * 100).alias("price"), F.lit(100_000).alias("target"))
    return matching.nearest(rows, ["p_brand"], "p_partkey", "price", "target")


@query("""
select user_id, event_type as value, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) where rn = 1
""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("value"))
    return merging.first_wins(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "value", "event_id")


@query("""
select user_id, event_type as value, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1
""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("value"))
    return merging.last_wins(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "value", "event_id")


@query("""
with b as (select user_id, cast(floor(sum(value) + 0.5) as bigint) as value from events where event_type = 'purchase' group by 1),
e as (select user_id, arg_max(cast(floor(value + 0.5) as bigint), event_id) as v from events where event_type = 'error' group by 1)
select b.user_id, coalesce(v, value) as value, v is not null as edited from b left join e using (user_id)
""")
def latest_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    base = events.where("event_type = 'purchase'").groupBy("user_id").agg(whole(F.sum("value")).alias("value"))
    edits = events.where("event_type = 'error'").select("user_id", "event_id", whole(F.col("value")).alias("v"))
    return merging.corrected(base, edits, ["user_id"], "value", "v", ["event_id"])


CAPS = {"error": 42, "signup": 58, "view": 72}


@query("""
select user_id, least(95, min(case event_type when 'error' then 42 when 'signup' then 58 when 'view' then 72 end)) as confidence, string_agg(distinct event_type, ',' order by event_type) as flags from events group by 1
""")
def confidence_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("flags"))
    return verify.capped(flags.withColumn("confidence", F.lit(95)), "confidence", "flags", CAPS).select("user_id", "confidence", F.concat_ws(",", "flags").alias("flags"))


@query("""
select cast(least(floor((doc_id % 101) * 10 / 100), 9) as int) as bin, count(*) as n, cast(sum(quality) as bigint) as correct, round(avg(quality), 6) as rate from labels group by 1
""")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 101).alias("conf"), F.col("quality"))
    return verify.calibration(rows, "conf", "quality")


@query("""
select doc_id, case when toxic = 1 then 'rejected' when quality = 1 and n_chars >= 2000 then 'verified' when quality = 1 then 'trusted' when quality = 0 then 'review' when n_chars < 200 then 'thin' else 'unlabelled' end as tier
from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) using (doc_id)
""")
def trust_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    q = F.col("quality")
    tier = verify.decided([("rejected", F.col("toxic") == 1), ("verified", (q == 1) & (F.col("n_chars") >= 2000)), ("trusted", q == 1), ("review", q == 0), ("thin", F.col("n_chars") < 200)], "unlabelled")
    return rows.select("doc_id", tier.alias("tier"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, rtrim(rtrim(printf('%.2f', round(round(l_discount, 4) * 100, 2)), '0'), '.') || '%' as discount, rtrim(rtrim(printf('%.4f', round(l_tax, 4)), '0'), '.') as tax, regexp_replace(cast(cast(floor(l_extendedprice + 0.5) as bigint) as varchar), '(\\d)(\\d{3})$', '\\1,\\2') as price from lineitem")
def percent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import labels

    rows = lines(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", labels.percent_text(F.round("l_discount", 4)).alias("discount"), labels.ratio_text(F.col("l_tax")).alias("tax"), labels.grouped_text(F.col("amount")).alias("price"))
