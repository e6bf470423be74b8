"""Queries over texts, pages and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import extract, matching, merging, ranking, verify
from ..sources import documents
from .registry import query, table

PART_RULES = (("promoted", "(?i)promo"), ("small metal", "(?i)^small.*"), ("coloured", r"(?i)\b(red|blue|green)\b"), ("fastener", r"(?i)\b(bolt|nut|screw|ring)\b"))


@query(r"""
select p_partkey, case when regexp_matches(s, '(?i)promo') then 'promoted' when regexp_matches(s, '(?i)^small.*') then 'small metal' when regexp_matches(s, '(?i)\b(red|blue|green)\b') then 'coloured'
  when regexp_matches(s, '(?i)\b(bolt|nut|screw|ring)\b') then 'fastener' else 'other' end as category from (select p_partkey, p_type || ' ' || p_name as s from part)
""")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat_ws(" ", "p_type", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", labels.first_rule(subject, PART_RULES, "other").alias("category"))


TEXT_RULES = (("the_end", r"the\.$"), ("question", r"\?"), ("address", r"[\w.]@[\w.]"), ("license", r"(?i)licen[cs]e"), ("digits", r"\d{3,}"))
LINES_SQL = r"select doc_id, i as line_no, trim(regexp_replace(parts[i + 1], '[ \t\n\v\f\r]+', ' ', 'g')) as line from (select doc_id, parts, unnest(range(0, len(parts))) as i from (select doc_id, string_split_regex(text, '\r?\n') as parts from documents))"


@query(rf"""
with l as (select * from ({LINES_SQL}) where line <> '')
select doc_id, line_no, rule from l, (values ('the_end', 'the\.$'), ('question', '\?'), ('address', '[\w.]@[\w.]'), ('license', '(?i)licen[cs]e'), ('digits', '\d{{3,}}')) r(rule, p) where regexp_matches(line, p)
""")
def regex_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return matching.pattern_hits(rows, TEXT_RULES).select("doc_id", "line_no", "rule")


@query(f"select doc_id, cast(line_no as int) as line_no, length(line) as n_chars from ({LINES_SQL}) where line <> ''")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.lines(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "line_no", F.length("line").alias("n_chars"))


@query(f"select doc_id, cast(line_no as int) as line_no, length(line) as n_chars, length(lead(line) over (partition by doc_id order by line_no)) as n_next from ({LINES_SQL}) where line <> ''")
def line_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.lines(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "line_no", F.length("line").alias("n_chars"))
    return rows.withColumn("n_next", F.lead("n_chars").over(Window.partitionBy("doc_id").orderBy("line_no")))


@query("""
with r as (select *, sum(cast(event_type = 'signup' as int)) over (partition by user_id order by ts, event_id rows unbounded preceding) as block from events),
c as (select *, coalesce(max(cast(event_type = 'error' as int)) over (partition by user_id, block order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as closed from r where block > 0)
select user_id, cast(block as bigint) as block, count(*) filter (event_type <> 'error') as n, cast(coalesce(sum(cast(floor(value + 0.5) as bigint)) filter (event_type <> 'error'), 0) as bigint) as amount, max(cast(floor(value + 0.5) as bigint)) filter (event_type = 'error') as printed
from c where closed = 0 group by 1, 2
""")
def block_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", F.floor(F.col("value") + 0.5).alias("amount"))
    return extract.block_totals(rows, ["user_id"], "at", F.col("event_type") == "signup", F.col("event_type") == "error", "amount")


@query("""
select event_id, user_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_purchase from events
""")
def carry_forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("p"))
    return merging.carried(rows, ["user_id"], ["ts", "event_id"], "p", "last_purchase").select("event_id", "user_id", "last_purchase")


KINDS = {"english": {r"[ \n]the[ .,]": 2, r"[ \n]of[ .,]": 1}, "german": {r"[ \n]der[ .,]": 2, r"[ \n]und[ .,]": 1}, "french": {r"[ \n]les[ .,]": 2, r"[ \n]une[ .,]": 1}, "spanish": {r"[ \n]los[ .,]": 2, r"[ \n]del[ .,]": 1}}


@query(r"""
with s as (select doc_id, unnest([{'score': 2 * n(text, '[ \n]the[ .,]') + n(text, '[ \n]of[ .,]'), 'kind': 'english'}, {'score': 2 * n(text, '[ \n]der[ .,]') + n(text, '[ \n]und[ .,]'), 'kind': 'german'}, {'score': 2 * n(text, '[ \n]les[ .,]') + n(text, '[ \n]une[ .,]'), 'kind': 'french'}, {'score': 2 * n(text, '[ \n]los[ .,]') + n(text, '[ \n]del[ .,]'), 'kind': 'spanish'}]) as k from documents),
r as (select doc_id, k.score as score, k.kind as kind, row_number() over (partition by doc_id order by k.score desc, k.kind desc) as rn from s)
select a.doc_id, case when a.score >= 4 and a.score - b.score >= 2 then a.kind else 'unknown' end as kind from r a join r b on a.doc_id = b.doc_id and a.rn = 1 and b.rn = 2
""".replace("n(text, ", "len(regexp_extract_all(text, ").replace("[ .,]')", "[ .,]'))"))
def form_kind_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", verify.scored_kind(F.col("text"), KINDS, 4, 2).alias("kind"))


@query(r"""
with t as (select o_orderkey, case when o_orderkey % 3 = 0 then 'calendar year ' || year(o_orderdate) || ' filed in 2004 and 2004' when o_orderkey % 3 = 1 then 'from ' || (year(o_orderdate) - 1) || ' to ' || year(o_orderdate) || ', in all ' || (year(o_orderdate) - 1) else 'no date' end as text, 'scan_' || year(o_orderdate) || '.pdf' as file from orders),
n as (select o_orderkey, y, count(*) as n from (select o_orderkey, unnest(regexp_extract_all(text, '(?:19|20)[0-9]{2}')) as y from t) group by 1, 2),
m as (select o_orderkey, arg_max(y, (n, y)) as y from n group by 1)
select o_orderkey, cast(coalesce(nullif(regexp_extract(text, 'calendar year ((?:19|20)[0-9]{2})', 1), ''), m.y, nullif(regexp_extract(file, '((?:19|20)[0-9]{2})', 1), '')) as int) as year from t left join m using (o_orderkey)
""")
def year_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("calendar year "), y, F.lit(" filed in 2004 and 2004"))).when(k == 1, F.concat(F.lit("from "), y - 1, F.lit(" to "), y, F.lit(", in all "), y - 1)).otherwise("no date")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), F.concat(F.lit("scan_"), y, F.lit(".pdf")).alias("file"))
    return rows.select("o_orderkey", verify.inferred_year(F.col("text"), [r"calendar year ((?:19|20)\d\d)"], F.col("file")).alias("year"))


@query("""
with l as (select o_custkey as page_id, count(*) as score from orders where o_orderstatus = 'F' group by 1), r as (select o_custkey as page_id, 2 * count(*) as score from orders where o_orderstatus <> 'F' group by 1)
select page_id, case when t then 'right' else 'left' end as side, case when t then b else a end as score from (
  select coalesce(l.page_id, r.page_id) as page_id, l.score as a, r.score as b, l.score is null or (l.score < 20 and r.score is not null and r.score >= l.score + 8) as t from l full join r on l.page_id = r.page_id)
""")
def page_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), "o_orderstatus")
    read = lambda test, weight: o.where(test).groupBy("page_id").agg((F.count("*") * weight).alias("score"))
    return merging.chosen_pages(read("o_orderstatus = 'F'", 1), read("o_orderstatus <> 'F'", 2), ["page_id"])


@query("select c_custkey as page_id from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def delta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"))
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("page_id"))
    return merging.missing_pages(wanted, done, ["page_id"])


@query("select event_type, cast(json_extract_string(props, '$.k') as int) as k, count(*) as n from events group by 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""
select user_id, event_id, value from (select user_id, event_id, cast(floor(value + 0.5) as bigint) as value, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 5
""")
def correction_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor(F.col("value") + 0.5).alias("value"))
    return ranking.best(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).drop("ts")


@query("select event_type, cast(date_trunc('day', ts) as date) as day, count(*) as n from events group by 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.incremental import windowed_counts as counts

    return counts(table(spark, sf_dir, "events").select("ts", "event_type"), "ts", "1 day", ["event_type"]).select("event_type", F.to_date("start").alias("day"), "n")
