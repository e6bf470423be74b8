"""What is dealt by its keys once is not dealt again."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyweave.operators import evidence, pool, ranking
from tallyweave.operators.dealing import beside, spread


def more_shuffles(df):
    """Shuffles that Spark puts in because rows do not lie as a step needs them."""
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def without_broadcasts(spark, run):
    """As over large tables, where nothing is small enough to be sent to all."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_keys(df):
    """The keys of the shuffles that Spark adds."""
    return [x.split("(")[1].split("#")[0] for x in df._jdf.queryExecution().executedPlan().toString().split("hashpartitioning")[1:] if "ENSURE_REQUIREMENTS" in x.split("\n")[0]]


def test_finalize_shuffles_only_the_tables_join(spark, sf_dir):
    keys = without_broadcasts(spark, lambda: shuffled_keys(__spark_entry__.queries()["finalize"](spark, sf_dir)))
    assert set(keys) <= {"l_orderkey", "o_orderkey"}


@pytest.mark.parametrize("name", ["sheet_fill", "coherence_gates", "reconcile_year"])
def test_sheets_shuffle_only_the_tables_join(spark, sf_dir, name):
    keys = without_broadcasts(spark, lambda: shuffled_keys(__spark_entry__.queries()[name](spark, sf_dir)))
    assert set(keys) <= {"l_orderkey", "o_orderkey", "field_id"}  # the list of fields has its own


def test_uncorroborated_deals_each_side_once(spark, sf_dir):
    """Amounts of lines come beside the cells of their sheet where both lie."""
    assert without_broadcasts(spark, lambda: more_shuffles(__spark_entry__.queries()["uncorroborated"](spark, sf_dir))) == 0


def test_unknown_sheets_have_no_lines(spark):
    cells = spark.createDataFrame([(k, "inventory", 500, evidence.CAPTION_ONLY) for k in (1, None)], "k int, field_id string, value long, source string")
    lines = spark.createDataFrame([(1, "3 Inventories 500"), (1, "3 Inventories 500"), (None, "3 Inventories 500")], "k int, line string")
    assert {r.k: r.cleared for r in evidence.corroborated(cells, lines, ["k"]).collect()} == {1: None, None: "uncorroborated caption"}


def test_comparison_lines_are_written_once(spark, sf_dir):
    """A line is a column before it is read: each of its five forms formats its numbers once, nine in all."""
    plan = __spark_entry__.queries()["comparison_columns"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("format_number") <= 11


def test_taxes_split_deals_numbers_not_lines(spark, sf_dir):
    """The items and the orders' keys are dealt, before any line is written; no mark has a scan of its own."""
    df = __spark_entry__.queries()["taxes_split"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and without_broadcasts(spark, lambda: more_shuffles(df)) == 0


def test_candidates_are_dealt_once_and_their_filter_is_short(spark, sf_dir):
    df = __spark_entry__.queries()["candidate_ranking"](spark, sf_dir)
    asked = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if " Filter " in x]
    assert asked and max(x.count("RLIKE") + x.count("winner") for x in asked) <= 2  # the steps that choose a winner are not moved into it
    assert without_broadcasts(spark, lambda: more_shuffles(df)) == 0


def test_pages_are_grouped_where_they_are_dealt(spark, sf_dir):
    """No group is held on the reading side, where a split has as many as rows."""
    df = __spark_entry__.queries()["scoped_facts"](spark, sf_dir)
    reading = df._jdf.queryExecution().executedPlan().toString().split("Exchange")
    assert len(reading) == 2 and "Aggregate" not in reading[1]
    assert without_broadcasts(spark, lambda: more_shuffles(df)) == 0


def test_beside_is_a_left_join(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, None, 3), (2, "a", 4)], "k int, f string, v int")
    b = spark.createDataFrame([(1, "a", "x"), (1, None, "y"), (3, "a", "z"), (2, "a", None)], "k int, f string, w string")
    assert sorted(map(str, beside(a, b, ["k", "f"]).collect())) == sorted(map(str, a.join(b, ["k", "f"], "left").select("k", "f", "v", "w").collect()))


def test_partition_of_dealt_rows_stays(spark):
    p = spread(spark.range(40).select((F.col("id") % 4).alias("k"), F.lit("Bank").alias("label"), F.col("id").alias("amount"), F.lit("Statement 2").alias("source")), "k")
    sums = p.groupBy("k").agg(F.sum("amount").alias("total"))
    assert without_broadcasts(spark, lambda: more_shuffles(pool.partition_rest(p, p.select("k", "amount"), sums, ["k"]))) == 0


def test_unknown_keys_meet_nothing(spark):
    p = spark.createDataFrame([(None, "Bank", 500, "Statement 2"), (1, "Bank", None, "Statement 2")], "k int, label string, amount long, source string")
    got = pool.partition_rest(p, spark.createDataFrame([(None, 500), (2, 700)], "k int, amount long"), spark.createDataFrame([(None, 900), (2, 900)], "k int, total long"), ["k"])
    assert {r.k: (r.total, r.inside, r.rest) for r in got.collect()} == {None: (None, 0, 500), 1: (None, 0, 0)}


def test_capped_groups_are_added_as_one_by_one():
    rng = np.random.default_rng(3)
    n = np.concatenate([rng.integers(1, 9, 300), [ranking.SHORT, ranking.SHORT + 1, 500, 1]])
    amounts, there = rng.integers(-5, 40, n.sum()), rng.random(n.sum()) < 0.9
    starts = np.cumsum(n) - n
    sums, used = ranking.capped_groups(amounts, there, starts, 60, (13, 2))
    want = [ranking.skipping_sum(amounts[a : a + k][there[a : a + k]], 60 - (13 if a == 0 else 0)) for a, k in zip(starts, n, strict=True)]
    want[0] = (want[0][0] + 13, want[0][1] + 2)
    assert list(zip(sums.tolist(), used.tolist(), strict=True)) == want


def test_capped_sum_sends_keys_in_batches(spark, monkeypatch):
    """Of 20,000 keys of a task, not each in a batch of its own."""
    rows = spark.range(60000, numPartitions=1).select((F.col("id") % 20000).alias("k"), F.col("id").alias("i"), (F.col("id") % 41).alias("v"))
    sent = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: sent.setdefault("run", run) and self)
    ranking.capped_sum(rows, ["k"], "v", ["i"], 60)
    batch = pa.RecordBatch.from_pydict({"k": [i // 3 for i in range(6000)], "__tag": [i // 3 for i in range(6000)], "__amount": list(range(6000))})
    out = list(sent["run"](iter([batch, batch.slice(5999)])))
    assert sum(b.num_rows for b in out) == 2000 and len(out) <= 4
