"""Operators on small tables with results worked out by hand."""

import random

from pyspark.sql import functions as F

from tallyweave.operators import consensus, extract, formulas, matching, merging, ranking, verify
from tallyweave.operators.extract import LineRule


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_tiers(spark):
    tiers = [merging.Tier("fuzzy", 50), merging.Tier("structured", 95), merging.Tier("form", 0, True), merging.Tier("schedule", 0, True)]
    reads = spark.createDataFrame([("a", "fuzzy", 60, 1), ("a", "structured", 60, 2), ("b", "fuzzy", 97, 1), ("b", "structured", 97, 2), ("c", "fuzzy", 99, 1), ("c", "form", 1, 2), ("d", "form", 90, 1), ("d", "schedule", 10, 2), ("e", "fuzzy", 10, 1)], "field string, tier string, confidence int, value int")
    assert rows(merging.tiered(reads, ["field"], tiers), "field", "value") == [("a", 1), ("b", 2), ("c", 2), ("d", 2)]


def test_upsert_protects_edits(spark):
    base = spark.createDataFrame([(1, 10, 80, False), (2, 20, 80, True), (3, None, None, False), (4, 40, 80, False)], "k int, value int, confidence int, edited boolean")
    new = spark.createDataFrame([(1, 11, 80), (2, 21, 99), (3, 31, 5), (4, 41, 79), (5, 51, 1), (6, None, 1)], "k int, value int, confidence int")
    assert rows(merging.upsert(base, new, ["k"], protected="edited"), "k", "value") == [(1, 11), (2, 20), (3, 31), (4, 40), (5, 51), (6, None)]


def test_company_switch(spark):
    base = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2)], "c string, y int")
    new = spark.createDataFrame([("y", 2), ("y", 3)], "c string, y int")
    assert rows(merging.switched(base, new, "c", "y"), "c", "y") == [("x", 1), ("y", 2)]


def test_resolved_hits(spark):
    hits = spark.createDataFrame([("sales", 5, 90), ("sales", 5, 80), ("sales", 7, 99), ("assets", 1, 90), ("assets", 9, 60), ("cash", 1, 40)], "field_id string, value long, confidence int")
    got = consensus.resolved(hits, ["field_id"], "value", "confidence", 45, largest=["assets"])
    assert rows(got, "field_id", "value", "confidence", "conflicted") == [("assets", 9, 48, True), ("sales", 5, 78, True)]


def test_disagreement(spark):
    s = spark.createDataFrame([(1, "a", 5, 5), (1, "b", 6, 5), (2, "a", 5, 5), (2, "b", 5, 5), (2, "c", 6, 5), (3, "a", 4, 5)], "k int, family string, value int, now int")
    assert rows(consensus.disagreement(s, ["k"], "family", "value", "now"), "k", "material") == [(1, True), (2, False), (3, False)]


def test_workbook(spark):
    df = spark.createDataFrame([(1, 100, 40, 5, None, 7, -3, 10, None), (2, None, None, None, None, None, None, None, 9)], "y int, sales long, cogs long, depreciation long, amortization long, rent long, accumulated_depreciation long, gross_fixed_assets long, other_assets long")
    a, b = formulas.evaluated(df).orderBy("y").collect()
    assert (a.gross_profit, a.depreciation_amortization, a.operating_profit, a.net_income) == (60, 5, 48, 48)
    assert (a.net_fixed_assets, a.total_assets, a.total_liabilities) == (7, 7, None)
    assert b.gross_profit is None and b.total_assets is None


def test_audit_finds_wrong_totals(spark):
    df = spark.createDataFrame([(1, 100, 40, 60), (2, 100, 40, 75)], "y int, sales long, cogs long, gross_profit long")
    assert [r.mismatches for r in formulas.audited(df).orderBy("y").collect()] == [[], ["gross_profit"]]


def test_residual_is_solved(spark):
    df = spark.createDataFrame([(10, 3, 4, None), (10, 3, 8, None), (10, 3, None, None), (10, 1, 1, 5)], "t long, a long, b long, c long")
    assert [r.c for r in formulas.solved_residual(df, "c", "t", ["a", "b"]).collect()] == [3, None, None, 5]


def test_long_and_wide(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, 7)], "k int, a long, b long")
    cells = formulas.long(df, ["k"], ["a", "b"])
    assert rows(cells, "k", "field_id", "value") == [(1, "a", 5), (2, "b", 7)]
    assert rows(formulas.wide(cells, ["k"], ["a", "b"]), "k", "a", "b") == rows(df, "k", "a", "b")


def test_line_hits(spark):
    text = ["7 Compensation of officers 120,000", "8 Salaries and wages", "45,500", "11 Rents 1,200 300", "Rents received elsewhere 9,999", "13 Interest"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc int, line_no int, line string")
    rules = [LineRule("officers", "compensation of officers", 98, line_no="7"), LineRule("wages", "salaries and wages", 98), LineRule("rent", r"\brents?\b", 97, pick="largest", exclude="received"), LineRule("interest", "interest", 96)]
    assert rows(extract.line_hits(lines, rules, ["doc"]), "field_id", "value") == [("officers", 120000), ("rent", 1200), ("wages", 45500)]


def test_blocks(spark):
    text = [("x", 9), ("H", None), ("a", 1), ("b", 2), ("T", 3), ("c", 50), ("H", None), ("d", 4), ("H", None), ("T", 0)]
    lines = spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate(text)], "doc int, n int, line string, amount long")
    got = extract.block_totals(lines, ["doc"], "n", F.col("line") == "H", F.col("line") == "T", "amount")
    assert rows(got, "block", "n", "amount", "printed") == [(1, 2, 3, 3), (2, 1, 4, None), (3, 0, 0, 0)]


def test_carried_captions(spark):
    text = ["Utilities", "1,500 1,700", "Rent paid 300", "4,000"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc int, line_no int, line string")
    got = extract.carried_captions(lines, ["doc"], "line_no")
    assert [(r.caption, r.amounts) for r in got.orderBy("line_no").collect()] == [("Utilities", [1500, 1700]), ("Rent paid", [300]), ("Rent paid", [4000])]


def test_triplets_do_not_overlap(spark):
    rnd = random.Random(1)
    for _ in range(6):
        text = [rnd.choice(["cap", "1", "2", "3", "4"]) for _ in range(40)]
        want, i = [], 0
        while i + 3 < len(text):
            if all(t.isdigit() for t in text[i + 1 : i + 4]):
                want.append(i)
                i += 4
            else:
                i += 1
        lines = spark.createDataFrame([(1, n, t) for n, t in enumerate(text)], "doc int, n int, line string")
        got = extract.triplets(lines, ["doc"], "n", F.col("line").rlike(r"^\d+$"))
        assert sorted(r.n for r in got.collect()) == want


def test_matching(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, True), ("b", 4, True), ("c", 5, False)], "k string, id int, f boolean")
    assert rows(matching.with_other(df, ["k"], "id", "f"), "id") == [(2,), (3,), (4,)]
    names = spark.createDataFrame([("blue river mill", "river trading"), ("ab cd", "ab ce"), ("north", "north star")], "a string, b string")
    assert [r[0] for r in names.select(matching.share_tokens("a", "b", ["trading"])).collect()] == [True, False, True]


def test_shared_top_in_scopes(spark):
    df = spark.createDataFrame([("s", "a", 1, 10), ("s", "b", 1, 5), ("s", "b", 2, 8), ("s", "c", 2, 1), ("t", "c", 1, 2)], "scope string, l string, y int, v long")
    got = ranking.shared_top(df, "l", "y", "v", 1, ["scope"])
    assert rows(got, "scope", "y", "label", "amount") == [("s", 1, "b", 5), ("s", 1, "other", 10), ("s", 2, "b", 8), ("s", 2, "other", 1), ("t", 1, "c", 2), ("t", 1, "other", 0)]


def test_results_do_not_depend_on_row_order(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderpriority", F.floor("o_totalprice").alias("v"))
    for f in (lambda d: consensus.modal(d, ["o_custkey"], "o_orderpriority", "v"), lambda d: consensus.weighted(d, ["o_custkey"], "o_orderpriority", "v")):
        assert sorted(map(str, f(o).collect())) == sorted(map(str, f(o.orderBy(F.rand(3))).collect()))


def test_inferred_year(spark):
    cases = [("tax year 2020 and 2021 2021", "f", 2020), ("2019 2021 2021", "f", 2021), ("2019 2021", "f", 2021), ("none", "scan_2018.pdf", 2018), ("none", "x", None)]
    df = spark.createDataFrame(cases, "t string, f string, y int")
    for r in df.select("y", verify.inferred_year(F.col("t"), [r"tax year (\d{4})"], F.col("f")).alias("g")).collect():
        assert r.y == r.g


def test_capped_sum_streams_keys_of_any_size(spark):
    import random

    rnd = random.Random(3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, 0, 1, 5, 30, 200, -4 if i % 2 else 9])) for i in range(300)] + [("c", 1, 500), ("d", 1, None)]
        got = {r.k: (r.claimed, r.used) for r in ranking.capped_sum(spark.createDataFrame(rows, "k string, i int, v int").repartition(4), ["k"], "v", ["i"], 400).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want = {}
    for k, _, v in sorted(rows, key=lambda r: r[1]):
        claimed, used = want.setdefault(k, (0, 0))
        if v is not None and claimed + v <= 400:
            want[k] = (claimed + v, used + 1)
    assert got == want
