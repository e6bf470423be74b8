from pyspark.sql import functions as F

from tallyweave.operators import finalize, pool, rules

SLOT = "client int, year int, field_id string, value long, source string"
LINE = "client int, year int, ord int, label string, amount long, source string"


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_label_quality(spark):
    q = lambda s: one(spark, pool.label_quality(F.lit(s)))
    assert (q("w wages").repaired, q("w wages").notes) == ("wages", ["repaired_leading_w_wages"])
    assert q("Adetsing |").repaired == "advertising" and q("Adetsing |").legible
    assert q("Widget thing").weak and q("12").notes == ["digits_only", "too_short", "no_word_chars"] and not q("form abc").legible
    assert "form_boilerplate_text" in q("For calendar year ending").notes and not q("").legible


def test_illogical_reasons(spark):
    sheet = {"sales": F.lit(9000), "cogs": F.lit(500), "officer_compensation": F.lit(100), "salaries_wages": F.lit(200)}
    why = lambda label, v, source=None: one(spark, rules.illogical(F.lit(label), F.lit(v), sheet, F.lit(source) if source else None))
    assert [why("Rent", 0), why("Rent", 10**9), why("FEIN", 700), why("Refund 12-3456789", 56789), why("P.O. Box 5", 70)] == ["below_min_amount", "unreasonable_digits", "ein_or_payment_bleed", "ein_or_payment_bleed", "mailing_or_form_footer_noise"]
    assert [why("Gross profit", 70, "Statement 2"), why("salaries less employment credits", 70, "x (salaries_wages row)"), why("Rent", 9001), why("Cost of goods", 500), why("Pay", 300)] == ["non_expense_anchor", None, "collides_with_sales", "collides_with_cogs", "collides_with_payroll_sum"]
    assert why("Wages 1,200 2,300", 3500, "scan") == "uncorroborated_mega_payroll" and why("Wages 1,200 2,300", 3500, "Form 1120 line 13") is None and why("Wages 1,200", 2400, "scan") is None


def test_every_pass_names_its_reason(spark):
    lines = [
        (1, 2020, 1, "Rent", 500, "document scan"), (1, 2020, 2, "Rents", 700, "comparison (rent row)"), (1, 2020, 3, "Insurance", 80, "Statement 2"), (1, 2020, 4, "Insurance", 90, "comparison (insurance row)"),
        (1, 2020, 5, None, 40, None), (1, 2020, 6, "Rent", 500, "document scan"), (1, 2020, 7, "Fees", 20, "Form 1120 line 20"), (1, 2020, 8, "Fees", 2020, "Statement 2"), (1, 2020, 9, "Discount income", 30, "Statement 1"), (2, 2020, 1, "Taxes and licenses", 55, "Statement 2"),
    ]
    slots = spark.createDataFrame([(2, 2020, "taxes_licenses", 60, "Form 1120 line 12"), (3, 2020, "taxes_licenses", 5, None)], SLOT)
    got = pool.rank_pool(spark.createDataFrame(lines, LINE), slots, ["client", "year"], "year", {"taxes_licenses": "Taxes and Licenses"}).collect()
    why = {(r.client, r.key, r.amount): r.reason for r in got}
    assert why[1, "cat:rent", 500] == "merged into its row" and why[1, "row:rent", 700] is None
    assert why[1, "spot:stmt2:insurance", 80] == "statement detail" and why[1, "row:insurance", 90] is None
    assert why[1, "spot:form1120:20", 20] == "crumb" and why[1, "spot:stmt2:fees", 2020] == "no amount" and why[1, "spot:stmt1:discount income", 30] == "other income"
    assert why[1, "raw:40", 40] is None and why[2, "spot:form1120:12", 60] is None and why[2, "spot:stmt2:taxes_licenses", 55] == "other taxes"
    assert len(got) == 10


def test_captions_are_judged_once(spark):
    """Each line was judged by all patterns, whatever its caption had been judged before."""
    lines = spark.createDataFrame([(c, 2020, i, label, 100 + i, source) for c in range(40) for i, (label, source) in enumerate([("Rents", "Statement 2"), ("Rents", "document scan"), (None, None), ("Payroll tax", "Statement 2"), ("Refund 12-3456789", "")])], LINE)
    rows = pool.with_slots(lines, spark.createDataFrame([], SLOT), ["client", "year"], {})
    marks = {(r.label, r.source): r for r in pool.captions(rows).select("*", *[pool.marked(k).alias(k) for k in ("detail", "scan", "employer", "excluded")]).collect()}
    assert len(marks) == 5 and marks["Rents", "Statement 2"].detail and marks["Rents", "document scan"].scan and marks["Refund 12-3456789", ""].employer
    assert marks["Rents", "Statement 2"].name == "spot:stmt2:rent" and marks["Payroll tax", "Statement 2"].noise == "payroll tax" and marks["", ""].name is None
    got = pool.rank_pool(lines, spark.createDataFrame([], SLOT), ["client", "year"], "year", {})
    assert got.count() == 200 and got.where("key = 'spot:stmt2:rent' and reason is null").count() == 40


def test_rank_pool_of_nothing(spark):
    assert pool.rank_pool(spark.createDataFrame([], LINE), spark.createDataFrame([], SLOT), ["client", "year"], "year", {}).collect() == []


def test_partition(spark):
    p = spark.createDataFrame([(1, "Bank", 100, "Statement 2"), (1, "Bank", 100, "Statement 2"), (1, "Amortization", 150, "Statement 2"), (1, "Rent", 400, "Form 1120 line 16"), (2, "Bank", 70, "Statement 2"), (2, "Dues", 30, None)], "k int, label string, amount long, source string")
    tops = spark.createDataFrame([(1, 400), (1, 100), (2, 70)], "k int, amount long")
    got = {r.k: (r.total, r.inside, r.rest) for r in pool.partition_rest(p, tops, spark.createDataFrame([(1, 900)], "k int, total long"), ["k"]).collect()}
    assert got == {1: (750, 100, 650), 2: (None, 70, 30)}


def test_finalize_twice_is_once(spark):
    row = "client int, year int, field_id string, baseline long, baseline_confidence int, baseline_source string, value long, confidence int, source string, edited boolean"
    state = spark.createDataFrame([
        (1, 2019, "cogs", None, None, None, 9, 9, "an earlier run", False), (1, 2019, "cash", 500, 60, "OCR label match", 1, 1, "x", False), (1, 2019, "inventory", 700, 90, "Schedule L", 1, 1, "x", False),
        (1, 2019, "depreciation", None, None, None, None, None, None, None), (1, 2020, "cash", 40, 80, "Schedule L", 41, 99, "manual entry", True), (1, 2020, "sales", 1120, 90, "Form 1120 page 1 block", 1120, 90, "x", False), (1, 2020, "rent", 800, 70, "Form 1120 line 16", 1, 1, "x", False),
    ], row)
    said = spark.createDataFrame([(1, 2020, 2019, f, v) for f, v in (("cogs", 333), ("cash", 444), ("inventory", 555), ("depreciation", 666), ("other_assets", 777), ("common_stock", 1))] + [(1, 2019, 2018, "cogs", 5000)], "client int, year int, prior_year int, field_id string, value long")
    lines = spark.createDataFrame([(1, 2019, "Rent", 800, "Statement 2"), (1, 2020, "Rent", 900, "Statement 2"), (1, 2020, "Dues", 100, "Statement 2")], "client int, year int, label string, amount long, source string")
    totals = spark.createDataFrame([(1, 2020, 1500)], "client int, year int, total long")
    once = finalize.finalize(state, said, lines, totals)
    twice = finalize.finalize(once, said, lines, totals)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    got = {(r.year, r.field_id): (r.value, r.source) for r in once.collect()}
    assert got[2019, "cogs"] == (333, "Two-year comparison (from 2020 return)") and got[2019, "cash"][0] == 444 and got[2019, "inventory"] == (700, "Schedule L") and got[2019, "depreciation"] == (None, None) and got[2019, "other_assets"][0] == 777
    assert got[2020, "cash"] == (41, "manual entry") and got[2020, "sales"] == (None, None) and (2019, "common_stock") not in got and (2018, "cogs") not in got
    assert got[2020, "officer_compensation"] == (900, "Operating expenses (top-8 slot 1)") and got[2019, "salaries_wages"][0] == 0 and got[2020, "other_operating_expenses"][0] == 500 and got[2020, "rent"][0] == 800
    assert finalize.flagged(once).where("size(flags) > 0").count() >= 0
