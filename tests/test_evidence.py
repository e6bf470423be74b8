from pyspark.sql import functions as F

from tallyweave.operators import evidence


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_business_names(spark):
    name = lambda text, file=None: one(spark, evidence.business_name(F.lit(text).cast("string"), F.lit(file).cast("string")))
    assert name("x\nPREPARED FOR:\n  Hill  Services 12\ny") == "Hill Services 12" and name("PREPARED FOR:\nForm 1120\nBlue Supply Co LLC\n") == "Blue Supply Co LLC"
    assert name("nothing", "Green Works 2020 return.pdf") == "Green Works" and name(None, None) is None and name("", "tax.pdf") is None
    assert name("blue supply co llc\n") is None


def test_year_headers(spark):
    assert one(spark, evidence.year_headers(F.lit("12/31/2020 12 / 31 /2019 12/31/2020 12/31/2018 12/31/2017"))) == ["12/31/2020", "12/31/2019", "12/31/2018"]


def test_scopes_and_fallbacks(spark):
    pages = spark.createDataFrame([(1, 1, "Current Ratio 9.9"), (1, 2, "Current Ratio 1.5"), (1, 3, "Current Ratio 2.5 1.0 to 3.0"), (2, 4, "Quick Ratio 7"), (2, 5, "Quick Ratio 8"), (3, 1, None), (4, 1, "Industry: 44511 - Grocers\n")], "k int, page_no int, text string")
    got = {(r.k, r.fact): (r.value, r.page) for r in evidence.scoped_facts(pages, ["k"]).collect()}
    assert got == {(1, "current_ratio"): ("2.5", 3), (2, "quick_ratio"): ("7", 4), (4, "naics"): ("44511", 1), (4, "industry"): ("Grocers", 1)}


def test_clears(spark):
    cell = "k int, field_id string, value long, source string"
    rows = [(1, "other_assets", 900, "Schedule L"), (1, "short_term_debt", 50, "x"), (1, "other_current_liabilities", 50, "x"), (1, "unclassified_equity", 70, "Schedule L line 24 retained"), (1, "other_stock_equity", 70, "x"), (1, "inventory", None, evidence.CAPTION_ONLY), (2, "other_assets", 900, "Schedule L"), (2, "unclassified_equity", -5, None), (2, "inventory", 40, evidence.CAPTION_ONLY), (2, "inventory", 40, evidence.CAPTION_ONLY)]
    lines = [(1, "15 Total assets 900"), (2, "15 Total assets 900"), (2, "14 Other assets 900"), (2, "3 Inventories 40"), (2, "3 Inventories 40"), (3, None)]
    got = evidence.corroborated(spark.createDataFrame(rows, cell), spark.createDataFrame(lines, "k int, line string"), ["k"])
    assert sorted((r.k, r.field_id, r.cleared) for r in got.where("cleared is not null").collect()) == [(1, "other_assets", "total of assets"), (1, "other_current_liabilities", "counted as debt"), (1, "other_stock_equity", "counted as equity"), (2, "unclassified_equity", "negative equity")]
    assert got.count() == len(rows) and got.where("cleared is not null and value is not null").count() == 0
    assert evidence.corroborated(spark.createDataFrame([], cell), spark.createDataFrame([], "k int, line string"), ["k"]).collect() == []


def test_one_amount_in_one_field(spark):
    base = {"form": None, "statement": None, "comparison": None, "books": None, "kind": "1120-s", "points": False, "on_page": False, "detail": False, "reports": True, "refund": False, "matched": 0}
    types = {"form": "long", "statement": "long", "comparison": "long", "books": "long", "kind": "string", "matched": "int"}
    route = lambda **k: tuple(one(spark, evidence.income_routing({n: F.lit((base | k)[n]).cast(types.get(n, "boolean")) for n in base})))[:2]
    assert route() == (None, None) and route(form=5, kind="1120") == (5, None) and route(comparison=7, matched=5) == (7, None)
    assert route(points=True, statement=9, form=9) == (9, None) and route(points=True, form=9) == (0, None) and route(points=True, comparison=300) == (300, None)
    assert route(points=True, reports=False, refund=True, form=400, comparison=400) == (None, 400) and route(points=True, reports=False, refund=True, form=400, comparison=400, books=390) == (None, 390)


def test_coverage_flags(spark):
    pages = spark.createDataFrame([(1, 1, "see stmt 2"), (1, 2, "Form 1120"), (2, 1, None)], "k int, page_no int, text string")
    facts = spark.createDataFrame([(1, None, None, None, False, None, None, False)], "k int, statement_total long, detail_sum long, comparison_total long, comparison_found boolean, known long, rest long, schedule_found boolean")
    got = {r.k: r for r in evidence.coverage(pages, facts, ["k"]).collect()}
    assert got[1].flags == ["stmt2-missing-lines", "stmt2-total-unparseable", "schedule-l-not-detected", "page-truncation-suspected"] and "utilities" in got[1].hints and got[2].flags == ["page-truncation-suspected"]
    todo = evidence.rescan(pages, evidence.coverage(pages, facts, ["k"]), pages.where("page_no = 2"), ["k"])
    assert [tuple(r) for r in todo.collect()] == [(1, 1)]
