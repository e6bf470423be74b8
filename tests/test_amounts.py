import pytest
from pyspark.sql import functions as F

from tallyweave.functions import amounts, labels

MONEY = [("1,234", 1234), ("$ 2,539", 2539), ("283.400", 283400), ("(1,000)", -1000), ("-45", -45), ("12.5", 13), ("", None), ("-", None), ("n/a", None), (None, None), ("(12.5)", -12), ("-12.5", -12), ("1 234", None), ("1.234.567", 1234567), ("0", 0)]


def test_parse_money(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(MONEY)], "i int, s string")
    got = {r.i: r.v for r in df.select("i", amounts.parse_money(F.col("s")).alias("v")).collect()}
    assert [got[i] for i in range(len(MONEY))] == [v for _, v in MONEY]


LINES = [
    ("7 Compensation of officers 120,000", [120000]),
    ("LINE 20 419,737", [419737]),
    ("Total deductions 2,539, 740", [2539740]),
    ("Statement 6 - Form 1120-S, Page 4, Line 18 34,500", [34500]),
    ("Rent [12] 45,000", [45000]),
    ("Rent paid 419 737", [419737]),
    ("16 Accounts payable", []),
    ("Form 1099 8990 7,004", []),
    ("| 13 | Salaries 283.400 | 13 |_", [283400]),
    ("nothing here", []),
    (None, []),
]


@pytest.mark.parametrize(("line", "want"), LINES)
def test_substantial_tokens(spark, line, want):
    assert spark.range(1).select(amounts.substantial_tokens(F.lit(line).cast("string"))).first()[0] == want


def test_pickers(spark):
    t = F.array(*[F.lit(v).cast("long") for v in (5, -90, 90)])
    one = F.array(F.lit(7).cast("long"))
    row = spark.range(1).select(amounts.last_amount(t), amounts.largest_amount(t), amounts.only_amount(t), amounts.only_amount(one), amounts.percents(F.lit("Sales 34% -- 41.5%"))).first()
    assert tuple(row) == (90, -90, None, 7, [0.34, None, 0.415])


def test_line_amounts(spark):
    take = lambda c: spark.range(1).select(c).first()[0]
    line = lambda s: F.lit(s)
    assert take(amounts.tail_amount(line("13 Salaries and wages [13]"))) is None
    assert take(amounts.tail_amount(line("13 Salaries and wages 45,000"))) == 45000
    assert take(amounts.schedule_amount(line("10b Less accumulated depreciation 9,500 0"))) == 9500
    assert take(amounts.tagged_amount(line("Gross receipts [1c] 1,234,567"), "1c")) == 1234567
    assert take(amounts.tagged_amount(line("Gross receipts [1a] 5"), "1c")) is None
    assert take(amounts.single_amount(line("Rents 12,000 13,000"))) is None and take(amounts.single_amount(line("Rents 12,000"))) == 12000
    assert take(amounts.attachment_tokens(line("TRAVEL 8."))) == [8] and take(amounts.attachment_tokens(line("26 Dues 500. in 2021"))) == [500]
    assert take(amounts.keepable_tokens(line("16 Accounts payable 2021 88,000"))) == [88000]
    assert [take(amounts.is_row(line(s), 14)) for s in ("14 Depreciation", "[14] x", "214 x", "5,414 x", "x")] == [True, True, True, False, False]
    assert take(amounts.without_ein(line("EIN 12-3456789 Rent 500"))).split() == ["EIN", "Rent", "500"]
    assert [take(amounts.money_line(line(s))) for s in ("$1,250.5", "(40)", "12%", "x")] == [1250.5, -40.0, None, None]
    assert [take(amounts.percent_line(line(s))) for s in ("12.5 %", "40", "140", "x")] == [0.125, 0.4, None, None]


def test_labels(spark):
    rules = [("rent", r"\brent\b"), ("pay", r"wages|rent")]
    row = spark.range(1).select(
        labels.client_key(F.lit("Blue  River Co., Inc.")), labels.expense_key(F.lit("Other  expenses: tree-trimming, statement 3")), labels.repaired(F.lit("|| Rert paid"), [("rert", "rent")]), labels.first_rule(F.lit("rent and wages"), rules), labels.first_rule(F.lit("x"), rules, "none"),
        labels.percent_text(F.lit(0.125)), labels.ratio_text(F.lit(1.5)), labels.percent_text(F.lit(0.3)), labels.any_match(F.array(F.lit("a"), F.lit("rent")), "^re")).first()
    assert tuple(row) == ("blue river", "tree-trimming 3", "rent paid", "rent", "none", "12.5%", "1.5", "30%", True)
