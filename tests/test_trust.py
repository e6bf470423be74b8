from pyspark.sql import functions as F

from tallyweave.operators import candidates, rules, trust

CELL = "client int, year int, field_id string, value long, confidence int, source string"
READ = "client int, year int, field_id string, family string, value long, confidence int, label string"


def reconcile(spark, cells, reads=(), warnings=()):
    fields = spark.createDataFrame([(f,) for f in ("sales", "cogs", "rent", "cash", "unclassified_equity", "other_operating_expenses")], "field_id string")
    warned = spark.createDataFrame(list(warnings), "client int, year int, warning string") if warnings else None
    out = trust.reconciled(spark.createDataFrame(cells, CELL), spark.createDataFrame(list(reads), READ), ["client"], fields, warnings=warned)
    return {(r.client, r.field_id): r for r in out.collect()}


def test_reconcile_flags_caps_and_tiers(spark):
    cells = [
        (1, 2019, "sales", 100_000, 99, "Form 1120 page 1 block"), (1, 2019, "cogs", 120_000, 99, "Form 1120 page 1 block"), (1, 2019, "rent", 5_000, 99, "Two-year comparison"),
        (2, 2019, "cash", 500, 99, "Schedule L line 1"), (2, 2019, "unclassified_equity", 400, 90, "OCR label match"),
        (3, 2019, "rent", 2019, 90, None), (3, 2019, "other_operating_expenses", 7_000, 90, "residual opex"), (4, 2019, "rent", 9_000, None, "user correction"),
    ]
    reads = [(1, 2019, "rent", "form", 5_000, 90, None), (1, 2019, "rent", "comparison", 5_000, 90, None), (1, 2019, "sales", "form", 100_000, 90, None), (1, 2019, "sales", "comparison", 90_000, 90, "row 1")]
    got = reconcile(spark, cells, reads, [(3, 2019, "P&L does not close by 5")])
    assert got[1, "sales"].flags == ["COGS exceeds sales", "Other reads: comparison (row 1): 90,000"] and got[1, "sales"].tier == "math-warning" and got[1, "sales"].confidence == 85
    assert got[1, "rent"].status == "verified" and got[1, "rent"].tier == "multi-source" and got[1, "rent"].confidence == 99 and got[1, "rent"].agreement == 2
    assert "gap 100)" in got[2, "cash"].flags[0] and got[2, "cash"].status == "review"
    assert got[3, "rent"].flags == ["Likely form line number or OCR noise — verify", "Low-trust source — verify manually"]
    assert got[3, "other_operating_expenses"].confidence == 58 and len(got[3, "other_operating_expenses"].flags) == 2
    assert got[4, "rent"].tier == "user-confirmed" and got[4, "sales"].status == "missing" and got[4, "sales"].flags == []
    assert len([k for k in got if k[1] not in trust.PROFITS]) == 24 and len(got) == 27  # client 3 does not close: three rows of profits
    assert reconcile(spark, []) == {}


def test_gates(spark):
    cells = spark.createDataFrame([(1, 2019, "cash", 12, 90, "Schedule L line 12"), (1, 2019, "interest_expense", 45, 90, None), (1, 2019, "rent", 1120, 90, "OCR label match"), (1, 2019, "other_income", 0, 90, "summary zero"), (1, 2019, "sales", 5000, None, None), (1, 2019, "cogs", None, None, None)], CELL)
    got = {r.field_id: (r.verdict, r.value, r.confidence) for r in trust.gated(cells, F.col("year")).collect()}
    assert got == {"cash": ("clear", None, None), "interest_expense": ("clear", None, None), "rent": ("cap", 1120, 42), "other_income": ("assumed zero", 0, 68), "sales": ("keep", 5000, None), "cogs": ("keep", None, None)}
    assert {r.field_id for r in trust.gated(cells, F.col("year"), True).where("verdict = 'clear'").collect()} == {"cash", "interest_expense", "rent"}


def test_votes(spark):
    reads = spark.createDataFrame([(1, 1, "a", "ocr", 5, 99, None), (1, 1, "a", "form", 6, 80, None), (1, 1, "a", "statement", 6, 70, None), (1, 1, "b", "ocr", 5, 99, None), (1, 1, "b", "form", 6, 80, None), (1, 1, "a", "ocr", 5, 60, None)], READ)
    one = trust.distinct_snapshots(reads, ["client", "year"])
    assert one.count() == 5
    assert {(r.field_id, r.value, r.family) for r in trust.picked_read(one, ["client", "year"]).collect()} == {("a", 6, "form"), ("b", 5, "ocr")}
    assert {r.field_id: r.agree for r in trust.schedule_agreement(one, ["client", "year"]).collect()} == {"a": True, "b": False}


def test_candidates(spark):
    rows = [(1, 40, "Statement 2 (summed detail lines)", 0, 100, 60, None), (1, 100, "comparison OTHER OPERATING", 1, 100, 60, None), (2, 30, "Form line 20 residual", 0, 100, 60, None), (2, 25, "federal table minus slot", 1, 100, 60, None), (3, 7, "Form line 20 residual", 0, None, None, True), (3, 8, "summed detail", 1, None, None, False)]
    df = spark.createDataFrame(rows, "k int, value long, source string, ord int, total long, known long, closes_income boolean")
    scored = candidates.scored(df, rivals=F.array(F.lit(99).cast("long")))
    got = {(r.k, r.ord): (r.closure, r.evidence, r.score, r.valid, r.flags) for r in scored.collect()}
    assert got[1, 0] == (1, 95, 1095, True, []) and got[1, 1][3:] == (False, ["implausible", "stmt2_total_trap", "comparison_reject"]) and got[3, 0] == (0, 85, 110, True, ["pnl_identity_close"])
    assert {r.k: r.value for r in candidates.ranked(scored, ["k"]).collect()} == {1: 40, 2: 25, 3: 7}
    assert {r.k: (r.value, r.exact) for r in candidates.pasted(scored, ["k"]).collect()} == {1: (40, True), 2: (30, False), 3: (7, False)}
    conf = scored.select("k", "ord", candidates.confidence(F.col("closure"), F.col("evidence"), F.col("flags"), F.col("source")).alias("c")).collect()
    assert {(r.k, r.ord): r.c for r in conf} == {(1, 0): 92, (1, 1): 72, (2, 0): 77, (2, 1): 78, (3, 0): 72, (3, 1): 72}


def test_profits_odd_fields_and_persisted_agreement(spark):
    cell = CELL + ", persisted int"
    fields = spark.createDataFrame([("depreciation",), ("amortization",), ("rent",), ("cash",)], "field_id string")
    cells = spark.createDataFrame([(1, 2019, "depreciation", 2021, 90, "Form 1120 line 14", None), (1, 2019, "amortization", 1120, 90, "x", None), (1, 2019, "rent", 5000, 90, "Form 1120 page 1 block", 2), (1, 2019, "cash", 700, 90, "Form 1120 page 1 block", 2)], cell)
    reads = spark.createDataFrame([(1, 2019, "cash", "ocr", 701, 90, None)], READ)
    warnings = spark.createDataFrame([(1, 2019, "Net income 5 ≠ Form ordinary income 6"), (2, 2019, "P&L does not close by 3"), (3, 2019, "other")], "client int, year int, warning string")
    got = {(r.client, r.field_id): r for r in trust.reconciled(cells, reads, ["client"], fields, warnings=warnings).collect()}
    assert trust.ODD_FIELDS["depreciation"] in got[1, "depreciation"].flags and trust.ODD_FIELDS["amortization"] in got[1, "amortization"].flags and got[1, "rent"].agreement == 2 and got[1, "cash"].agreement == 0
    assert {c for c, f in got if f == "net_income"} == {1, 2} and got[2, "operating_profit"].tier == "math-warning" and got[1, "net_income"].flags == [trust.PROFIT_FLAG] and got[1, "net_income"].value is None


def test_fields_without_a_value_are_not_judged(spark):
    """Every field of every sheet went through all windows and patterns, whether it had a value or not."""
    cells = spark.createDataFrame([(1, 2019, "rent", 5000, 90, "Form 1120 page 1 block"), (1, 2019, "cash", None, 90, "x"), (1, 2019, "elsewhere", 4, 90, "x"), (None, 2019, "rent", 7, 90, "x"), (2, 2019, "rent", None, None, None)], CELL)
    fields = spark.createDataFrame([("rent",), ("cash",), ("sales",)], "field_id string")
    out = trust.reconciled(cells, spark.createDataFrame([], READ), ["client"], fields)
    got = {(r.client, r.field_id): (r.value, r.flags, r.status, r.confidence, r.agreement, r.tier) for r in out.collect()}
    assert len(got) == out.count() == 9 and got.pop((1, "rent")) == (5000, [], "verified", 90, 0, "authoritative")
    assert all(v == (None, [], "missing", None, None, "empty") for v in got.values())
    assert "array_except" in out._jdf.queryExecution().optimizedPlan().toString()


RANKINGS = (
    # an exact reverse-math read beside a valid summed detail gives the detail
    ([(40, "P&L reverse math (Form ordinary income)", True), (30, "Statement 2 (summed detail lines)", False)], 30),
    ([(40, "Statement 2 (misc detail sum)", None), (30, "Statement 3 (total minus util/merchant/auto/licenses)", None)], 30),
    ([(40, "Form line 20 residual", None), (40, "Statement 2 (misc detail closes Stmt 2 total)", None)], 40),
    ([(35, "Two-year comparison (OTHER DEDUCTIONS residual)", True), (30, "Statement other deductions (office/supplies/telephone/travel/bank detail)", None)], 30),
    ([(35, "Two-year comparison (OTHER DEDUCTIONS residual)", True), (30, "Statement 2 (total minus util/auto/licenses)", None)], 30),
    ([(35, "Statement 2 (total minus util/auto/licenses)", True), (30, "Statement 2 (summed detail lines)", None)], 30),
    ([(35, "Stmt 2 residual (minus known attachment lines)", True), (30, "Statement 2 (federal table minus slot lines)", None)], 30),
    ([(100, "Two-year comparison (OTHER OPERATING)", None), (100, "Statement 3", None)], 100),
    ([(60, "Two-year comparison (OTHER OPERATING)", None), (7, "Form line 20 residual", None), (60, "Two-year comparison (OTHER OPERATING)", None)], 7),
)


def test_ranking_gives_way(spark):
    rows = [(k, v, s, i, 100, 60, c) for k, (reads, _) in enumerate(RANKINGS) for i, (v, s, c) in enumerate(reads)]
    df = spark.createDataFrame(rows, "k int, value long, source string, ord int, total long, known long, closes_income boolean")
    got = {r.k: r for r in candidates.ranked(candidates.scored(candidates.distinct_candidates(df, ["k"])), ["k"]).collect()}
    assert {k: r.value for k, r in got.items()} == {k: want for k, (_, want) in enumerate(RANKINGS)}
    assert got[2].source.startswith("Statement 2 (misc") and got[7].source.startswith("Two-year")


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(rules.key_quality(F.lit(k).cast("string"))) for k in ("", None, "schedule a", "smith smith", "hill services", "hill")] == ["unreliable", "unreliable", "unreliable", "unreliable", "strong-entity", "plausible"]
    assert one(rules.interest_crumb(F.lit(163), F.lit("OCR label match"))) and not one(rules.interest_crumb(F.lit(163), F.lit("Form 1120 line 13")))
    assert one(rules.is_noise(F.lit("Common size 12"))) and not one(rules.is_noise(F.lit("Rent 12")))
    flags = F.array(F.lit("low_trust_source"))
    review = lambda **k: one(rules.needs_review(*[k.get(n, d) for n, d in (("value", F.lit(1)), ("status", F.lit("verified")), ("tier", F.lit("moderate")), ("confidence", F.lit(80)), ("flags", F.array().cast("array<string>")), ("verified", F.lit(False)), ("corroborated", F.lit(False)))]))
    assert not review() and review(flags=flags) and review(value=F.lit(None).cast("long")) and review(tier=F.lit("ocr-only")) and not review(flags=flags, verified=F.lit(True)) and not review(flags=flags, corroborated=F.lit(True))
    df = spark.createDataFrame([(3, 9), (4, 2), (4, 3)], "n_facts int, n_industry int")
    assert rules.rescan_needed(df).count() == 2
    assert rules.all_fields(*[spark.createDataFrame([(f,)], "field_id string") for f in "aab"]).count() == 2
