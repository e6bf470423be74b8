"""Gated patterns against plain ones, and what goes into the tasks of the block queries."""

import random

from pyspark.sql import functions as F

from tallyweave.functions.gates import Text, gated, pieces
from tallyweave.operators import choice
from tallyweave.operators import statements as S
from tallyweave.plans import catalogue

PATTERNS = [*S.SURROUNDINGS.values(), *[p for _, tests in S.HEADERS for _, p in tests], S.ENDS, S.ENDS_UNLESS_DEDUCTIONS, S.SECOND, S.LATER, S.TAXES_ONLY, S.REGION_END, S.NO_REST, *[b[1] for b in S.BUCKETS], *choice.NO_EXPENSE, *choice.NO_LABEL, choice.SPOILS, *[p for _, ps, _ in choice.SCORES for p in ps]]
WORDS = ["statement", "Stmt", "tatement", " ", "  ", "2", "3", "19", "26", "other", "deduct", "deductions", "line", "LINE", "form", "1120", "taxes", "and", "licenses", "comparison", "year", "two", "total", "to", "5", "interest", "expense", "federal", "statements", "omb no", "cost of goods", "12,345", "payable", "insurance", "amortization", "auto", "and", "truck", None]


def test_gated_patterns_find_what_plain_ones_find(spark):
    rnd = random.Random(1)
    texts = [(w,) for w in WORDS] + [(" ".join(x for x in rnd.choices(WORDS, k=rnd.randint(1, 6)) if x),) for _ in range(3000)]
    df = spark.createDataFrame(texts, "t string")
    t = gated(F.col("t"))
    assert sum(pieces(p) is not None for p in PATTERNS) > 60
    odd = df.select([F.count_if(~t.rlike(p).eqNullSafe(F.col("t").rlike(p))).alias(str(i)) for i, p in enumerate(PATTERNS)]).first()
    assert set(odd) == {0}


def test_pieces(spark):
    assert pieces(r"(?i)other\s+(?:deduct|ions|expense)") == ("other",)
    assert pieces(r"(?i)totals?\s*2|stmt") == ("stmt", "total")
    assert pieces(r"\d+|other") is None and pieces(r"(?:other)?x") is None
    assert isinstance(gated(Text(F.lit("a"), F.lit("a"))), Text)


def test_lines_of_the_block_queries_are_dealt_over_all_cores(spark, sf_dir):
    """A shuffle of small rows that are widened or judged later was read by one task."""
    cores = spark.sparkContext.defaultParallelism
    for name in ("statement_total", "block_buckets", "page_block", "rank_pool"):
        df = catalogue.queries()[name](spark, sf_dir)
        df.collect()
        assert df.rdd.getNumPartitions() >= cores, name


def test_a_null_line_fits_nothing_and_has_no_length(spark):
    rows = [(1, 0, "Comparison worksheet"), (1, 1, None), (1, 2, "x" * 590), (1, 3, "y"), (1, 4, "z")]
    got = {r.line_no: (r.offset, r.near.comparison) for r in S.near(spark.createDataFrame(rows, "doc int, line_no int, line string"), ["doc"], "line_no", "line").collect()}
    assert got == {0: (0, True), 1: (21, True), 2: (21, True), 3: (612, False), 4: (614, False)}


def test_expense_lines_are_read_once(spark):
    """The test of an amount moved below the reading of it, which was read again for each question."""
    rnd = random.Random(2)
    docs = [(d, i, " ".join(x for x in rnd.choices(WORDS, k=rnd.randint(1, 6)) if x)) for d in range(40) for i in range(20)] + [(90, 0, "Statement 2 Other deductions"), (90, 1, "Travel 1,234"), (90, 2, None), (90, 3, "Total 1,234"), (90, 4, "-- Telephone 77,001")]
    lines = spark.createDataFrame(docs, "doc int, line_no int, line string")
    out = choice.expense_lines(lines, ["doc"])
    assert [(r.line_no, r.label, r.amount) for r in out.where("doc = 90").orderBy("line_no").collect()] == [(1, "travel", 1234), (4, "telephone", 77001)]
    filters = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if x.strip(" +-:").startswith("Filter")]
    assert filters and not any("transform(" in x for x in filters)
    rows, c, both = S.with_texts(S.near(lines, ["doc"], "line_no", "line"), "line")
    assert rows.where(~S.is_header(c, F.col("near"), both=both).eqNullSafe(S.is_header(F.col("line"), F.col("near")))).count() == 0
