from collections import defaultdict

import pytest

from tallyweave.llm import mixing
from tallyweave.llm.queries import op7_source_mixing

from .brute import tables


def rows(n=900):
    out = []
    for i in range(n):
        out.append((i, "w " * (1 + i % 90), ["a", "a", "a", "b", None][i % 5], ["en", "de", "fr"][i % 3], ["x", "y"][i // 7 % 2]))
    return out + [(5000, None, "a", "en", "x"), (5001, "", "c", None, None), (None, "w w", "a", "en", "x"), (3, "w w w", "a", "en", "x")]


def goals(mass, power, total):
    """Tempered shares of the total, none above what there is."""
    full, rest = set(), total
    while True:
        norm = sum(m**power for c, m in mass.items() if c not in full)
        over = {c for c, m in mass.items() if c not in full and m**power / norm * rest >= m}
        if not over:
            return {c: m if c in full else m**power / norm * rest for c, m in mass.items()}
        full |= over
        rest = total - sum(mass[c] for c in full)


@pytest.mark.parametrize(("rate", "one_task"), [(0.8, 50_000), (0.3, 0)])
def test_marginals_are_met(spark, monkeypatch, rate, one_task):
    """Production rounds, caps included: what is drawn has the targets."""
    monkeypatch.setattr(mixing, "CELLS_A_TASK", one_task)
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, lang string, topic string")
    report = mixing.report(df, topic="topic", rate=rate).collect()
    total = rate * sum(r.tokens for r in report)
    for d, power in mixing.TEMPER.items():
        have, mass, drawn = defaultdict(float), defaultdict(float), defaultdict(float)
        for r in report:
            if r.tokens:
                have[r[d]] += r.tokens * r.p
                mass[r[d]] += r.tokens
                drawn[r[d]] += r.tokens * r.kept
        for c, goal in goals(mass, power, total).items():
            assert have[c] == pytest.approx(goal, rel=0.01)
            assert drawn[c] == pytest.approx(goal, rel=0.25)


def test_sample_has_the_rate(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, lang string, topic string")
    report = mixing.report(df, topic="topic", rate=0.6).collect()
    total = sum(r.tokens for r in report)
    assert sum(r.tokens * r.p for r in report) == pytest.approx(0.6 * total, rel=1e-3)
    assert sum(r.tokens for r in report if r.kept) == pytest.approx(0.6 * total, rel=0.12)
    by_id = {r.doc_id: r for r in report if r.tokens == 0}
    assert by_id[5000].kept and by_id[5001].kept and len(report) == len(rows())


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b", "s", "en", 9.0)], "doc_id long, text string, source string, lang string, p double")
    assert mixing.mixed(df).columns == df.columns
    assert mixing.mixed(df.limit(0)).collect() == []


def test_query_matches_sql(spark, sf_dir):
    con = tables(sf_dir, "documents")
    want = con.sql(f"select doc_id, tokens, topic, p, kept from ({mixing.sql()}) order by all").fetchall()
    got = sorted(tuple(r) for r in op7_source_mixing(spark, sf_dir).select("doc_id", "tokens", "topic", "p", "kept").collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
