from tallyweave.llm import quality
from tallyweave.llm.queries import op9_quality_rules

from . import brute

ODD = [None, "", " \n ", "a", "x y\nx y\n\nx y\nz", "#*$%&|<> é é", "w " * 5000, "\n".join(["same line here"] * 30), "one two three four five six seven eight " * 3 + "nine"]


def test_measures_match_plain_python(spark, sf_dir):
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    df = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string")
    for r in quality.quality_report(df).collect():
        assert {k: r[k] for k in brute.quality("")} == brute.quality(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_thresholds_follow_the_group(spark):
    plain, odd = " ".join(["word"] + [f"w{i}" for i in range(60)]), " ".join(f"w{i} #" for i in range(60))
    rows = [(i, plain + f" {i}", "en", "a") for i in range(150)] + [(1000 + i, odd + f" {i}", "en", "b") for i in range(150)] + [(5000, odd, "en", "a"), (5001, plain, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_report(df).collect()}
    assert all(kept[i] for i in range(150)) and all(kept[1000 + i] for i in range(150)) and kept[5001] and not kept[5000]


def test_filter_keeps_columns(spark):
    df = spark.createDataFrame([(1, "t", "en", None, 5)], "doc_id long, text string, lang string, source string, measures int")
    out = quality.quality_filter(df)
    assert out.columns == df.columns and out.collect() == []
    assert quality.quality_filter(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.kept) for r in op9_quality_rules(spark, sf_dir).collect() if r.doc_id in labels]
    good = [k for q, k in got if q == 1]
    assert sum(good) >= 0.95 * len(good)


def test_bad_texts_are_rejected(spark):
    """Labels of the larger table: most bad texts that pass the base rules fall to the fences."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op9_quality_rules(spark, sf).collect() if r.doc_id in labels]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    past = [r.kept for r in rows if labels[r.doc_id] == 0 and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    assert len(bad) > 30 and sum(bad) <= 0.1 * len(bad) and sum(past) <= 0.15 * len(past) and sum(good) >= 0.95 * len(good)


def test_odd_rows(spark):
    """Ties, repeated rows, very long texts, nulls and clashing columns."""
    rows = [(1, "a b c " * 10, "en", "s", 5), (1, "a b c " * 10, "en", "s", 5), (2, "w" * 300_000, "en", "s", 6), (3, "x y " * 100_000, None, None, 7), (None, None, "en", None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fence_map int")
    got = quality.quality_report(df).collect()
    assert len(got) == 5 and sum(r.doc_id == 1 for r in got) == 2 and {r.n_words for r in got} == {30, 1, 200_000, 0}
    assert quality.quality_filter(df).columns == df.columns


def test_fences_tighter_than_any_constant(spark):
    """A group of even documents rejects what lies far outside it, up and down, though a mixed corpus has such documents."""
    words = lambda i, n: " ".join(f"{'v' * (n + (i + k) % 2)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60 + i % 3))
    rows = [(i, words(i, 3), "en", "a") for i in range(150)]
    odd = {900: words(0, 6), 901: words(0, 1), 902: words(0, 3).upper(), 903: words(0, 3) + " #" * 4, 904: words(0, 3) + "\n" + "one two\n" * 3, 905: words(0, 3) + " a b c d e f g h" * 2}
    rows += [(i, t, "en", "a") for i, t in odd.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality_report(df).collect()}
    assert all(got[i].kept for i in range(150))
    assert [i for i in odd if got[i].kept or got[i].base_failed] == []
    # The same documents are ordinary in a group of their own kind.
    long = spark.createDataFrame([(i, words(i, 6), "en", "b") for i in range(150)] + rows[:150], df.schema)
    assert all(r.kept for r in quality.quality_report(long).collect())
