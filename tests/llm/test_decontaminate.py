from tallyweave.llm import decontaminate
from tallyweave.llm.queries import op5_benchmark_decontamination

from .brute import tables

ITEM = "A farmer called Tom Smith has 12 red hens and sells 5 kg of corn to Mary every 3 days, so how many hens does Tom keep after 12 weeks?"
OTHER = "The quiet river bends twice before the mill, and every spring the water reaches the old stone steps."
WORDS = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))


def ids(df):
    return sorted(((r.doc_id, r.item_id) for r in df.collect()), key=str)


def case(spark):
    swap = ITEM.replace("12", "40").replace("5 kg", "7 lb").replace("Tom", "Bob").replace("Mary", "Ann").replace("3 days", "9 hours")
    broken = ITEM.replace("has 12", "has 40").replace("after 12", "after 41").replace("Tom keep", "Jim keep")
    docs = [(1, ITEM), (2, f"{WORDS} {ITEM} {WORDS}"), (3, swap), (4, broken), (5, WORDS), (6, None), (7, ""), (8, OTHER.upper()), (9, OTHER.replace(" ", "\n")), (10, "Tom has 12 hens."), (None, ITEM), (2, WORDS + " " + OTHER), (1, ITEM), (11, "tiny item here"), (12, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (13, ITEM + " " + ITEM)]
    items = [(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "tiny item here"), (6, "one two three four five"), (2, OTHER)]
    return spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item int"), spark.createDataFrame(items, "item_id long, text string")


def test_copies_and_new_parameters(spark):
    docs, items = case(spark)
    got = ids(decontaminate.contaminated(docs, items))
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (13, 1), (8, 2), (8, 2), (9, 2), (9, 2), (2, 2), (2, 2), (11, 5)], key=str)


def test_filter(spark):
    docs, items = case(spark)
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 10, 12]
    assert decontaminate.decontaminated(docs.limit(0), items).collect() == []
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()


def test_shuffled_joins_agree(spark, monkeypatch):
    docs, items = case(spark)
    want = ids(decontaminate.contaminated(docs, items))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert ids(decontaminate.contaminated(docs, items)) == want


def test_query_matches_sql(spark, sf_dir):
    con = tables(sf_dir, "documents", "benchmark")
    want = con.sql(f"select doc_id, item_id, item_windows, matched, slots from ({decontaminate.SQL}) order by all").fetchall()
    got = op5_benchmark_decontamination(spark, sf_dir).select("doc_id", "item_id", "item_windows", "matched", "slots").collect()
    assert sorted(tuple(r) for r in got) == want and want


def test_short_items_are_found_as_lines(spark):
    docs = spark.createDataFrame([(1, "Tiny item, here!"), (2, "see:\ntiny ITEM here\nbye"), (3, "a tiny item here and more"), (4, "12"), (5, "1 2"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "tiny item here"), (2, "12"), (3, "..."), (4, None)], "item_id long, text string")
    assert ids(decontaminate.contaminated(docs, items)) == [(1, 1), (2, 1), (4, 2)]


def test_slots_match_sql(spark):
    """Drill sheets, parts and broken copies, with the slot check in SQL."""
    import duckdb

    docs, items = case(spark)
    d, b = docs.select("doc_id", "text").toPandas(), items.toPandas()  # noqa: F841  views of the SQL below
    con = duckdb.connect()
    con.register("documents", d)
    con.register("benchmark", b)
    want = sorted(con.sql(f"select doc_id, item_id, matched, slots from ({decontaminate.SQL})").fetchall(), key=str)
    got = sorted(((r.doc_id, r.item_id, r.matched, r.slots) for r in decontaminate.contaminated(docs, items).collect()), key=str)
    assert got == [tuple(None if x is None or x != x else int(x) for x in w) for w in want] and max(g[3] for g in got) > 0


def test_any_consistent_alignment_counts(spark, monkeypatch):
    """A drill sheet's later copy, part of an item beside other text, a word put in; values that change between pieces of less than the share are no leak."""
    broken = ITEM.replace("has 12", "has 40").replace("after 12", "after 41").replace("Tom keep", "Jim keep")
    half = ITEM.split(", so")[0]
    other = ", so odd that nine Bob Jones 77 lost it as well as 99"
    put = ITEM.replace("5 kg", "very nearly 5 kg")
    docs = [(1, f"{broken} {ITEM}"), (2, f"{broken}\n{broken}\n{put}\n{broken}"), (3, f"{half}, so many red things as Bob has 77 now"), (4, put), (5, f"{broken} {broken}"), (6, put.replace("has 12", "has 40")), (7, half + other), (8, ITEM.replace("corn to Mary", "corn and beans to Mary").replace("after 12", "after 13"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r.slots for r in decontaminate.contaminated(df, items).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6, 7] and min(got.values()) > 0  # 6: its second piece alone is more than half
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {r.doc_id: r.slots for r in decontaminate.contaminated(df, items).collect()} == got
