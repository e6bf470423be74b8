import random

import pytest

from tallyweave.llm import jaccard
from tallyweave.llm.queries import op1_ngram_jaccard_join

from .brute import link_classes

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "A  b\tc d e f"), (9, "one" * 3000), (10, "é è x y z")]


def expected(docs, num, den, k):
    got = link_classes(docs, num, den, k)
    key = lambda i: (docs[i][0] is None, docs[i][0])
    return sorted((docs[i][0], n, docs[min(m, key=key)][0]) for i, (n, m) in enumerate(got))


def near_copies(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(n):
        words = rnd.choices(vocabulary, k=rnd.choice([9, 12, 20, 35, 60, 120, 300]))
        for _ in range(rnd.randint(1, 7)):
            own = list(words)
            for _ in range(rnd.randint(0, max(1, len(own) // 40))):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            docs.append((len(docs) * 3 + base, " ".join(own)))
    return docs


@pytest.mark.parametrize(("num", "den", "k"), [(9, 10, 3), (8, 10, 5)])
def test_classes_match_all_pairs(spark, num, den, k):
    docs = near_copies(num, 60) + [(10_000 + i, t) for i, t in ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.jaccard_classes(df, num=num, den=den, k=k).collect()
    assert sorted(tuple(r) for r in got) == expected(docs, num, den, k)


@pytest.mark.parametrize(("num", "common_share"), [(9, 0), (8, 0), (8, 0.2), (8, 0.5), (9, 0.4), (8, 0.8)])
def test_signatures_lose_no_link(num, common_share):
    import numpy as np

    rnd = np.random.default_rng(5)
    scheme = jaccard.Scheme(num, 10)
    links = 0
    for _ in range(400):
        n = int(rnd.integers(9, 700))
        a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        cut = int(rnd.integers(0, scheme.differ(len(a)) + 1))
        add = int(rnd.integers(0, scheme.differ(len(a)) + 1))
        b = np.unique(np.concatenate([rnd.permutation(a)[cut:], rnd.integers(0, 2**64, add, dtype=np.uint64)]))
        either = np.union1d(a, b)
        common = np.sort(rnd.permutation(either)[: int(len(either) * min(1, max(0, common_share + rnd.normal(0, 0.15))))]) if common_share else None
        both = jaccard.overlap(a, b)
        if 10 * both >= num * (len(a) + len(b) - both):
            links += 1
            assert set(scheme.signatures(a, common).tolist()) & set(scheme.signatures(b, common).tolist()) or set(a.tolist()) == set(b.tolist())
    assert links > 50


@pytest.mark.parametrize("few", [1, 3, 32])
def test_boilerplate_and_pruning_keep_the_classes(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "COMMON_DOCS", 4)
    monkeypatch.setattr(jaccard, "FEW_NODES", few)
    rnd = random.Random(few)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = []
    for i, text in near_copies(few, 40):
        docs.append((i, f"{text} {passage}" if rnd.random() < 0.5 else text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    linked, brief = jaccard.classes(df, df["text"], 8, 10, 5, boilerplate=True)
    of_node = {r.node: r.component for r in linked.collect()}
    got = [(r.x.n, of_node.get(r.x.node, r.x.node)) for r in df.select("doc_id", brief("text").alias("x")).orderBy("doc_id").collect()]
    want = link_classes(docs, 8, 10, 5)
    assert [n for n, _ in got] == [n for n, _ in want]
    for i, (n, members) in enumerate(want):
        if n:
            assert {j for j, (m, c) in enumerate(got) if m and c == got[i][1]} == set(members)


def test_only_signatures_that_come_twice_travel(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    docs = near_copies(6, 50)
    batches = [pa.RecordBatch.from_arrays([pa.array([t for _, t in docs[i : i + 40]])], ["text"]) for i in range(0, len(docs), 40)]
    of = lambda repeated=None: [(s, n) for b in jaccard.signed(8, 10, 5, None, repeated)(iter(batches)) for s, n in zip(b["sig"].to_pylist(), b["node"].to_pylist(), strict=True)]
    every = of()
    monkeypatch.setattr(jaccard, "PRINTS", 500)  # several rows for a bucket
    rows = pa.Table.from_batches(jaccard.printed(8, 10, 5, None)(iter(batches))).sort_by("bucket")
    assert rows.num_rows > len(set(rows["bucket"].to_pylist()))
    parts = pa.Table.from_batches(jaccard.repeated_prints(iter(rows.to_batches())))
    bits = jaccard.repeats(spark.createDataFrame(docs, "id long, text string").select("text"), 8, 10, 5, None)
    assert sum(np.bitwise_count(np.frombuffer(x, np.uint8)).sum() for x in parts["bits"].to_pylist()) == np.bitwise_count(bits).sum()
    nodes: dict[int, set[int]] = {}
    for s, n in every:
        nodes.setdefault(s, set()).add(n)
    shared = {(s, n) for s, n in every if len(nodes[s]) > 1}
    sent = of(type("Sent", (), {"value": bits}))
    assert shared and shared <= set(sent) and len(sent) < len(shared) + len(every) / 10 < len(every)
    numbers = np.sort(np.array([0, 0, 5, 2**28 - 1, 7, 2**28 - 1], np.uint32))
    assert jaccard.unpacked_prints(jaccard.packed_prints(numbers)).tolist() == numbers.tolist()


def test_texts_without_copy_or_link_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(50)] + [(90, "a b c d e f g"), (91, "a b c d e f g")], "doc_id long, text string")
    out = jaccard.one_of_each(df)
    assert sorted(r.doc_id for r in out.collect()) == [*range(50), 90]
    brief = jaccard.described(5, spark.sparkContext.broadcast(jaccard.node_bits(df.where("doc_id > 89").select(jaccard.described(5)("text")["node"].alias("node")))))
    assert [r.doc_id for r in df.where(brief("text")["maybe"]).orderBy("doc_id").collect()] == [90, 91]


@pytest.mark.parametrize("tile_docs", [2, 4, 7])
def test_tiles_split_a_large_cluster(spark, monkeypatch, tile_docs):
    monkeypatch.setattr(jaccard, "TILE_DOCS", tile_docs)
    rnd = random.Random(tile_docs)
    base = [f"b{i}" for i in range(150)]
    family = []
    for i in range(60):  # one chain of near copies, whose ends are far apart
        at = rnd.randrange(150)
        base = [*base[:at], f"n{i}", *base[at + 1 :]]
        family.append((5000 + i, " ".join(base)))
    docs = near_copies(3, 12) + family
    got = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == expected(docs, 9, 10, 3)


def test_one_row_of_each_class_stays(spark):
    docs = near_copies(11, 30) + [(20_000 + i, t) for i, t in ODD] + [(None, "p q r s t u v"), (None, "p q r s t u v"), (None, None)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, node int")
    kept = jaccard.one_of_each(df).collect()
    assert set(df.columns) == {"doc_id", "text", "node"} and kept[0].asDict().keys() == {"doc_id", "text", "node"}
    want = []
    key = lambda i: (docs[i][0] is None, docs[i][0] or 0)
    for i, (n, m) in enumerate(link_classes(docs, 8, 10, 5)):
        if n == 0 or min(m, key=lambda x: (key(x), x)) == i:
            want.append(docs[i])
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, want))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_classes(df).collect() == []
    assert jaccard.one_of_each(df).collect() == []


def test_query_matches_all_pairs(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op1_ngram_jaccard_join(spark, sf_dir).collect()) == expected(docs, 9, 10, 3)
