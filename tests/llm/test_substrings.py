import hashlib
import random

import pytest

from tallyweave.llm import substrings
from tallyweave.llm.queries import SQL, op11_substring_dedup
from tallyweave.llm.substrings import Cover

from .brute import WORD, tables


def expected(docs, length):
    """docs: [(id, text)] -> [(id, n_words, removed spans, kept)]"""
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, w in words:
        for s in range(len(w) - length + 1):
            x = tuple(w[s : s + length])
            least[x] = min(least.get(x, key(i)), key(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if least[tuple(w[s : s + length])] < key(i):
                gone[s : s + length] = [True] * length
        edge = [k for k in range(len(w) + 1) if (k < len(w) and gone[k]) != (k > 0 and gone[k - 1])]
        out.append((i, len(w), list(zip(edge[::2], edge[1::2], strict=True)), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def documents(seed, n=90):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "é", "Cc", "d"])
    shared = [[word() for _ in range(rnd.randint(10, 60))] for _ in range(7)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [word() for _ in range(rnd.randint(0, 15))]
            if rnd.random() < 0.6:
                s = rnd.choice(shared)
                w += s[rnd.randint(0, 5) : len(s) - rnd.randint(0, 5)]
        docs.append((rnd.choice([i, -i]), rnd.choice([" ", "\n", "\t ", "  "]).join(w)))
    docs += [(200, docs[3][1]), (-200, docs[4][1]), (5, docs[3][1]), docs[6], docs[6], (None, docs[7][1]), (None, docs[8][1] + " x")]
    return docs + [(300, None), (301, ""), (302, " \n"), (303, "a " * 11), (304, "a " * 40), (305, "a " * 41)]


@pytest.mark.parametrize(("seed", "cover", "share"), [(1, Cover(13), 0.002), (2, Cover(13), 2.0), (3, Cover(8), 0.3), (4, Cover(5, 3, (0, 1)), 0.05), (5, Cover(13, 13, (0, 1, 3, 9)), 0.1)])
def test_plain_python(spark, monkeypatch, seed, cover, share):
    monkeypatch.setattr(substrings, "SHARE", share)
    docs = documents(seed)
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, key string, row int").repartition(3)
    got = substrings.without_shared(df, cover=cover).collect()
    assert sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.kept) for r in got), key=str) == expected(docs, cover.length)
    assert all(r.n_removed == sum(s.hi - s.lo for s in r.spans) for r in got)


def test_runs_over_many_batches(spark):
    batch = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = documents(9, 40)
        got = substrings.without_shared(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
        assert sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.kept) for r in got), key=str) == expected(docs, 13)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))


def test_empty_table_and_bad_cover(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.without_shared(empty).collect() == []
    with pytest.raises(ValueError, match="difference"):
        substrings.without_shared(empty, cover=Cover(13, 7, (0, 1, 2)))
    with pytest.raises(ValueError, match="period"):
        substrings.without_shared(empty, cover=Cover(6))


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = sorted((tuple(r) for r in op11_substring_dedup(spark, sf_dir).select(names).collect()), key=str)
    assert got == sorted(((i, n, sum(z - a for a, z in spans), hashlib.sha256(kept.encode()).hexdigest()) for i, n, spans, kept in expected(docs, 13)), key=str)
    assert any(r[2] for r in got)
    assert sorted(tables(sf_dir, "documents").sql(SQL["op11_substring_dedup"]).select(*names).fetchall(), key=str) == got
