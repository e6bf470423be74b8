import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import periods
from tallyweave.llm.queries import op13_periodic_runs

from .brute import WORD


def runs_of(w, min_exp=4, min_words=6):
    """Every run by its definition: for each period all maximal stretches, and their smallest period."""
    n, best = len(w), {}
    for p in range(1, n // min_exp + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(min_words, min_exp * p):
                best.setdefault((i, length), p)
            i = max(j, i + 1)
    return sorted((s, n_, p) for (s, n_), p in best.items())


def kept(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed):
    rnd = random.Random(seed)
    out = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "é è é è é è é è", "a b c d " * 9, "a\x0bb\x0ca\tb a b\na b"]
    for _ in range(80):
        w = []
        while rnd.random() < 0.9:
            w += rnd.choices("abc", k=rnd.randint(1, 6)) * rnd.choice([1, 1, 2, 4, 5, 9])
        out.append(rnd.choice([" ", "\n", " \t"]).join(w))
    return out


@pytest.mark.parametrize(("unit", "min_exp", "min_words"), [(periods.UNIT, 4, 6), (40, 4, 6), (200, 2, 1), (periods.UNIT, 3, 9)])
def test_plain_python(spark, unit, min_exp, min_words):
    rows = [(i, t, "r") for i, t in enumerate(texts(unit))]
    rows += [rows[7], rows[7], (None, rows[8][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periods.periodic_runs(df, min_exp=min_exp, min_words=min_words, unit=unit, short_bytes=0)
    assert got.columns == ["doc_id", "text", "runs", "n_words", "runs_1", "collapsed"]
    want = []
    for i, t, r in rows:
        w = WORD.findall(t or "")
        found = runs_of(w, min_exp, min_words)
        want.append((i, t, r, len(w), found, kept(w, found)))
    assert sorted(((*r[:4], [tuple(x) for x in r[4]], r[5]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty_table_and_all_null(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periods.periodic_runs(empty).collect() == []
    r = periods.periodic_runs(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (r.doc_id, r.text, r.n_words, r.runs, r.collapsed) == (None, None, 0, [], "")


def test_long_text_in_ranges(spark):
    w = [f"w{i}" for i in range(900)] * 5 + ["z"] * 7 + [f"v{i % 3}" for i in range(2000)]
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    whole, parts = (periods.periodic_runs(df, unit=u, short_bytes=1000).first() for u in (1 << 40, 1 << 17))
    assert whole == parts
    assert [tuple(r) for r in whole.runs] == runs_of(w) and whole.collapsed == kept(w, runs_of(w))


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = []
    for d, t in docs:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_of(w)
        s, length, p = min(((-n_, s, p) for s, n_, p in runs), default=(None,) * 3)
        best = (None,) * 4 if s is None else (length, -s, p, 1000 * -s // p)
        sha = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        want.append((d, len(runs), *best, sha, hashlib.sha256(kept(w, runs).encode()).hexdigest()))
    got = op13_periodic_runs(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.where(F.col("n_runs") > 0).count() > 0
