import hashlib
import math
from collections import defaultdict

import pytest

from tallyweave.llm import codes
from tallyweave.llm.queries import SQL, op12_vector_codes

from .brute import tables


def expected(rows, parts, entries, rounds, scale):
    """rows: [(vec_id, vector, label)] -> {(vec_id, code, error, label_error)} and the codebooks, in plain Python."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(mine[k]) for x in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for (i, _, lab), c in zip(kept, cut, strict=True):
        got = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), lab))
        by_label[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], sha) for i, c, e, lab in out), key=str)


def vectors(n, dims=8):
    import random

    rnd = random.Random(n)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), round(rnd.gauss(0, 1), 1)]) for _ in range(dims)], rnd.choice([1, 2, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0] * (dims - 1) + [None], 2), (n + 3, [float("nan")] * dims, 2), (n + 4, [float("inf")] + [0.0] * (dims - 1), None), (n + 5, [-float("inf")] * dims, 3)]
    return rows + [rows[3], rows[3], (None, rows[5][1], 2)]


@pytest.mark.parametrize("n", [3, 70])
def test_plain_python(spark, n, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 16)
    rows = vectors(n) if n > 5 else vectors(9)[:n] + vectors(9)[9:15]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, label int").selectExpr("*", "'x' as code", "'y' as other").repartition(3)
    got = codes.compressed(df, vector="v", parts=4, entries=16, rounds=2)
    assert got.rows.columns == ["vec_id", "v", "label", "other", "code", "error"]
    sha = codes.books_sha256(got.books)
    seen = sorted(((r.vec_id, r.code, r.error, r.label_error, sha) for r in codes.label_errors(got.rows.drop("v")).collect()), key=str)
    floats = [(i, v and [x if x is None else float(__import__("numpy").float32(x)) for x in v], lab) for i, v, lab in rows]
    assert seen == expected(floats, 4, 16, 2, 256)


def test_empty_odd_and_too_large(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1), (2, [], 2)]):
        got = codes.compressed(spark.createDataFrame(rows, schema))
        assert codes.label_errors(got.rows).collect() == []
    other = [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1), (0, [0.25] * 16, 1)]
    assert sorted(r.vec_id for r in codes.compressed(spark.createDataFrame(other, schema)).rows.collect()) == [0, 1]
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(spark.createDataFrame([(1, [0.5] * 15, 1)], schema))
    with pytest.raises(Exception, match="beyond 2\\^26"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 16, 1)], schema))


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = op12_vector_codes(spark, sf_dir)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    seen = sorted((tuple(r) for r in got.select(names).collect()), key=str)
    assert seen == expected(rows, 16, 64, 2, 256)
    twin = tables(sf_dir, "embeddings").sql(SQL["op12_vector_codes"])
    assert sorted(twin.select(*names).fetchall(), key=str) == seen
