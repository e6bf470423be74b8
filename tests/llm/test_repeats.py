import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import repeats
from tallyweave.llm.queries import op8_suffix_dedup
from tallyweave.llm.runindex import RunIndex

ODD = [None, "", "short", "é" * 40, "ab" * 60, "x" * 300]


def expected(docs, length):
    """docs: [(id, text)] -> [(id, bytes, removed, spans, hash of the rest)]"""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        cover = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cover[s] += 1
                cover[s + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(rows):
    return sorted(((r.doc_id, r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


def passages(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choices("abcdef é\n", k=n))
    shared = [text(rnd.randint(15, 90)) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            parts.append(text(rnd.randint(0, 60)))
            if rnd.random() < 0.6:
                s = rnd.choice(shared)
                parts.append(s[rnd.randint(0, 5) :])
        docs.append((i, "".join(parts)))
    return docs + [(100, docs[0][1]), (100, docs[0][1]), (None, docs[1][1])] + [(200 + i, t) for i, t in enumerate(ODD)]


def test_matching_statistics():
    rnd = random.Random(2)
    texts = [bytes(rnd.choices(b"ab", k=rnd.randint(0, 30))) for _ in range(20)]
    index = RunIndex.build(texts)
    got = index.matching_statistics()
    whole = [(i, j) for i, t in enumerate(texts) for j in range(len(t))]
    for i, j in whole:
        best = 0
        for k, m in whole:
            if (i, j) != (k, m):
                n = 0
                while j + n < len(texts[i]) and m + n < len(texts[k]) and texts[i][j + n] == texts[k][m + n]:
                    n += 1
                best = max(best, n)
        assert got[index.starts[i] + j] == best
    assert index.runs < len(index.symbols)


@pytest.mark.parametrize(("seed", "group_bytes"), [(1, 1 << 20), (2, 200), (3, 0)])
def test_spans_match_plain_python(spark, seed, group_bytes):
    docs = passages(seed)
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string")
    got = repeats.without_repeats(df, length=20, gram=6, group_bytes=group_bytes).collect()
    assert digest(got) == expected(docs, 20)


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op8_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(docs, 400)
