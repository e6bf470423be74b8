import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import toxicity
from tallyweave.llm.queries import op3_toxicity


def corpus(n=600):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    bad = ["grumblefink", "snotwort", "duncehat", "Vile-Toad"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = rnd.choices(words, k=rnd.randint(5, 120))
        if toxic:
            for _ in range(rnd.randint(2, 4)):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        if i % 50 == 1:
            text += ["junkword"] * 200
        docs.append((i, " ".join(text)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_finds_held_out_toxic_texts(spark):
    docs, labels = corpus()
    rows = toxicity.toxicity(*frames(spark, docs, labels)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [(r.score >= 0.7, r.doc_id % 5 == 0) for r in rows if r.held_out]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(200)
    turned = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in labels]
    a = {r.doc_id: r.score for r in toxicity.toxicity(*frames(spark, docs, labels)).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(*frames(spark, docs, turned)).collect()}
    assert a == pytest.approx(b)


def test_odd_rows(spark):
    docs, labels = corpus(200)
    odd = [(None, "text"), (900, None), (901, ""), (902, " \n"), (903, "x" * 100_000), (3, docs[3][1]), (3, "snotwort duncehat")]
    rows = toxicity.toxicity(*frames(spark, docs + odd, labels + [(None, 1, 1), (4, 1, None), (5, 1, 1), (5, 1, 0)])).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    empty, none = frames(spark, docs, labels)[0].limit(0), frames(spark, docs, labels)[1].limit(0)
    assert toxicity.toxicity(empty, none).collect() == []
    assert {r.score for r in toxicity.toxicity(frames(spark, docs, labels)[0], none).collect()} == {0.0}


def test_ratios_match_plain_python(spark):
    """The three orders, counted and interpolated again with dictionaries."""
    import re
    from collections import Counter, defaultdict

    docs, labels = corpus(400)
    known = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    words = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in docs}
    pairs_of = lambda ws: list(zip([None, *ws[:-1]], ws, strict=True)) if ws else []
    d, d2, cut = toxicity.DISCOUNT, toxicity.PAIR_DISCOUNT, toxicity.STEM_BYTES
    pairs = [Counter(), Counter()]
    for i, t in known.items():
        pairs[t].update(set(pairs_of(words[i])))
    cont = [Counter(w for _, w in c) for c in pairs]
    stem = [Counter() for _ in cont]
    for c, k in zip(stem, cont, strict=True):
        for w, n in k.items():
            c[w[:cut]] += n
    first = [Counter(), Counter()]
    handed = [Counter(), Counter()]
    for c in (0, 1):
        for (v, _), n in pairs[c].items():
            first[c][v] += n
            handed[c][v] += max(n - d2, 0)

    df, lab = frames(spark, docs, labels)
    model = toxicity.fitted(df, toxicity.labelled(df, lab, "doc_id", "text", 10**6))[0]
    before = defaultdict(set)
    for ws in words.values():
        for v, w in pairs_of(ws):
            before[w].add(v)

    def above(c):
        return {k: max(n - d, 0) for k, n in c.items()}

    def level(counts, key, lower):
        mass = [sum(above(c).values()) for c in counts]
        share = 1 - sum(mass) / sum(c.total() for c in counts)
        return [(1 - share) * max(c[key] - d, 0) / max(m, 1) + share * low for c, m, low in zip(counts, mass, lower, strict=True)]

    def ratio(v, w, follows, stem_follows):
        by_stem = [x / stem_follows for x in level(stem, w[:cut], [stem_follows] * 2)] if sum(c[w[:cut]] for c in stem) > d else [1, 1]
        if sum(c[w] for c in cont) <= d:
            return np.log(by_stem[1] / by_stem[0])
        low = level(cont, w, [follows * x for x in by_stem])
        top = [max(pairs[c][v, w] - d2, 0) / max(first[c][v], 1) + (1 - handed[c][v] / max(first[c][v], 1)) * low[c] for c in (0, 1)]
        return np.log(top[1] / top[0])

    # The shared counts are sketched: take the exact ones where the sketch is, and allow for the difference.
    texts = [t for _, t in docs[:60]]
    total = sum(len(s) for s in before.values())
    stems = Counter()
    for w, s in before.items():
        stems[w[:cut]] += len(s)
    strongest, whole = model.features(pa.array(texts, pa.string()))
    for (i, _), s, m in zip(docs[:60], strongest, whole, strict=True):
        r = sorted((ratio(v, w, len(before[w]) / total, stems[w[:cut]] / total) for v, w in pairs_of(words[i])), reverse=True)
        assert m == pytest.approx(np.mean(r), abs=0.15)
        assert s == pytest.approx(sum(max(x, 0) for x in r[: toxicity.STRONGEST]) / toxicity.STRONGEST, rel=0.1, abs=0.3)


def test_pairs_of_ordinary_words_are_found(spark):
    """Words that both classes have alike, toxic only one after the other."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(900):
        text = rnd.choices(words, k=60)
        for at in rnd.sample(range(0, 58, 2), 4):
            text[at : at + 2] = ["go", "away"] if i % 3 == 0 else ["away", "go"]
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 3 == 0)))
    rows = toxicity.toxicity(*frames(spark, docs, labels)).collect()
    out = [(r.score >= 0.7, r.doc_id % 3 == 0) for r in rows if r.held_out]
    assert sum(p == y for p, y in out) >= 0.95 * len(out)


def test_joined_models_score_alike(spark, monkeypatch):
    docs, labels = corpus()
    docs = [*docs, (10_001, None), (10_002, ""), (10_003, docs[0][1]), (10_003, docs[0][1])]
    score = lambda: sorted((r.doc_id, round(r.score, 4)) for r in toxicity.toxicity(*frames(spark, docs, labels)).collect())
    sent = score()
    monkeypatch.setattr(toxicity, "MOST_ROWS", 0)
    assert score() == sent


def test_query(spark, sf_dir):
    rows = op3_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
