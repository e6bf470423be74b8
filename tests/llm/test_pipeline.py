import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyweave.llm import decontaminate, mixing

from . import brute


def test_run_matches_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == columns
    rows = {r.doc_id: r for r in kept.collect()}
    base = {r.doc_id for r in docs.collect() if not brute.quality(r.text)["base_failed"]}
    assert set(rows) <= base and len(rows) >= 0.8 * len(base)

    # near duplicates: the smallest id of each class, by all pairs
    ids = sorted(rows)
    classes = brute.link_classes([(i, rows[i].text) for i in ids], 8, 10, 5)
    left = {ids[k] for k, (n, members) in enumerate(classes) if n == 0 or min(members) == k}

    # decontamination and mixing: by SQL over what is left
    con = brute.tables(sf_dir, "benchmark")
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", [(i, rows[i].text, rows[i].lang, rows[i].source) for i in left])
    leaks = {r[0] for r in con.sql(f"select distinct doc_id from ({decontaminate.SQL})").fetchall()}
    con.execute(f"delete from documents where doc_id in (select doc_id from ({decontaminate.SQL}))")
    sampled = sorted(r[0] for r in con.sql(f"select doc_id from ({mixing.sql()}) where kept").fetchall())
    assert leaks and sampled

    t, at, want = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY)), 0, []
    for i in sampled:
        own = [*t.encode(rows[i].text, add_special_tokens=False).ids, corpus_pipeline.END_ID]
        want.append((i, rows[i].lang, rows[i].source, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(tuple(r) for r in got.select("doc_id", "lang", "source", "start", "n_tokens", "ids_crc32").collect()) == want


def test_stages_keep_odd_tables_whole(spark, sf_dir):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 4, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, sf_dir).columns == df.columns
        assert corpus_pipeline.token_output(spark, df, sf_dir).count() == df.count()


def test_stages_keep_long_tied_and_clashing_rows(spark, sf_dir):
    """A very long text, ties in ids, repeated rows, columns with the operators' own names."""
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text + " x", "en", "s", 2), (2, " ".join(f"v{i}" for i in range(60_000)), "en", "s", 3), (3, "short", None, None, 4)]
    odd = spark.createDataFrame([(*r, r[4], "t", "u") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, topic string, text_key string")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns
        counts.append(out.count())
    assert counts[1] == 3 and counts[2] == 5  # one of the three near copies, the long and the short text; no leaks
    got = corpus_pipeline.token_output(spark, odd, sf_dir).collect()
    assert len(got) == 5 and max(r.n_tokens for r in got) > 60_000
