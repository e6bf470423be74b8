import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyweave.llm import tokens
from tallyweave.llm.queries import op2_token_output
from tallyweave.llm.runtime import fresh_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "Don't stop 'til 12,345!\x0b\x0cend", "é é ́x İstanbul ß", "<|endoftext|> a<|startoftext|>b", "word " * 3000, "x" * 5000, "日本語 テスト 🙂🙂", "A, b. C., d.. e.,f g,h I's, 1. ²,\n.x ,y É. E\u0301, <|ENDOFTEXT|> A, b.", "Wort. Ende.", "<|ENDOFTEXT|>"]


def expected(docs):
    t, at, out = Tokenizer.from_file(VOCABULARY), 0, []
    for i, text in sorted(docs, key=lambda d: d[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_words_encode_as_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    encode = tokens.WordEncoder(VOCABULARY)
    t = Tokenizer.from_file(VOCABULARY)
    for texts in (ODD, [], ODD[3:6], [t for t in ODD if "<|" not in (t or "")], ["a b c d e f g h a b c"]):
        ids, offs = encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip_and_layout(spark, encoding, tmp_path):
    import pyarrow.parquet as pq

    docs = [(i * 7 % 50, t, "m") for i, t in enumerate(ODD * 4)] + [(None, "null id", "m")]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string")
    path = f"file://{tmp_path}/{encoding}"
    tokens.write_tokens(df, path, VOCABULARY, end_id=1, metadata=("shard",), encoding=encoding, apart=True, lower=True)
    got = tokens.read_tokens(spark, path, ("tokens", "meta.shard")).orderBy("start").collect()
    assert len(got) == len(docs) and got[0].doc_id is None and got[0].shard == "m"
    t, at = Tokenizer.from_file(VOCABULARY), 0
    texts = {}
    for i, x, _ in docs:
        texts.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    for r in got:
        assert r.start == at and r.tokens in texts[r.doc_id]
        texts[r.doc_id].remove(r.tokens)
        at += r.n_tokens
    one = next(p for p in (tmp_path / encoding / "tokens").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    column = next(c for c in (pq.ParquetFile(one).metadata.row_group(0).column(i) for i in range(6)) if c.path_in_schema.startswith("tokens"))
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta") and column.has_offset_index


def test_whole_texts_by_default_and_words_only_where_right(spark, tmp_path):
    other = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "Hello, World. It's  3.14!", "tab\there\nA.B"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, vocabulary in enumerate((VOCABULARY, other)):
        path = f"file://{tmp_path}/whole{n}"
        tokens.write_tokens(df, path, vocabulary)
        t = Tokenizer.from_file(vocabulary)
        assert [r.tokens for r in tokens.read_tokens(spark, path).orderBy("doc_id").collect()] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    tokens.check_words(VOCABULARY, True)
    for lower in (True, False):
        with pytest.raises(ValueError, match="whole texts"):
            tokens.write_tokens(df, f"file://{tmp_path}/never", other, apart=True, lower=lower)


def test_empty_table(spark):
    path = fresh_path(spark, "none")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, VOCABULARY)
    assert tokens.read_tokens(spark, path).collect() == []


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op2_token_output(spark, sf_dir).collect()) == expected(docs)
