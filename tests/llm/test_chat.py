import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import chat
from tallyweave.llm.queries import op10_chat_formatting

from .brute import tables

ALPHABET = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "|", ">", "n", "\n", "é", "im_start|>", "<\\", "s>", "INST]"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ALPHABET, ALPHABET), min_size=1, max_size=4))
def test_escapes_come_back(turns):
    roles, texts = zip(*turns, strict=True)
    out, offs, begin = chat.assembled(pa.array(roles, pa.string()), pa.array(texts, pa.string()))
    whole = out.tobytes().decode()
    assert chat.parsed(whole) == turns
    for t in chat.escaped(pa.array(texts, pa.string())).to_pylist():
        assert not any(c in t for c in chat.CONTROLS)
    assert len(offs) == len(turns) + 1 and len(begin) == len(turns)


def expected(rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) for x in r[1:]))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (None, 0, "assistant", "é<s>"), (2, 0, "ro\nle\\n", "a\\"), (2, 0, "ro\nle\\n", "a\\"), (3, 1, "assistant", "z" * 200_000), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    got = chat.conversation_digests(chat.format_chats(df)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    assert chat.conversation_digests(chat.format_chats(df.limit(0))).collect() == []


def test_a_long_conversation_in_pieces(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * 3000) for i in range(300)] + [(8, 0, "assistant", "x")]
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert formatted.where("conv_id = 9").count() > 2
    assert sorted((tuple(r)[:5] for r in chat.conversation_digests(formatted).collect()), key=str) == expected(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    got = op10_chat_formatting(spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    per_turn = len(chat.START) + len(chat.END) + 2
    assert {r.conv_id: r.formatted_chars for r in got}[-7] == 2 * per_turn + len("user") + len("assistant") + 2 * (len(text) + 3)


def test_query_matches_sql(spark, sf_dir):
    want = tables(sf_dir, "conversations").sql(chat.SQL)
    got = sorted(tuple(r) for r in op10_chat_formatting(spark, sf_dir).select(*want.columns).collect())
    assert got == sorted(want.fetchall())
