import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from penprint.llm import chat

PARTS = st.sampled_from([*chat.CONTROL, "<", "[", "]", "\\", "\\\\", "/", "s>", "INST]", "ROLE", "0]", "a", "\n", "é", "\U0001f600"])
TEXT = st.lists(PARTS, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    rendered, got = chat.format_turns(turns)
    assert [x[:2] for x in got] == turns
    assert [x[:2] for x in chat.parse(rendered)] == turns
    assert [chat.unescape(rendered[s:e], k) for _, _, k, s, e in got] == [t for _, t in turns]


@given(TEXT, st.sampled_from([0, 1, 2]))
def test_escapes_invert(text, level):
    assert chat.unescape(chat.escape(text, level), level) == text
    if level == 2:
        assert not any(c in chat.escape(text, level) for c in chat.CONTROL)


def test_parser_rejects_what_is_no_sentence():
    assert chat.parse("<s>[ROLE0]user[INST]x[/INST]") is None
    assert chat.parse("") == []


def test_table(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, None, ""), (None, 0, "user", "x" * 200_000), (2, 0, "assistant", hard), (2, 0, "assistant", "é")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    want = {1: [("", ""), ("user", ""), ("assistant", "b"), ("assistant", "b")], None: [("user", "x" * 200_000)], 2: [("assistant", hard), ("assistant", "é")]}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).collect() == []
