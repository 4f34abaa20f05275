import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from penprint.llm import bpe

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.ranks_of(open(VOCABULARY, "rb").read())
WHOLE = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = bpe.Codec(RANKS, P.PATTERN, leaf=5, piece=6)
PARTS = st.sampled_from([" ", "  ", "\n", "\r\n", "\t", "\xa0", "\u2028", "\x1c", "\x85", "'s", "'ll", "'", "a", "ab", "the", "ation", "É", "e\u0301", "漢字", "\U0001f600", "1", "23", "!", "...", "<|endoftext|>", "_", "\u200b", "aaaaaaaaaaaaaaaa", "1111111111"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=40).map("".join))
def test_small_leaves_equal_the_library(text):
    tokens = SMALL.encode(text)
    assert tokens == WHOLE.encode_ordinary(text)
    assert SMALL.decode(tokens) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert SMALL.encode(text) == WHOLE.encode_ordinary(text)


@pytest.mark.parametrize("run", ["a", "ab", "the", "7", "12", "!", "-", " ", "\n", " \n", "é"])
def test_very_long_runs(run):
    codec = bpe.Codec(RANKS, P.PATTERN, leaf=4_096, piece=256)
    for text in (run * 30_000, " " + run * 20_000 + " x", "x" + run * 9_999 + "y"):
        assert codec.encode(text) == WHOLE.encode_ordinary(text)


def test_random_letters_in_one_run():
    rng = random.Random(1)
    codec = bpe.Codec(RANKS, P.PATTERN, leaf=512, piece=32)
    for _ in range(40):
        text = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 5_000)))
        assert codec.encode(text) == WHOLE.encode_ordinary(text)


def test_table(spark):
    texts = ["", None, "same words", "same words", "x" * 300_000, "é\n" * 10_000]
    df = spark.createDataFrame([(i if i else None, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, tokens string")
    got = {r.doc_id: r for r in bpe.round_trip(df, VOCABULARY, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        tokens = WHOLE.encode_ordinary(t or "")
        r = got[i if i else None]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r.doc_id: bytes(r.data) for r in bpe.decode_documents(bpe.encode_documents(df, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN).collect()}
    assert back == {i if i else None: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.round_trip(df.limit(0), VOCABULARY, P.PATTERN).collect() == []


def test_every_token_is_reached_by_merges():
    """The pair test at a seam holds for vocabularies whose tokens BPE makes from their own bytes."""
    for token in list(RANKS)[::7]:
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            ranked = [(RANKS[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in RANKS]
            assert ranked, token
            i = min(ranked)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
