import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from penprint.llm import suffix_dedup as S

LENGTH, GRAM = 24, 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=80) | st.lists(st.sampled_from([b"a", b"\0", b"ab" * 20, b"a" * 40]), max_size=6).map(b"".join), max_size=40))
def test_deep_shallow_order(strings):
    order = S.deep_shallow_order(strings)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


@given(st.binary(max_size=30), st.binary(max_size=30))
def test_lcp(a, b):
    n = S.lcp(a, b)
    assert a[:n] == b[:n] and (n in (len(a), len(b)) or a[n] != b[n])


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=24, max_size=200) | st.lists(st.sampled_from([b"a", b"b", b"abab"]), min_size=24, max_size=100).map(b"".join))
def test_every_window_has_an_anchor_that_it_alone_decides(data):
    by_half, runs = S.anchors_by_half(data, LENGTH, GRAM)
    at = set(np.union1d(*by_half).tolist())
    anchored = set()
    for i in range(len(data) - LENGTH + 1):
        own = data[i:i + LENGTH]
        if any(a <= i and i + LENGTH <= b for a, b in runs) and own in anchored:
            continue  # a later period of a run, which is covered as it is
        assert set((S.anchors(own, LENGTH, GRAM) + i).tolist()) <= at
        assert len(S.anchors(own, LENGTH, GRAM))
        anchored.add(own)
    for a, b in runs:
        period = next(p for p in range(1, LENGTH) if data[a:b - p] == data[a + p:b])
        assert b - a >= LENGTH + period


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, s in enumerate(data):
        for i in range(len(s) - length + 1):
            seen.setdefault(s[i:i + length], []).append((d, i))
    hit = [np.zeros(len(s), bool) for s in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                hit[d][i:i + length] = True
    out = []
    for s, h in zip(data, hit, strict=True):
        edges = np.diff(np.concatenate([[0], h.astype(np.int8), [0]]))
        kept = bytes(np.frombuffer(s, np.uint8)[~h])
        out.append((len(s), int(h.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(14), text(40)
    out = [text(rng.randrange(0, 60)) for _ in range(40)]
    out += [text(rng.randrange(0, 12)) + passage[rng.randrange(3):len(passage) - rng.randrange(3)] + text(rng.randrange(0, 12)) for _ in range(60)]
    out += [other[rng.randrange(60):][:rng.randrange(20, 140)] for _ in range(30)]
    out += [out[50], out[51], out[51], other + "|" + other, "x" * 200, "xyz" * 60, "y" + "x" * 40, "", None, "short", "\U0001f600" * 30]
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, 1000), (2, 3)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, most):
    """With small bounds, so that hot cores take the other way too."""
    monkeypatch.setattr(S, "MOST_OUTER", most)
    monkeypatch.setattr(S, "EACH", 40)
    real = S.repeated_ranges
    monkeypatch.setattr(S, "repeated_ranges", lambda docs, length, **kw: real(docs, length, GRAM, **kw))
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.removal_digests(df, LENGTH).collect()}
    want = dict(enumerate(brute(texts, LENGTH)))
    assert {i: (got[i], texts[i]) for i in got if got[i] != want[i]} == {}
    assert len(got) == len(texts)
    new = {r.doc_id: r for r in S.remove_repeats(df, LENGTH).collect()}
    for i, t in enumerate(texts):
        assert new[i].key == "n"
        if t is not None and t.isascii():
            assert hashlib.sha256(new[i].text.encode()).hexdigest() == want[i][3]
        else:
            assert (new[i].text is None) == (t is None)


def test_nulls_repeats_and_empty_table(spark):
    long = "".join(random.Random(5).choice("abcdefgh") for _ in range(900))
    rows = [(None, long), (None, long), (3, "unlike " + long[100:520]), (4, None), (5, ""), (6, long[:399]), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in S.removal_digests(df).collect())
    assert got == sorted([(0, 900, 900, 1), (0, 900, 900, 1), (3, 427, 420, 1), (4, 0, 0, 0), (5, 0, 0, 0), (6, 399, 0, 0), (3, 0, 0, 0)])
    assert S.removal_digests(df.limit(0)).collect() == []
    assert S.remove_repeats(df.limit(0)).columns == ["doc_id", "text"]


def test_character_cuts():
    data = "aéb".encode()
    assert S.whole_characters(data, [(2, 4)]) == [(3, 4)]
    assert S.whole_characters(data, [(0, 2)]) == [(0, 1)]
    assert S.whole_characters(data, [(1, 3)]) == [(1, 3)]


def test_passages_of_over_fifty_words_go_and_lines_stay(spark):
    """With the bounds of the pipeline: every passage of 51 words that occurs again, whatever is around it, and nothing else."""
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages, lines = [text(51) for _ in range(12)], [text(40) for _ in range(6)]
    assert min(map(len, passages)) < 300 and min(map(len, lines)) > 200
    around = [(text(rng.randrange(20, 90)), text(rng.randrange(20, 90))) for _ in range(60)]
    rows = [(i, f"{a} {(passages + lines)[i % 18]} {b}", i % 18) for i, (a, b) in enumerate(around[:54])] + [(100 + i, f"{a} {b}", -1) for i, (a, b) in enumerate(around[54:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, of int")
    for r in S.remove_repeats(df, 200, words=50).collect():
        whole = dict((i, t) for i, t, _ in rows)[r.doc_id]
        if 0 <= r.of < 12:
            a, b = around[r.doc_id]
            assert passages[r.of] not in r.text and len(a) + len(b) - 20 <= len(r.text) <= len(a) + len(b) + 2
        else:
            assert r.text == whole


def test_query_tells_passages_of_over_fifty_words_beside_strings_of_400_bytes(spark, tmp_path):
    """Passages of 51 words hold no string of 400 bytes: ``n_removed`` rightly leaves them, the passage columns don't."""
    from penprint.llm.queries import op5_suffix_dedup

    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    planted, lines, long = [text(51) for _ in range(8)], [text(40) for _ in range(4)], text(120)
    texts = [f"{text(rng.randrange(20, 90))} {p} {text(rng.randrange(20, 90))}" for p in [*planted, *lines, long] * 3]
    texts += [text(100) for _ in range(8)] + [texts[0][50:], "\U0001f600" * 120, None, ""]
    texts.append(texts[39])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    seen = {}
    for t in texts:
        data = (t or "").encode()
        for at in range(len(data) - 199):
            seen[data[at:at + 200]] = seen.get(data[at:at + 200], 0) + 1
    for i, t in enumerate(texts):
        data = (t or "").encode()
        hit = bytearray(len(data))
        for at in range(len(data) - 199):
            if seen[data[at:at + 200]] > 1:
                hit[at:at + 200] = b"\1" * 200
        edges = np.flatnonzero(np.diff(np.array([0, *hit, 0], np.int8)))
        runs = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= 400 or len(data[a:b].split()) >= 50]
        assert (got[i].n_passages, got[i].n_passage_bytes) == (len(runs), sum(b - a for a, b in runs))
    for i in range(39):
        if i % 13 < 8:
            assert got[i].n_passages == 1 and got[i].n_passage_bytes >= len(planted[i % 13])
            assert got[i].n_removed == 0 or i == 0  # most of text 0 is copied below
        elif i % 13 < 12:
            assert got[i].n_passages == 0
        else:
            assert got[i].n_removed and got[i].n_passages
    assert all(got[i].n_passages == 0 for i in range(40, 47))
