import random

import numpy as np
import pytest

from penprint.llm import minhash as M


def edit(words, rng, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        what = rng.randrange(3)
        if what == 0:
            words[i] = f"x{rng.randrange(10**6)}"
        elif what == 1 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, f"y{rng.randrange(10**6)}")
    return words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))]
        b = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))] if rng.random() < 0.5 else [rng.randrange(1, 5) if rng.random() < 0.1 else x for x in a if rng.random() < 0.95] or [1]
        for t in (0.5, 0.8):
            assert M.aligned(np.array(a, np.uint32), np.array(b, np.uint32), t) == (distance(a, b) <= int((1 - t) * max(len(a), len(b)) + 1e-9)), (a, b, t)


def brute(texts):
    """Classes by comparing all pairs."""
    words_of = M.Words()
    words = [words_of(t or "") for t in texts]
    shingled = [M.shingles(w) for w in words]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or len(words[i]) and len(words[j]) and M.alike(words[i], words[j], 5, 0.8, shingled[i], shingled[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    out += [" ".join(edit(base, rng, rng.randrange(1, 9))) for _ in range(120)]  # one group, members at all distances
    for _ in range(30):
        b = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 400))]
        out.append(" ".join(b))
        out += [" ".join(edit(b, rng, rng.randrange(1, 2 + len(b) // 30))) for _ in range(2)]
    passage = [f"p{i}" for i in range(60)]
    out += [" ".join([f"q{rng.randrange(9999)}" for _ in range(60)] + passage) for _ in range(20)]
    out += ["", None, "", "  ", "!!! ...", "one two", "One two.", "one two", "a b c", *out[:3], "Z " + " ".join(f"l{i}" for i in range(30_000)), "Y " + " ".join(f"l{i}" for i in range(30_000))]
    return out


def test_classes_equal_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    df = spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(texts)], "doc_id long, text string, class_id int, kept boolean").repartition(3)
    got = {r.doc_id: r for r in M.near_duplicates(df).collect()}
    assert {i: got[i].class_id for i in got} == dict(enumerate(brute(texts)))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "other text"), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (8, "u v w"), (8, "x y z"), (9, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(map(sorted, ([(-1 if x is None else x) for x in v] for v in by_text.values()))) == [[-1], [-1, -1, 7, 7], [8, 8, 9]]
    assert M.near_duplicates(df.limit(0)).collect() == []
