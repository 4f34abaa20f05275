import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from penprint.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 6)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 400))
def test_budget(counts, budget):
    take = mixing.fit_budget(counts, budget)
    assert all(0 <= t <= c for t, (_, c) in zip(take, counts, strict=True))
    got, total = sum(t * s for t, (s, _) in zip(take, counts, strict=True)), sum(s * c for s, c in counts)
    assert got <= budget or got == total <= budget
    assert got >= min(budget, total) - max(s for s, _ in counts)


def test_budget_of_many_lengths():
    counts = [(1, 1), *((n, 1) for n in range(20_002, 30_002, 2))]
    assert sum(t * s for t, (s, _) in zip(mixing.fit_budget(counts, 59_999), counts, strict=True)) == 59_999


def test_targets():
    assert mixing.target_sizes([100, 100, 100], [3, 1, 2], 450, 2.0) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.target_sizes([], [], 0, 2.0) == []
    assert mixing.target_sizes([0, 10], [3, 1], 15, 2.0) == [0, 15]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}", "x") for i in range(400)] + [(1000 + i, "dup", None, "x") for i in range(300)] + [(2000, None, "s1", "x"), (2001, " \t\n", "s1", "x"), (None, "a b", "s2", "x"), (5, "w " * 36, "s1", "x"), (2002, "v " * 30_000, "s9", "x")]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    again = mixing.mix_sources(docs(spark, rows[::-1])).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr) or sorted(map(key, got)) == sorted(map(key, again))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == size[r.source] for r in got)
    order = sorted((s for s in size if s is not None)) + [None]
    want = mixing.target_sizes([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2.0)
    for s, t in zip(order, want, strict=True):
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= (15_000 if s == "s9" else 40), (s, taken[s], t)  # s9 is a single document
    words = re.compile(r"[^\x20\x09-\x0D]+")
    assert sorted(r["size"] for r in got) == sorted(len(words.findall(t or "")) for _, t, *_ in rows)


def test_empty(spark):
    assert mixing.mix_sources(docs(spark, [])).collect() == []
