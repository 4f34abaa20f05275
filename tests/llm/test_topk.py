import math

import numpy as np
import pytest

from penprint.llm import topk as K


def brute(rows, every=50, k=5):
    whole = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for i, q in whole:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in whole if j != i and len(x) == len(q))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("page", [40, 4096])
def test_equals_brute_force(spark, page):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(300 + i, rng.integers(-1, 2, 8).astype(float).tolist()) for i in range(200)]  # many ties
    rows += [(600 + i, [0.5] * 8) for i in range(120)]
    rows += [(1000, None), (1001, [None] * 8), (1050, [float("nan")] * 8), (1100, [1.0, 2.0]), (1101, [3.0, 4.0]), (1150, []), (None, [1.0] * 8), rows[0], rows[7], (1200, [1e9] * 8)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, v string").repartition(3)
    assert {tuple(r) for r in K.top_k(df, page=page).collect()} == brute(rows)


def test_stored_distances_save_work():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 6)) * 300
    x = np.floor(centres[rng.integers(40, size=4000)] + rng.standard_normal((4000, 6)) * 5).astype(np.int64)
    tree = K.MTree(x, np.arange(4000))
    for i in range(0, 4000, 400):
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
        assert tree.search(x[i], 5, i) == [(-s, j) for s, j in want]
    assert tree.computed < 10 * 4000 / 3


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.top_k(df).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert K.top_k(one).collect() == []
