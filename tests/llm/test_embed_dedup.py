import numpy as np
import pytest

from penprint.llm import embed_dedup as E


def brute(rows, threshold=0.98):
    """(n_links, component) of each row, all pairs compared."""
    n = len(rows)
    ok = [i is not None and lab is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, lab, v in rows]
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = (np.array(rows[x][2], float) / max(map(abs, rows[x][2])) for x in (i, j))
                if rows[i][2] == rows[j][2] or a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    top[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    return [(links[i], least.get(root(i)) if rows[i][0] is not None else None) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for c in range(60):
        centre = rng.standard_normal(16)
        for _ in range(1 + c % 7):
            out.append((c % 3, (centre + rng.standard_normal(16) * 0.03 * (c % 4)).tolist()))
    centre = rng.standard_normal(16)
    out += [(1, (centre + rng.standard_normal(16) * 0.12).tolist()) for _ in range(150)]  # one large group, not all linked
    out += [out[0], out[0], (2, out[0][1]), (None, out[0][1]), (1, [0.0] * 16), (1, None), (1, []), (1, [None] * 16), (1, [float("nan")] * 16), (1, [float("inf")] * 16), (1, [1.0] * 4), (1, [2.0] * 4), (1, [1e-200] * 16), (1, [1e200] * 16)]
    return [(i, lab, v) for i, (lab, v) in enumerate(out)] + [(None, 1, out[0][1])]


def test_links_and_components_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 32)
    df = spark.createDataFrame([(i, v, lab, "n") for i, lab, v in rows], "vec_id long, embedding array<double>, label int, kept string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(df, leaf=24).collect()}
    want = {i: w for (i, *_), w in zip(rows, brute(rows), strict=True)}
    assert set(got) == set(want)
    assert {i: (got[i], want[i]) for i in got if got[i] != want[i]} == {}


def test_forest_recall():
    """Leaves of the forest hold nearly all pairs at the threshold."""
    rng = np.random.default_rng(5)
    x = E.unit(rng.standard_normal((4000, 64)).tolist())
    near = x[:500] + rng.standard_normal((500, 64)) * (0.2 / 8)
    near = E.unit(near.tolist())
    trees = [E.Tree(x, 6, 0.2 / 8 / 2, s) for s in range(8)]
    a, b = [t.leaves(x[:500]) for t in trees], [t.leaves(near) for t in trees]
    met = [any(set(p[i]) & set(q[i]) for p, q in zip(a, b, strict=True)) for i in range(500)]
    assert np.mean(met) >= 0.999
    assert np.mean([len(w) for t in a for w in t]) < 2


def test_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.1], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, E.near_vectors(df).collect())) == [(3, 3, 3, True), (4, 3, 3, False), (5, 3, 3, False), (5, 3, 3, False)]
    assert E.near_vectors(df.limit(0)).collect() == []
