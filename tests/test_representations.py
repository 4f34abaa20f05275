import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.operators import representations as R


def frame(spark, x, **more):
    cols = sorted(more)
    return spark.createDataFrame([(i, [float(a) for a in v], *(more[c][i] for c in cols)) for i, v in enumerate(x)], "doc_id long, features array<double>" + "".join(f", {c} string" for c in cols)).repartition(3)


def test_factors_recover_parts(spark):
    rng = np.random.default_rng(2)
    parts = np.array([[5, 4, 0, 0, 0, 0], [0, 0, 6, 3, 0, 0], [0, 0, 0, 0, 2, 7.0]])
    x = rng.random((60, 3)) @ parts
    loads, top, error = R.nmf(frame(spark, x), 3, rounds=25, top=2)
    assert {frozenset(t) for t in top} == {frozenset((0, 1)), frozenset((2, 3)), frozenset((4, 5))}
    assert error / (x * x).sum() < 1e-3 and loads.count() == 60
    for bad in (0, 2):
        with pytest.raises(ValueError):
            R.nmf(frame(spark, x if bad == 0 else -x), bad)


def test_one_class_keeps_what_is_like_the_data(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 2))
    w, _ = R.fit_one_class(x, 0.2, 0.5)
    assert w.sum() == pytest.approx(24) and w.min() >= -1e-9 and w.max() <= 1 + 1e-9
    train = frame(spark, x)
    share = np.mean([r.score < 0 for r in R.one_class_scores(train, train, 0.2).collect()])
    assert 0.1 <= share <= 0.3
    rows = frame(spark, [[1, 1], [-1, 0], [9, 9]])
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "left_id long, right_id long")
    assert {r.right_id: r.accepted for r in R.one_class_verification(train, rows, pairs, 0.2).collect()} == {1: True, 2: False}
    with pytest.raises(ValueError):
        R.one_class_scores(train, rows, 0.0)


def test_attributions_add_up(spark):
    x = np.random.default_rng(4).standard_normal((20, 3))
    rows, mean = R.linear_attributions(frame(spark, x), [1.0, -2.0, 0.0])
    got = {r.doc_id: sum(r.attributions) for r in rows.collect()}
    want = (x - x.mean(axis=0)) @ [1.0, -2.0, 0.0]
    assert np.allclose([got[i] for i in range(20)], want) and mean[2] == 0 and mean[1] > mean[0]
    with pytest.raises((ImportError, NotImplementedError)):
        R.shap_attributions()


def test_map_keeps_groups_apart(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((20, 5)), rng.standard_normal((20, 5)) + 30])
    got = {r.doc_id: np.array(r.position) for r in R.tsne_map(frame(spark, x), perplexity=8, rounds=300).collect()}
    y = np.array([got[i] for i in range(40)])
    near = np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(near, np.inf)
    assert np.mean((near.argmin(axis=1) < 20) == (np.arange(40) < 20)) > 0.95
    with pytest.raises(ValueError):
        R.tsne_map(frame(spark, x), perplexity=100)
    with pytest.raises(ImportError):
        R.umap_map(frame(spark, x))


def test_report(spark):
    x = [[i % 2, 1.0] for i in range(12)]
    rows = frame(spark, x, topic=[f"t{i % 2}" for i in range(12)]).cache()
    values = spark.createDataFrame([(i, "a", float(i)) for i in range(12)] + [(i, "b", 1.0) for i in range(12)], "doc_id long, feature string, value double")
    lengths = spark.createDataFrame([(i, 2 * i) for i in range(12)], "doc_id long, length long")
    got = R.style_report(rows, {"all": rows}, lambda r: float(r.count()), lengths, values, folds=3)
    assert got["topic_leakage"] > 0.9 and got["ablation"] == {"all": 12.0} and got["split"]["underpowered"] is False
    assert got["length_sensitivity"]["a"] == pytest.approx(1) and got["length_sensitivity"]["b"] == 0


def test_nmf_makes_its_vectors_once(spark):
    """Neither the check nor a round makes the vectors anew."""
    made = spark.sparkContext.accumulator(0)

    def vector(i):
        made.add(1)
        return [float(i % 3), float(i % 5), 1.0]

    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.udf(vector, "array<double>")("id").alias("features"))
    loads, *_ = R.nmf(rows, 2, rounds=2)
    assert loads.count() == 40 and made.value == 40
    with pytest.raises(Exception, match="unlike length"):
        R.nmf(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "doc_id long, features array<double>").coalesce(1), 1)
