import numpy as np
import pytest

from penprint.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = [(i, (np.array([4.0 * (i % 2), 0.0, 0.0]) + rng.standard_normal(3) * .5).tolist(), f"c{i % 2}") for i in range(60)]
    return spark.createDataFrame(data, "doc_id long, features array<double>, label string")


def test_reduction_equals_numpy(rows):
    x = np.array([r.features for r in rows.orderBy("doc_id").collect()])
    for method, data in (("pca", x - x.mean(axis=0)), ("svd", x)):
        got = np.array([r.components for r in M.reduce_dimensions(rows, 2, method).orderBy("doc_id").collect()])
        want = data @ np.linalg.svd(data, full_matrices=False)[2][:2].T
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    with pytest.raises(ValueError):
        M.reduce_dimensions(rows, 9)


def test_clusters_and_classifiers(rows):
    found = {(r.cluster, r.label) for r in M.cluster(rows, 2, starts=2).collect()}
    assert len(found) == 2
    for kind in M.CLASSIFIERS:
        assert M.accuracy(M.train_classifier(rows, kind, trees=5)(rows)) > .95
    with pytest.raises(ValueError):
        M.train_classifier(rows.where("label = 'c0'"))


def test_importance_verification_and_leakage(spark, rows):
    predict = M.train_classifier(rows)
    drops = M.permutation_importance(rows, lambda r: M.accuracy(predict(r)), 2)
    assert drops[0][1] > .2 > abs(drops[1][1]) + abs(drops[2][1])
    pairs = spark.createDataFrame([(0, 2), (0, 1)], "left_id long, right_id long")
    assert {(r.left_id, r.right_id): r.accepted for r in M.calibrated_verification(rows, pairs).collect()} == {(0, 2): True, (0, 1): False}
    assert M.topic_leakage(rows, 3, "label") > .9
    with pytest.raises(ValueError):
        M.topic_leakage(rows, 2, "label")  # even and odd rows: each fold is trained on one label


def test_anova(spark):
    assert M.incomplete_beta(2, 3, .4) == pytest.approx(.5248) and M.incomplete_beta(.5, .5, .5) == pytest.approx(.5)
    rng = np.random.default_rng(1)
    data = [(f"a{i}", f"t{j}", float(3 * i + rng.standard_normal())) for i in range(2) for j in range(3) for _ in range(5)]
    got = {r.factor: r for r in M.two_way_anova(spark.createDataFrame(data, "author string, topic string, value double"))}
    assert got["author"].p < 1e-4 and got["topic"].p > .01 and got["residual"].df == 24
    assert sum(r.sum_squares for r in got.values()) == pytest.approx(np.var([d[2] for d in data]) * len(data))
