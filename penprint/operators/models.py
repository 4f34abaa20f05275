"""Models over feature vectors: reduction, clustering, classifiers, verification, importance, topic controls, variance analysis.

Vectors come as ``features array<double>``. Training runs in ``pyspark.ml``; where it has nothing of the kind, sufficient
statistics are gathered by groups (as many rows as there are groups) and solved on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSIFIERS = ("logistic_regression", "linear_svm", "random_forest", "nearest_centroid")


def _vectors(rows: DataFrame, column: str = "features") -> DataFrame:
    return rows.withColumn("__v", array_to_vector(F.col(column)))


def reduce_dimensions(rows: DataFrame, k: int, method: str = "pca") -> DataFrame:
    """``rows`` with ``components array<double>``: of centred data (pca) or as it is (svd). The largest entry of each axis is positive."""
    if method not in ("pca", "svd"):
        raise ValueError(f"no such method: {method}")
    size = len(rows.select("features").first()[0])
    if not 1 <= k <= size:
        raise ValueError(f"between 1 and {size} components")
    from penprint.operators.representations import gram as sums

    # the Gram matrix of the features, added up by partition: as large as the vectors are long, squared
    n, means, gram = sums(rows)
    if method == "pca":
        gram -= n * np.outer(means, means)
    _, axes = np.linalg.eigh(gram)
    axes = axes[:, ::-1][:, :k]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    shift = means if method == "pca" else np.zeros(size)
    part = lambda c: F.aggregate(F.zip_with("features", F.array(*[F.lit(float(x)) for x in axes[:, c]]), lambda x, w: x * w), F.lit(-float(shift @ axes[:, c])), lambda a, x: a + x)
    return rows.withColumn("components", F.array(*[part(c) for c in range(k)]))


def cluster(rows: DataFrame, n_clusters: int, seed: int = 0, starts: int = 10) -> DataFrame:
    """``rows`` with ``cluster`` by k-means, the best of several starts."""
    from pyspark.ml.clustering import KMeans

    if not 1 <= n_clusters <= rows.count():
        raise ValueError("between 1 and as many clusters as rows")
    data = _vectors(rows)
    if n_clusters == 1:
        return rows.withColumn("cluster", F.lit(0))
    models = [KMeans(k=n_clusters, seed=seed + i, featuresCol="__v", predictionCol="cluster").fit(data) for i in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost).transform(data).drop("__v")


def train_classifier(rows: DataFrame, kind: str = "logistic_regression", label_col: str = "label", seed: int = 0, trees: int = 100) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``prediction`` (a label) and, where the model has them, ``probability`` in the labels' order."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier

    if kind not in CLASSIFIERS:
        raise ValueError(f"no such classifier: {kind}")
    labels = [r[0] for r in rows.select(label_col).distinct().orderBy(label_col).collect()]
    if len(labels) < 2 or None in labels:
        raise ValueError("at least two labels, none of them null")
    if kind == "nearest_centroid":
        from penprint.operators.evaluation import nearest_centroid

        return lambda more: more.join(nearest_centroid(rows.withColumnRenamed(label_col, "label"), more).drop("distance"), "doc_id")
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)) - 1
    data = _vectors(rows).withColumn("__y", place.cast("double"))
    common = {"featuresCol": "__v", "labelCol": "__y", "predictionCol": "__p"}
    if kind == "logistic_regression":
        # an L2 penalty of strength 1 on the sum of losses
        model = LogisticRegression(**common, regParam=1.0 / rows.count(), standardization=False, maxIter=200, probabilityCol="__prob").fit(data)
    elif kind == "random_forest":
        model = RandomForestClassifier(**common, numTrees=trees, seed=seed, probabilityCol="__prob").fit(data)
    else:
        model = OneVsRest(classifier=LinearSVC(featuresCol="__v", regParam=1.0 / rows.count(), standardization=False), **common).fit(data)

    def predict(more: DataFrame) -> DataFrame:
        out = model.transform(_vectors(more))
        out = out.withColumn("prediction", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("__p").cast("int") + 1))
        if "__prob" in out.columns:
            out = out.withColumn("probability", vector_to_array("__prob"))
        return out.select(*more.columns, "prediction", *(["probability"] if "probability" in out.columns else []))

    return predict


def accuracy(rows: DataFrame, label_col: str = "label") -> float:
    return float(rows.agg(F.avg((F.col("prediction") == F.col(label_col)).cast("double"))).first()[0])


def topic_leakage(rows: DataFrame, folds: int = 5, label_col: str = "topic") -> float:
    """Mean accuracy of telling topics over folds by ``index % folds`` (a dense index)."""
    from penprint.operators.evaluation import indexed

    if folds < 2:
        raise ValueError("at least two folds")
    data = indexed(rows).withColumn("__fold", F.col("index") % folds).drop("index")
    scores = []
    for f in range(folds):
        test = data.where(F.col("__fold") == f)
        if not test.isEmpty():
            scores.append(accuracy(train_classifier(data.where(F.col("__fold") != f), label_col=label_col)(test), label_col))
    return float(np.mean(scores))


def permutation_importance(rows: DataFrame, scorer: Callable[[DataFrame], float], repeats: int = 5, seed: int = 0) -> list[tuple[int, float, float]]:
    """``(feature, mean drop, population std)``: how much worse ``scorer`` gets when a feature's values change rows."""
    from penprint.operators.evaluation import indexed

    size, base = len(rows.select("features").first()[0]), scorer(rows)
    data = indexed(rows)
    out = []
    for i in range(size):
        drops = []
        for r in range(repeats):
            # two orders of the same rows, by id and by hash, give each row another's value
            mixed = indexed(data.select(F.xxhash64(F.lit(seed + r), F.col("doc_id")).alias("h"), F.get("features", F.lit(i)).alias("x")), "h").select(F.col("index"), "x")
            swapped = data.join(mixed, "index").withColumn("features", _replaced(i))
            drops.append(base - scorer(swapped.drop("index", "x")))
        out.append((i, float(np.mean(drops)), float(np.std(drops))))
    return out


def _replaced(i: int) -> Column:
    return F.transform("features", lambda v, j: F.when(j == i, F.col("x")).otherwise(v))


def calibrated_verification(rows: DataFrame, pairs: DataFrame, label_col: str = "label", threshold: float = 0.5) -> DataFrame:
    """``left_id, right_id, distance, accepted``: L1 distance of class probabilities below the threshold."""
    if rows.groupBy(label_col).count().where("count < 2").limit(1).count():
        raise ValueError("at least two samples of each class")
    p = train_classifier(rows, label_col=label_col)(rows).select("doc_id", "probability")
    both = pairs.join(p.withColumnsRenamed({"doc_id": "left_id", "probability": "a"}), "left_id").join(p.withColumnsRenamed({"doc_id": "right_id", "probability": "b"}), "right_id")
    distance = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return both.select("left_id", "right_id", distance.alias("distance"), (distance < threshold).alias("accepted"))


def topic_model(counts: DataFrame, k: int, seed: int = 0, top: int = 10) -> tuple[DataFrame, list[list[int]], float]:
    """(``doc_id, loadings``, the top features of each topic, perplexity) by latent Dirichlet allocation."""
    from pyspark.ml.clustering import LDA

    data = _vectors(counts)
    model = LDA(k=k, seed=seed, maxIter=20, featuresCol="__v", topicDistributionCol="__t").fit(data)
    return model.transform(data).select("doc_id", vector_to_array("__t").alias("loadings")), [r["termIndices"] for r in model.describeTopics(top).orderBy("topic").collect()], float(model.logPerplexity(data))


# --- variance analysis


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


@dataclass(frozen=True)
class AnovaRow:
    factor: str
    sum_squares: float
    df: int
    f: float | None
    p: float | None


def two_way_anova(rows: DataFrame, value: str = "value", author: str = "author", topic: str = "topic") -> list[AnovaRow]:
    """Type II tests of two factors and their interaction from the cells' counts, sums and squares."""
    cells = rows.where(F.col(value).isNotNull()).groupBy(author, topic).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).collect()
    a_of, t_of = {x: i for i, x in enumerate(sorted({r[author] for r in cells}))}, {x: i for i, x in enumerate(sorted({r[topic] for r in cells}))}
    n, s, q = (np.array([float(r[c]) for r in cells]) for c in ("n", "s", "q"))
    one = np.ones((len(cells), 1))
    coded = lambda col, size: np.eye(size)[[col[i] for i in range(len(cells))]][:, 1:]
    a, t = coded([a_of[r[author]] for r in cells], len(a_of)), coded([t_of[r[topic]] for r in cells], len(t_of))

    def residual(*parts: np.ndarray) -> tuple[float, int]:
        x = np.hstack([one, *parts])
        w = np.sqrt(n)[:, None]
        beta, _, rank, _ = np.linalg.lstsq(x * w, s / np.sqrt(n), rcond=None)
        return float(q.sum() - 2 * (x @ beta) @ s + n @ (x @ beta) ** 2), int(rank)

    within, cells_rank = float((q - s * s / n).sum()), len(cells)
    (both, r_both), (only_a, r_a), (only_t, r_t) = residual(a, t), residual(a), residual(t)
    df = int(n.sum()) - cells_rank
    out = []
    for name, ss, k in (("author", only_t - both, r_both - r_t), ("topic", only_a - both, r_both - r_a), ("interaction", both - within, cells_rank - r_both)):
        f = ss / k / (within / df) if k > 0 and df > 0 and within > 0 else None
        p = None if f is None else incomplete_beta(df / 2, k / 2, df / (df + k * f))
        out.append(AnovaRow(name, max(0.0, ss), k, f, p))
    return [*out, AnovaRow("residual", within, df, None, None)]
