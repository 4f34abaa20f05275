"""Models that ``pyspark.ml`` lacks: non-negative factors, one-class verification, exact attributions of linear models, maps for the eye.

What is fitted on all rows is fitted by sums over them, one job a step: a partition adds up its own rows in Arrow batches and gives one row.
What needs all pairs of rows (kernels, maps) is fitted on a sample chosen by hash, whose size is a parameter; every row is then scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(lists: pa.Array) -> np.ndarray:
    """A batch of vectors as a matrix; nulls among components become NaN. ``ValueError`` where lengths differ."""
    sizes = lists.value_lengths()
    if sizes.null_count or len(sizes.unique()) > 1:
        raise ValueError("vectors of unlike length")
    return np.array(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(len(lists), sizes[0].as_py() if len(lists) else 0)


def _sums(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``part`` of each batch of vectors, summed over all rows: ``size`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(0, batch.num_rows, 1_024):
                total += part(_vectors(batch.column(0).slice(i, 1_024))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "s"])

    got = rows.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["i"]] = r["s"]
    return out


def gram(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sums of products of the components)."""
    first = rows.select(F.size("features")).first()
    size = first[0] if first else 0
    got = _sums(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]), 1 + size + size * size)
    n = int(got[0])
    return n, got[1:1 + size] / max(1, n), got[1 + size:].reshape(size, size)


# --- non-negative factors


def _loadings(x: np.ndarray, h: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative loadings of rows on fixed factors, by multiplicative steps from an even start."""
    w = np.full((len(x), len(h)), 1.0) * np.maximum(x.sum(axis=1, keepdims=True), 1e-12) / max(1e-12, h.sum())
    a, b = x @ h.T, h @ h.T
    for _ in range(steps):
        w *= a / np.maximum(w @ b, 1e-12)
    return w


def nmf(rows: DataFrame, k: int, rounds: int = 30, steps: int = 30, seed: int = 0, top: int = 10) -> tuple[DataFrame, list[list[int]], float]:
    """(``doc_id, loadings``, the top features of each topic, the squared error) of a factorization of non-negative vectors.

    In each round every row fits its loadings to the factors, and the factors are stepped by sums over the rows, as many numbers as there
    are topics times features. A topic's features go by weight, ties by place.
    """
    if k < 1:
        raise ValueError("at least one topic")
    # every round reads it; what is lost is made again. Kept before the check: a filter over the plan would be moved below the vectors, and each component would be made of the text anew
    rows = rows.select("doc_id", F.col("features").cast("array<double>").alias("features")).persist()
    first = rows.select(F.size("features")).first()
    if not first:
        raise ValueError("no rows")
    if rows.where(F.exists("features", lambda v: v.isNull() | F.isnan(v) | (v < 0))).limit(1).count():
        raise ValueError("components of at least 0")
    size = first[0]
    mean = _sums(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), size + 1)
    h = np.random.default_rng(seed).random((k, size)) + 0.1
    h *= np.maximum(mean[1:] / max(1.0, mean[0]), 1e-9)
    for _ in range(rounds):
        def part(x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
            w = _loadings(x, h, steps)
            return np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel()])
        got = _sums(rows, part, k * size + k * k)
        a, b = got[:k * size].reshape(k, size), got[k * size:].reshape(k, k)
        for _ in range(steps):
            h = h * a / np.maximum(b @ h, 1e-12)
    error = float(_sums(rows, lambda x: np.array([((x - _loadings(x, h, steps) @ h) ** 2).sum()]), 1)[0])
    kind = rows.schema["doc_id"].dataType.simpleString()

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_loadings(x, h, steps)), pa.list_(pa.float64()))], ["doc_id", "loadings"])

    out = rows.select("doc_id", F.col("features").cast("array<double>")).mapInArrow(loaded, f"doc_id {kind}, loadings array<double>")
    return out, [np.argsort(-row, kind="stable")[:top].tolist() for row in h], error


# --- samples


def sample(rows: DataFrame, most: int, seed: int = 0, id_col: str = "doc_id") -> tuple[list, np.ndarray]:
    """(ids, vectors) of at most ``most`` rows, chosen by a hash of the id."""
    got = rows.select(F.col(id_col).alias("i"), F.col("features").cast("array<double>").alias("v"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h")).orderBy("h", "i").limit(most).collect()
    return [r["i"] for r in got], np.array([r["v"] for r in got], float)


# --- one class


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def fit_one_class(x: np.ndarray, nu: float, gamma: float, rounds: int = 100_000, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, offset) of a support of the data: least ``w' K w / 2`` with weights between 0 and 1 that sum to ``nu n``, two of them moved at a time."""
    n = len(x)
    q, w = _kernel(x, x, gamma), np.zeros(n)
    whole = int(nu * n)
    w[:whole] = 1.0
    if whole < n:
        w[whole] = nu * n - whole
    g = q @ w
    for _ in range(rounds):
        up, down = np.where(w < 1 - 1e-12, g, np.inf), np.where(w > 1e-12, g, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if down[j] - up[i] < tolerance:
            break
        d = min((g[j] - g[i]) / max(1e-12, q[i, i] + q[j, j] - 2 * q[i, j]), 1 - w[i], w[j])
        w[i] += d
        w[j] -= d
        g += d * (q[:, i] - q[:, j])
    free = (w > 1e-9) & (w < 1 - 1e-9)
    offset = float(g[free].mean()) if free.any() else float((g[w > 1e-9].max(initial=-np.inf) + g[w <= 1e-9].min(initial=np.inf)) / 2) if (w <= 1e-9).any() else float(g.max())
    return w, offset


def one_class_scores(train: DataFrame, rows: DataFrame, nu: float = 0.5, most: int = 2_000, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, score``: how far inside the support of ``train`` (a sample of at most ``most`` of its rows) each row lies; 0 or more is inside."""
    if not 0 < nu <= 1:
        raise ValueError("nu above 0, at most 1")
    _, x = sample(train, most, seed, id_col)
    if len(x) < 2:
        raise ValueError("at least two rows to train on")
    spread = float(x.var())
    gamma = 1.0 / (x.shape[1] * spread) if spread > 0 else 1.0
    w, offset = fit_one_class(x, nu, gamma)
    held, weight = x[w > 1e-12], w[w > 1e-12]
    kind = rows.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1_024):
                part = batch.slice(i, 1_024)
                v = np.array(part.column(1).to_pylist(), float).reshape(-1, held.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_kernel(v, held, gamma) @ weight - offset)], ["doc_id", "score"])

    return rows.select(id_col, F.col("features").cast("array<double>")).mapInArrow(scored, f"doc_id {kind}, score double")


def one_class_verification(train: DataFrame, rows: DataFrame, pairs: DataFrame, nu: float = 0.5, most: int = 2_000, seed: int = 0) -> DataFrame:
    """``left_id, right_id, left_score, right_score, accepted``: a pair is accepted if both lie inside the support of ``train``."""
    scores = one_class_scores(train, rows, nu, most, seed)
    side = lambda s: scores.select(F.col("doc_id").alias(f"{s}_id"), F.col("score").alias(f"{s}_score"))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return both.select("left_id", "right_id", "left_score", "right_score", ((F.col("left_score") >= 0) & (F.col("right_score") >= 0)).alias("accepted"))


# --- attributions


def linear_attributions(rows: DataFrame, weights: Sequence[float]) -> tuple[DataFrame, list[float]]:
    """(``doc_id, attributions``, mean absolute attribution of each feature) of a linear model: a feature's weight times its distance from the mean
    of all rows. For a linear model with independent features these are its Shapley values."""
    n, means, _ = gram(rows)
    if len(weights) != len(means):
        raise ValueError("a weight for each feature")
    w, m = (F.array(*[F.lit(float(x)) for x in v]) for v in (weights, means))
    out = rows.select("doc_id", F.zip_with(F.zip_with("features", m, lambda x, c: x - c), w, lambda x, c: x * c).alias("attributions"))
    each = out.select(F.posexplode("attributions").alias("i", "x")).groupBy("i").agg(F.avg(F.abs("x")).alias("a")).orderBy("i").collect()
    return out, [r["a"] for r in each]


def shap_attributions(*_: object) -> None:
    """Values of models that aren't linear need a library that isn't part of this one."""
    try:
        import shap  # noqa: F401
    except ImportError:
        raise ImportError("attributions of models that are not linear need the package shap; linear_attributions needs none") from None
    raise NotImplementedError("use the package's explainers on the rows of sample()")


# --- maps


def _neighbour_weights(x: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric probabilities of pairs; each row's width is set so that its entropy is that of ``perplexity`` neighbours."""
    square = np.maximum(0.0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T)
    np.fill_diagonal(square, np.inf)
    low, high, beta = np.zeros(len(x)), np.full(len(x), np.inf), np.ones(len(x))
    for _ in range(60):
        p = np.exp(-beta[:, None] * (square - square.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return (p + p.T) / (2 * len(x))


def tsne_map(rows: DataFrame, k: int = 2, perplexity: float = 30.0, most: int = 1_000, rounds: int = 500, seed: int = 0) -> DataFrame:
    """``doc_id, position`` of at most ``most`` rows: t-distributed neighbour embedding. A map shows a sample; rows that aren't in it have no place."""
    ids, x = sample(rows, most, seed)
    if not 0 < perplexity < max(1, len(x)):
        raise ValueError("a perplexity above 0 and below the number of rows")
    p = np.maximum(_neighbour_weights(x, perplexity), 1e-12)
    y = np.random.default_rng(seed).standard_normal((len(x), k)) * 1e-4
    speed, gain = np.zeros_like(y), np.ones_like(y)
    rate = max(50.0, len(x) / 48)
    for step in range(rounds):
        near = 1 / (1 + np.maximum(0.0, (y * y).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * y @ y.T))
        np.fill_diagonal(near, 0.0)
        push = ((12.0 if step < rounds // 4 else 1.0) * p - np.maximum(near / near.sum(), 1e-12)) * near
        slope = 4 * (push.sum(axis=1)[:, None] * y - push @ y)
        gain = np.maximum(0.01, np.where(np.sign(slope) != np.sign(speed), gain + 0.2, gain * 0.8))
        speed = (0.5 if step < rounds // 4 else 0.8) * speed - rate * gain * slope
        y = y + speed
        y -= y.mean(axis=0)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(i, v.tolist()) for i, v in zip(ids, y, strict=True)], f"doc_id {kind}, position array<double>")


def umap_map(rows: DataFrame, k: int = 2, most: int = 10_000, seed: int = 0) -> DataFrame:
    """The same by the package umap; ``ImportError`` where it isn't there."""
    try:
        import umap
    except ImportError:
        raise ImportError("this map needs the package umap-learn; tsne_map needs none") from None
    ids, x = sample(rows, most, seed)
    y = umap.UMAP(n_components=k, random_state=seed).fit_transform(x)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, y, strict=True)], f"doc_id {kind}, position array<double>")


# --- report


def style_report(rows: DataFrame, families: dict[str, DataFrame], scorer: Callable[[DataFrame], float], lengths: DataFrame, values: DataFrame, folds: int = 5) -> dict:
    """One dictionary of what a study of style should state: how well vectors tell topics (``rows``), how well each family of features does alone,
    how strongly each feature follows length (long ``values`` and ``lengths``), and whether the split has enough topics and rows."""
    from penprint.operators.evaluation import ablation, length_sensitivity, split_diagnostics
    from penprint.operators.models import topic_leakage

    split = split_diagnostics(rows).first().asDict()
    return {
        "topic_leakage": topic_leakage(rows, folds) if split["n_topics"] > 1 else None, "ablation": ablation(families, scorer),
        "length_sensitivity": {r["feature"]: r["sensitivity"] for r in length_sensitivity(values, lengths).orderBy("feature").collect()}, "split": split,
    }
