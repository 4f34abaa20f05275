"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: a logistic model on shares of its characters, words and lines, fitted on a bounded sample of
labelled documents. Its sums by host (``source``) and by path in the host (``lang``) give each site a quality: a host's
mean shrinks toward the mean of all, a path's toward its host's, the stronger the fewer documents it has. The strength
comes from the data: the variance between sites beyond what chance explains. A document's posterior log odds are its
own evidence plus how far its site's prior lies from the mean.

Counts and sums cover all documents; only (host, path) sums are joined back. A hot host is summed map-side.

Defined cases: null texts are empty, and an empty text is judged by its site and the intercept; a null host or path is a
site of its own; labels that are null or lack a document are ignored; repeated labels count each; without labels of both
kinds nothing is rejected (``quality`` null). Texts are read whole. Rows that repeat are judged each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept, lots

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
FEATURES = ("upper", "digit", "mark", "heavy", "pipe", "bang", "mean_word", "repeat_words", "repeat_next", "repeat_lines", "marked_words", "long_words", "log_words")
#: (host, path) sums above this many rows are joined by shuffle.
BROADCAST_SITES = 200_000
_HEAVY = b"#$%&*^~=<>|\\{}[]"
_SPACE, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(text: str) -> list[float]:
    """Shares that tell prose from junk; all finite, also for an empty text."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    data = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
    count = np.bincount(data, minlength=256)
    space, n = _SPACE[data], max(1, len(text))
    edges = np.flatnonzero(space[1:] != space[:-1])
    sizes = edges[1::2] - edges[::2]
    # words that repeat within 200, so that long texts don't differ from short ones
    distinct = sum(len(set(words[i:i + 200])) for i in range(0, len(words), 200))
    mark = int(count[_MARK].sum())
    letters = max(1, n - int(count[_SPACE].sum()) - mark)
    upper = int(count[65:91].sum()) + int(((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)).sum())
    return [
        upper / letters, int(count[48:58].sum()) / n, mark / n, int(count[list(_HEAVY)].sum()) / n, int(count[124]) / w, int(count[33]) / w,
        min(40.0, letters / w), 1 - distinct / w if words else 0.0, sum(map(str.__eq__, words, words[1:])) / w, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        int((_MARK[data[:-1]] & space[1:]).sum()) / w, int((sizes > 24).sum()) / w, math.log1p(min(100, len(words))) / 10,
    ]


@dataclass(frozen=True)
class Evidence:
    """A fitted logistic model: log odds of a document from its features alone."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    intercept: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.scale)
        # squares bound how far one share can go either way
        z = np.clip(z, -8, 8)
        return np.clip(np.hstack([z, z * z]) @ np.array(self.weight) + self.intercept, -30, 30)


def fit_evidence(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> Evidence:
    """Logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    a = np.hstack([z, z * z, np.ones((len(z), 1))])
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * len(z) / 100 + 1e-3)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (p - y) + penalty * beta
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(tuple(mean), tuple(scale), tuple(beta[:-1]), float(beta[-1]))


def _judged(model: Evidence | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            names = batch.schema.names
            x = np.array([features(t or "") for t in batch.column("__text").to_pylist()]).reshape(-1, len(FEATURES))
            if model is None:
                extra = [pa.array(list(x), pa.list_(pa.float64()))]
            else:
                extra = [pa.array(model.log_odds(x), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "__x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Evidence | None:
    """The evidence model from at most ``sample`` labels and as many rows of documents, chosen by hash; None without both kinds."""
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"))
    given = given.withColumn("h", F.xxhash64(F.lit(seed), "i")).orderBy("h", "i", "y").limit(sample).select("i", "y")
    given, path = kept(given)
    text = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("__text"))
    rows = text.join(F.broadcast(given), "i")  # at most ``sample`` rows
    # ids may repeat among the documents, so the bound holds for what comes back as well
    chosen = rows.select("i", "__text", "y").mapInArrow(_judged(None), "i long, __text string, y int, __x array<double>").select("i", "y", "__x", F.xxhash64(F.lit(seed), "i", "y", "__text").alias("h"))
    got = chosen.orderBy("h", "i", "y", "__x").limit(sample).collect() if not given.isEmpty() else []
    dropped(docs.sparkSession, path)
    got.sort(key=lambda r: (r["i"], r["y"], r["__x"]))
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return None
    return fit_evidence(np.array([r["__x"] for r in got]), y)


def _with_evidence(docs: DataFrame, model: Evidence, text_col: str) -> DataFrame:
    """All columns, and ``__x``: the log odds of each row's own text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.withColumn("__text", F.col(text_col).cast("string"))
    return rows.mapInArrow(_judged(model), f"{fields}, __text string, __x double").drop("__text")


def _chance(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def site_priors(evidence: DataFrame) -> DataFrame:
    """``host, path, shift`` from rows of ``host, path, x`` (log odds): what a site adds to a document's log odds.

    Keys are null-safe strings. Two levels of shrinkage; strengths by moments.
    """
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(_chance(F.col("x"))).alias("s"))
    paths, paths_path = kept(paths)
    hosts, hosts_path = kept(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")))

    def strength(rows: DataFrame, n: str, s: str, about: Column) -> float:
        """Documents that the prior is worth: p (1 - p) over the variance between sites that chance leaves unexplained."""
        near = (F.col(s) / F.col(n) - about) ** 2
        r = rows.agg(F.sum(F.col(n) * near).alias("q"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * about * (1 - about)).alias("v")).first()
        if not r["n"]:
            return 1.0
        inner = r["v"] / r["n"]
        between = max(1e-6, (r["q"] - r["k"] * inner) / r["n"])
        return min(1e4, max(2.0, inner / between))

    total = hosts.agg(F.sum("hs"), F.sum("hn")).first()
    mean = min(1 - 1e-6, max(1e-6, (total[0] or 0.5) / (total[1] or 1)))
    k_host = strength(hosts, "hn", "hs", F.lit(mean))
    hosts = hosts.withColumn("h", (F.col("hs") + k_host * mean) / (F.col("hn") + k_host))
    both = paths.join(hosts.select("host", "h"), "host")
    k_path = strength(both, "n", "s", F.col("h"))
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("s") + k_path * F.col("h")) / (F.col("n") + k_path)))
    out, _ = kept(both.select("host", "path", (F.ln(p / (1 - p)) - math.log(mean / (1 - mean))).alias("shift")))
    dropped(evidence.sparkSession, paths_path, hosts_path)
    return out


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit(""))


def _verdicts(docs: DataFrame, labels: DataFrame, cut: float, weight: float, id_col: str, text_col: str, host_col: str, path_col: str, sample: int) -> tuple[DataFrame, dict[str, str]]:
    """The rows under inner names, which no column of ``docs`` can clash with, with ``__e, __s, __q, __a``; and the inner name of each column."""
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*inner.values())
    ident, text, host, path = (inner[c] for c in (id_col, text_col, host_col, path_col))
    labels = labels.select(F.col(id_col).alias(ident), "quality")
    model = fit(rows.select(ident, text), labels, sample, id_col=ident, text_col=text)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.withColumns({"__e": none, "__s": none, "__q": none, "__a": F.lit(True)}), inner
    # the texts are read twice, for the sums by site and for the verdicts, and never shuffled
    sites = _with_evidence(rows.select(_key(host).alias("host"), _key(path).alias("path"), F.col(text).cast("string").alias("__t")), model, "__t").select("host", "path", F.col("__x").alias("x"))
    priors = site_priors(sites).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "shift")
    if priors.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        priors = F.broadcast(priors)
    rows = _with_evidence(rows, model, text).withColumns({"__host": _key(host), "__path": _key(path)}).join(priors, ["__host", "__path"], "left")
    shift = F.coalesce("shift", F.lit(0.0))
    rows = rows.withColumns({"__e": F.col("__x"), "__s": shift, "__q": _chance(F.col("__x") + weight * shift)})
    return rows.withColumn("__a", F.col("__q") >= cut), inner


def judge(docs: DataFrame, labels: DataFrame, cut: float = 0.5, weight: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``evidence`` (the text's own log odds), ``site`` (the prior's shift), ``quality`` (posterior) and ``accepted``.

    ``weight`` is that of the site's shift; ``cut`` the posterior below which a document is rejected. Columns of ``docs`` may have
    any names; one that has a result's name gives way to the result.
    """
    rows, inner = _verdicts(docs, labels, cut, weight, id_col, text_col, host_col, path_col, sample)
    found = {"evidence": "__e", "site": "__s", "quality": "__q", "accepted": "__a"}
    return rows.select(*[F.col(x).alias(c) for c, x in inner.items() if c not in found], *[F.col(x).alias(c) for c, x in found.items()])


def accepted_rows(docs: DataFrame, labels: DataFrame, cut: float = 0.5, weight: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with its columns as they are, whatever their names."""
    rows, inner = _verdicts(docs, labels, cut, weight, id_col, text_col, host_col, path_col, sample)
    return rows.where("__a").select(*[F.col(x).alias(c) for c, x in inner.items()])
