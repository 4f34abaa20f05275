"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Trees are fitted on a bounded sample: a node projects on a random direction and splits at the sample's median; vectors
near the median go to both sides. Every vector is then sent down every tree. Vectors that meet in a leaf, with equal
labels, are compared by cosine in double precision, large leaves in pairs of blocks; a pair counts in the first leaf that
it shares, so no pair is counted twice. Each comparison of blocks returns its vectors' numbers of links and a forest of edges, fewer
than it has vectors, never all pairs: a group of n vectors near each other gives about n rows for each block that it fills.
The sums of those numbers are degrees, connected components of the edges are groups.

With the defaults (8 trees, spill of half the standard deviation of a projected gap at the threshold) a pair at cosine
0.98 is parted by one tree in about 1.3 % of its nodes, and by all 8 practically never.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component, or whose label or id is null,
links with nothing (``n_links`` 0, its own component, kept). Vectors of different lengths never link. Equal vectors of
equal label are one vector with a count; each of the repeated rows counts the others as links. Rows of one id with
different vectors count as one node. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, dropped, kept

THRESHOLD, TREES, LEAF, BLOCK, SAMPLE = 0.98, 8, 256, 512, 20_000


class Tree:
    """Splits of one random-projection tree over unit vectors."""

    def __init__(self, sample: np.ndarray, depth: int, spill: float, seed: int, least: int = 16):
        rng = np.random.default_rng(seed)
        self.spill = spill
        self.nodes: list[tuple[np.ndarray, float, int, int] | None] = []
        self._grow(sample, depth, rng, least)

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator, least: int) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if depth > 0 and len(x) >= least:
            g = rng.standard_normal(x.shape[1])
            g /= np.linalg.norm(g)
            p = x @ g
            cut = float(np.median(p))
            left = self._grow(x[p <= cut + self.spill], depth - 1, rng, least)
            right = self._grow(x[p > cut - self.spill], depth - 1, rng, least)
            self.nodes[me] = (g, cut, left, right)
        return me

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """The leaves that each row of ``x`` reaches."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            if not len(rows):
                continue
            node = self.nodes[at]
            if node is None:
                for i in rows.tolist():
                    out[i].append(at)
                continue
            g, cut, left, right = node
            p = x[rows] @ g
            stack.append((left, rows[p <= cut + self.spill]))
            stack.append((right, rows[p > cut - self.spill]))
        return out


def unit(rows: list) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid(embedding: Column) -> Column:
    """Whether a vector can link: components all there and finite, one of them not zero."""
    inf = F.lit(float("inf"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def _assigned(batches: Iterator[pa.RecordBatch], trees: list[Tree], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("v").to_pylist()
        codes: list[list[int]] = [[0] for _ in rows]
        mine = [i for i, v in enumerate(rows) if len(v) == size]
        if mine and trees:
            found = [[] for _ in mine]
            x = unit([rows[i] for i in mine])
            for t, tree in enumerate(trees):
                for own, at in zip(found, tree.leaves(x), strict=True):
                    own.extend((t << 32) + a for a in at)
            for i, own in zip(mine, found, strict=True):
                codes[i] = sorted(own)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "label", "v", "size")), pa.array(codes, pa.list_(pa.int64()))], ["rep", "n", "label", "v", "size", "codes"])


def _compared(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """From the links among the rows of two blocks of a leaf (or of one with itself): a row ``src, far`` for each vector with
    the number of vectors it links with here, and rows ``src, dst`` of edges that connect what the links connect."""
    code, low, high = (group.column(c)[0].as_py() for c in ("code", "low", "high"))
    reps, block, n = (group.column(c).to_numpy() for c in ("rep", "block", "n"))
    codes = group.column("codes").to_pylist()
    x = unit(group.column("v").to_pylist())
    one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
    linked = (x[one] @ x[two].T >= threshold) & (reps[one][:, None] != reps[two][None, :])
    a, b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    linked, one, two = linked[np.ix_(a, b)], one[a], two[b]
    # pairs that share a leaf of lower number are counted there
    lower = sorted({c for i in one.tolist() for c in codes[i] if c < code} & {c for i in two.tolist() for c in codes[i] if c < code})
    at = {c: i for i, c in enumerate(lower)}
    for first in range(0, len(lower), 2_048):
        last = min(first + 2_048, len(lower))
        held = [np.zeros((len(rows), last - first), np.float32) for rows in (one, two)]
        for rows, h in zip((one, two), held, strict=True):
            for k, i in enumerate(rows.tolist()):
                h[k, [at[c] - first for c in codes[i] if c in at and first <= at[c] < last]] = 1
        linked &= held[0] @ held[1].T == 0
    far: dict[int, int] = {}
    for rows, others, weight in [(one, linked, n[two]), (two, linked.T, n[one])][:1 if low == high else 2]:
        for rep, total in zip(reps[rows].tolist(), (others @ weight).tolist(), strict=True):
            if total:
                far[rep] = far.get(rep, 0) + total
    # a forest of the links: from row to row over columns not met before
    src, dst = [], []
    new_one, new_two = np.ones(len(one), bool), np.ones(len(two), bool)
    for start in range(len(one)):
        stack = [(0, start)] if new_one[start] else []
        new_one[start] = False
        while stack:
            side, i = stack.pop()
            fresh = np.flatnonzero(linked[i] & new_two) if side == 0 else np.flatnonzero(linked[:, i] & new_one)
            (new_two if side == 0 else new_one)[fresh] = False
            here = reps[one[i] if side == 0 else two[i]]
            there = reps[two[fresh] if side == 0 else one[fresh]]
            src += [int(here)] * len(fresh)
            dst += there.tolist()
            stack += [(1 - side, j) for j in fresh.tolist()]
    k = len(src)
    yield pa.RecordBatch.from_arrays([pa.array(src + list(far), pa.int64()), pa.array(dst + [None] * len(far), pa.int64()), pa.array([None] * k + list(far.values()), pa.int64())], ["src", "dst", "far"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = valid(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    digest = F.unhex(F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    known, known_path = kept(rows.select("vec_id", F.when(ok, digest).alias("digest")))
    classes, classes_path = kept(rows.where(ok).withColumn("digest", digest).groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("size", F.size("v")))
    stats = classes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    forest: list[Tree] = []
    size = stats["size"] if stats else 0
    if stats:
        largest = classes.where(F.col("size") == size).groupBy("label").count().agg(F.max("count")).first()[0]
        depth = max(0, math.ceil(math.log2(largest / leaf)))
        if depth:
            # a fixed number of vectors, chosen by hash, fits the splits; all vectors are indexed
            some = classes.where(F.col("size") == size).orderBy(F.xxhash64(F.lit(seed), "rep"), "rep").limit(sample).select("v").collect()
            x = unit([r["v"] for r in some])
            gap = math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(size)
            forest = [Tree(x, depth, gap / 2, seed * 1_000 + t) for t in range(trees)]
    label_kind = classes.schema["label"].dataType.simpleString()
    leaves = classes.select("rep", "n", "label", "v", "size").mapInArrow(lambda b: _assigned(b, forest, size), f"rep long, n long, label {label_kind}, v array<double>, size int, codes array<long>")
    leaves, leaves_path = kept(leaves)
    key = ["label", "size", "code"]
    spread = leaves.select("rep", "label", "size", F.explode("codes").alias("code"))
    # only leaves with company
    counts, counts_path = kept(spread.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("c")).where("c > 1").drop("c"))
    placed = leaves.withColumn("code", F.explode("codes")).join(counts, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(*key, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "n", "v", "codes")
    found, links_path = kept(by_group(placed, [*key, "low", "high"], lambda t: _compared(t, threshold), "src long, dst long, far long"))
    links = found.where("dst is not null").select("src", "dst")
    nodes, nodes_path = kept(classes.groupBy("rep").agg(F.sum("n").alias("n")))
    degrees, degrees_path = kept(found.where("far is not null").groupBy("src").agg(F.sum("far").alias("far")))
    comp = components(links)
    per = nodes.join(degrees.withColumnRenamed("src", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per = classes.select("digest", "rep").join(per, "rep").select("digest", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    per, per_path = kept(per)
    out = known.join(per, "digest", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out, _ = kept(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
    dropped(spark, known_path, classes_path, leaves_path, counts_path, links_path, nodes_path, degrees_path, per_path)
    return out
