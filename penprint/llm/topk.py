"""Exact top-k search by inner product with M-trees, best first.

Vectors become integers, and one component more makes their inner product a distance: with ``x' = (x, sqrt(M^2 - |x|^2))``
and ``q' = (q, 0)`` the nearest ``x'`` to ``q'`` has the largest ``q.x``. Each page of vectors is a tree of metric nodes
with covering radii; every entry stores its distance to the parent's routing object. The search takes the node of least
possible distance first, and skips entries whose stored distances already put them, by the triangle inequality, behind
the k-th best so far, without computing theirs. Bounds carry a slack for rounding; scores are exact integers.

The stated queries go against all pages in blocks; each block meets each page in a task of its own, and the best k of
all pages are ranked at the end.

Defined cases: vectors that are null or hold null or non-finite components, or with a null id, take no part; vectors of
different lengths don't meet; rows that repeat count once; rows of a query's own id aren't its candidates; ties go to
the smaller id; a query with fewer candidates than k gets all; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, kept

PAGE, QUERIES, NODE, FANOUT = 16_384, 8_192, 512, 16


class MTree:
    """An M-tree over integer vectors for largest inner products."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, node: int = NODE, fanout: int = FANOUT, seed: int = 1):
        self.x, self.ids, self.node, self.fanout = x.astype(np.float64), ids, node, fanout
        self.exact = x
        square = (self.x * self.x).sum(axis=1)
        self.reach = float(square.max(initial=0.0))
        self.y = np.hstack([self.x, np.sqrt(np.maximum(0.0, self.reach - square))[:, None]])
        self.most = float(np.abs(self.x).max(initial=0.0))
        self.rng = np.random.default_rng(seed)
        self.computed = 0
        # inner: (children's node numbers, their routing objects, radii, distances to this node's); leaf: (rows, distances)
        self.nodes: list[tuple] = []
        self.top = self._build(np.arange(len(x)), 0, self._far(np.arange(len(x)), 0)) if len(x) else -1

    def _far(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((self.y[rows] - self.y[pivot]) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, pivot: int, dist: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= self.node:
            self.nodes[me] = (None, rows, dist)
            return me
        # routing objects far from each other
        chosen, near = [int(rows[self.rng.integers(len(rows))])], None
        owner = np.zeros(len(rows), np.int64)
        near = self._far(rows, chosen[0])
        while len(chosen) < self.fanout and near.max() > 0:
            chosen.append(int(rows[int(near.argmax())]))
            d = self._far(rows, chosen[-1])
            closer = d < near
            owner[closer], near = len(chosen) - 1, np.minimum(near, d)
        if len(chosen) == 1:  # all alike: pages of equal size
            owner = np.arange(len(rows)) * self.fanout // len(rows)
            chosen = chosen * self.fanout
        kids, routing, radii, up = [], [], [], []
        for c, p in enumerate(chosen):
            mine = np.flatnonzero(owner == c)
            if not len(mine):
                continue
            own = self._far(rows[mine], p)
            kids.append(self._build(rows[mine], p, own))
            routing.append(p)
            radii.append(float(own.max()))
            up.append(float(np.sqrt(((self.y[p] - self.y[pivot]) ** 2).sum())))
        self.nodes[me] = (np.array(kids), np.array(routing), np.array(radii), np.array(up))
        return me

    def search(self, q: np.ndarray, k: int, own: int | None = None) -> list[tuple[int, int]]:
        """``(score, id)`` of the best k, best first."""
        return self.search_all(q[None, :], k, None if own is None else np.array([own]))[0]

    def search_all(self, qs: np.ndarray, k: int, own: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """The same for many queries, each best first on its own; those that ask for one node in the same step share its reading."""
        n = len(qs)
        best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # heaps of (score, -id), worst first
        if self.top >= 0:
            qf = qs.astype(np.float64)
            q1 = np.hstack([qf, np.zeros((n, 1))])
            whole = (qf * qf).sum(axis=1) + self.reach
            slack = 1e-6 * (1.0 + np.sqrt(whole))
            small = self.most * float(np.abs(qf).max(initial=0.0)) * max(1, qf.shape[1]) < 2.0 ** 52
            bound, least = np.full(n, np.inf), np.full(n, -np.inf)
            root = np.sqrt(((self.y[0] - q1) ** 2).sum(axis=1))
            heaps = [[(0.0, self.top, d)] for d in root.tolist()]
            active = list(range(n))
            while active:
                wanted: dict[int, list[tuple[int, float]]] = {}
                for i in active:
                    if heaps[i]:
                        low, at, d_up = heapq.heappop(heaps[i])
                        if low <= bound[i]:
                            wanted.setdefault(at, []).append((i, d_up))
                active = [i for asked in wanted.values() for i, _ in asked]
                for at, asked in wanted.items():
                    who, up = np.array([i for i, _ in asked]), np.array([d for _, d in asked])
                    if self.nodes[at][0] is not None:
                        self._descend(at, who, up, q1, bound, heaps)
                        continue
                    for i in self._compare(at, who, up, qf if small else None, qs, bound, least, own, best, k):
                        if len(best[i]) == k:
                            least[i] = best[i][0][0]
                            bound[i] = max(0.0, whole[i] - 2.0 * best[i][0][0]) ** 0.5 + slack[i]
        return [[(s, -i) for s, i in sorted(b, reverse=True)] for b in best]

    def _descend(self, at: int, who: np.ndarray, up: np.ndarray, q1: np.ndarray, bound: np.ndarray, heaps: list) -> None:
        """Children that may hold something better go on the queries' heaps; stored distances spare the computing of others."""
        kids, routing, radii, parent = self.nodes[at]
        for c in range(len(kids)):
            may = np.flatnonzero(np.abs(up - parent[c]) - radii[c] <= bound[who])
            self.computed += len(may)
            d = np.sqrt(((self.y[routing[c]] - q1[who[may]]) ** 2).sum(axis=1))
            low = np.maximum(0.0, d - radii[c])
            for i, x, y in zip(who[may].tolist(), low.tolist(), d.tolist(), strict=True):
                if x <= bound[i]:
                    heapq.heappush(heaps[i], (x, int(kids[c]), y))

    def _compare(self, at: int, who: np.ndarray, up: np.ndarray, qf: np.ndarray | None, qs: np.ndarray, bound: np.ndarray, least: np.ndarray, own: np.ndarray | None, best: list, k: int) -> list[int]:
        """Scores of a leaf's rows; returns the queries whose best k have changed."""
        _, rows, dist = self.nodes[at]
        near = np.zeros(len(rows), bool)
        for lo in range(0, len(who), 1_024):
            near |= (np.abs(up[lo:lo + 1_024, None] - dist[None, :]) <= bound[who[lo:lo + 1_024], None]).any(axis=0)
        rows = rows[near]
        self.computed += len(rows) * len(who)
        if not len(rows):
            return []
        ids, changed = self.ids[rows], []
        x = self.x[rows]
        for lo in range(0, len(who), 1_024):
            part = who[lo:lo + 1_024]
            scores = qf[part] @ x.T if qf is not None else np.array([[sum(int(a) * int(b) for a, b in zip(self.exact[r], qs[i], strict=True)) for r in rows] for i in part], object)
            mine = ids[None, :] == own[part, None] if own is not None else np.zeros((len(part), len(rows)), bool)
            # only rows that may enter the best k are looked at one by one; equal scores stay in
            for g in np.flatnonzero(((scores >= least[part, None]) & ~mine).any(axis=1)).tolist():
                i = int(part[g])
                cand = np.flatnonzero(~mine[g])
                row = scores[g][cand]
                floor = least[i] if len(row) <= k else max(least[i], np.partition(row, -k)[-k])
                for j in cand[row >= floor].tolist():
                    item = (int(scores[g][j]), -int(ids[j]))
                    if len(best[i]) < k:
                        heapq.heappush(best[i], item)
                    elif item > best[i][0]:
                        heapq.heapreplace(best[i], item)
                changed.append(i)
        return changed


def _table(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = t.column("v").to_pylist()
    return np.array(x, np.int64).reshape(len(x), size), t.column("id").to_numpy()


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, page: int = PAGE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: rows whose id is divisible by ``every`` against all other rows."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    inf = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.col(id_col).isNotNull()
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")).distinct().withColumn("size", F.size("v"))
    rows, rows_path = kept(rows)
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    n, m = rows.count(), queries.count()
    pages, blocks = max(1, -(-n // page)), max(1, -(-m // QUERIES))
    left = rows.withColumn("page", F.pmod(F.xxhash64("id", "v"), F.lit(pages))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))

    def searched(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if own.num_rows and asked.num_rows:
            size = own.column("size")[0].as_py()
            x, ids = _table(own, size)
            tree = MTree(x, ids)
            q, q_ids = _table(asked, size)
            for i, found_here in zip(q_ids.tolist(), tree.search_all(q, k, q_ids), strict=True):
                out.extend((i, other, score) for score, other in found_here)
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({c: pa.array(list(x), pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    key = ["page", "block", "size"]
    found = left.select(*key, "id", "v").groupBy(*key).cogroup(right.select(*key, "id", "v").groupBy(*key)).applyInArrow(searched, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out, _ = kept(found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    dropped(spark, rows_path)
    return out
