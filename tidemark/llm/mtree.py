"""Operator 6: exact top-k inner products by best-first search in M-trees.

The metric. With M the largest norm in a tree, a vector x gets one more component,
sqrt(M^2 - |x|^2), and a query q gets 0 there. Then d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the
nearest vectors are those of the largest inner product, and d obeys the triangle inequality.

The tree. Rows are dealt by hash into shards of SHARD components (65,536 rows of 64), each a tree of paged nodes: a
node has a pivot, a covering radius and the distance to its parent's pivot; a leaf's page of up
to PAGE vectors keeps each one's distance to the pivot. The search opens nodes in the order of
their lower bounds d(q, pivot) - radius and stops at the first above the k-th best distance. Where
|d(q, parent) - parent distance| - radius is already above it, d isn't computed at all.

Scores are integers and exact; bounds are compared with a margin far above rounding errors, so
ties at the k-th score aren't lost. Queries go in blocks of QUERIES components to every shard; each pair of
a block and a shard gives k rows a query, merged in the end. Neither side is broadcast. A vector is
moved once for each block and a query once for each shard, so that a pair of N rows and M queries costs
1/shard + 1/block vectors moved; both are as large as a task's memory allows, whatever the dimension.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without
id, take no part; repeated rows are candidates as often as they stand; where rows share an id,
all are candidates of other ids and the smallest vector is the query; vectors of other lengths than the
query's aren't its candidates; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: components of the vectors in a shard and in a block of queries at most.
SHARD = 1 << 22
QUERIES = 1 << 20
#: components a shard should hold where the table is too small to give every core a full one.
LEAST = 1 << 17
PAGE = 1024
FANOUT = 8


@dataclass
class Node:
    pivot: int
    radius: float
    to_parent: float
    children: list[Node] = field(default_factory=list)
    page: np.ndarray | None = None  # a leaf's vectors, side by side in memory
    ids: np.ndarray | None = None
    to_pivot: np.ndarray | None = None
    pivots: np.ndarray | None = None  # the children's, as vectors
    radii: np.ndarray | None = None
    parents: np.ndarray | None = None


class MTree:
    """Bulk-loaded M-tree over the rows of an integer matrix (held as float64, exact below 2^53)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.norm2 = (x * x).sum(axis=1)
        self.top = float(self.norm2.max()) if len(x) else 0.0
        self.lift = np.sqrt(np.maximum(self.top - self.norm2, 0.0))
        self.rng = np.random.default_rng(5)
        self.computed = 0  # distances and scores computed by searches
        self.root = self._build(np.arange(len(x)), int(self.norm2.argmin()), 0.0) if len(x) else None
        self.top_pivot = x[self.root.pivot] if self.root else None
        del self.x  # the pages hold it

    def _distances(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        d = self.norm2[rows] + self.norm2[pivot] - 2 * (self.x[rows] @ self.x[pivot]) + (self.lift[rows] - self.lift[pivot]) ** 2
        return np.sqrt(np.maximum(d, 0.0))

    def _build(self, rows: np.ndarray, pivot: int, to_parent: float) -> Node:
        d = self._distances(rows, pivot)
        node = Node(pivot, float(d.max()), to_parent)
        if len(rows) <= PAGE:
            node.page, node.ids, node.to_pivot = self.x[rows], self.ids[rows], d
            return node
        # pivots far from one another; then each row to its nearest
        picked = [int(rows[d.argmax()])]
        near = self._distances(rows, picked[0])
        owner = np.zeros(len(rows), np.int64)
        while len(picked) < FANOUT and near.max() > 0:
            picked.append(int(rows[near.argmax()]))
            e = self._distances(rows, picked[-1])
            owner[e < near] = len(picked) - 1
            near = np.minimum(near, e)
        if len(picked) == 1:  # all alike: pages of equal rows
            owner = np.arange(len(rows)) * FANOUT // len(rows)
            picked = [int(rows[owner == i][0]) for i in range(FANOUT)]
        for i, p in enumerate(picked):
            mine = rows[owner == i]
            if len(mine):
                node.children.append(self._build(mine, p, float(self._distances(np.array([p]), pivot)[0])))
        node.pivots = self.x[[c.pivot for c in node.children]]
        node.radii = np.array([c.radius for c in node.children])
        node.parents = np.array([c.to_parent for c in node.children])
        return node

    def search(self, q: np.ndarray, k: int, own: int) -> list[tuple[float, int]]:
        """The k best (score, id) of rows whose id isn't own."""
        if self.root is None:
            return []
        base = float(q @ q) + self.top
        slack = 1e-6 * (1.0 + base**0.5)
        best_s, best_i, tau = np.zeros(0), np.zeros(0, self.ids.dtype), np.inf
        d0 = max(base - 2 * float(self.top_pivot @ q), 0.0) ** 0.5
        heap = [(max(0.0, d0 - self.root.radius), 0, d0, self.root)]
        pushed = 1
        self.computed += 1
        while heap:
            bound, _, d, node = heapq.heappop(heap)
            if bound > tau + slack:
                break
            if node.page is not None:
                page, ids = node.page, node.ids
                if tau < np.inf:
                    near = np.abs(d - node.to_pivot) <= tau + slack
                    n = np.count_nonzero(near)
                    if not n:
                        continue
                    if 2 * n < len(ids):  # picking rows copies them, so a page of which most are near is taken whole
                        page, ids = page[near], ids[near]
                self.computed += len(ids)
                s = page @ q
                keep = ids != own
                if len(best_s) == k:
                    keep &= s >= best_s[-1]
                    if not keep.any():
                        continue
                s, ids = np.concatenate([best_s, s[keep]]), np.concatenate([best_i, ids[keep]])
                order = np.lexsort((ids, -s))[:k]
                best_s, best_i = s[order], ids[order]
                if len(best_s) == k:
                    tau = max(base - 2 * float(best_s[-1]), 0.0) ** 0.5
                continue
            live = np.flatnonzero(np.abs(d - node.parents) - node.radii <= tau + slack)
            if len(live):
                self.computed += len(live)
                e = np.sqrt(np.maximum(base - 2 * (node.pivots[live] @ q), 0.0))
                lower = np.maximum(0.0, e - node.radii[live])
                for j in np.flatnonzero(lower <= tau + slack):
                    heapq.heappush(heap, (float(lower[j]), pushed, float(e[j]), node.children[live[j]]))
                    pushed += 1
        return list(zip(best_s, best_i, strict=True))


def quantized(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): integer vectors floor(64 x) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.isnan(e))
    rows = embeddings.where("vec_id is not null and embedding is not null").where(sound)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e * 64)).alias("v"))


def top_k(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = quantized(embeddings)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = embeddings.agg(F.sum(F.size("embedding")), F.sum(F.when(F.col("vec_id") % every == 0, F.size("embedding")))).first()
    n, m = n or 0, m or 0
    shards = max(1, -(-n // SHARD), min(spark.sparkContext.defaultParallelism, n // LEAST))
    blocks = max(1, -(-m // QUERIES))
    deal = lambda seed, into: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(into)).cast("int")
    left = rows.select("vec_id", "v", F.size("v").alias("dim"), deal(1, shards).alias("shard"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select("vec_id", "v", F.size("v").alias("dim"), deal(2, blocks).alias("block"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            tree = MTree(np.stack(data["v"].to_numpy()).astype(np.float64), data["vec_id"].to_numpy())
            for own, q in zip(asked["vec_id"], asked["v"], strict=True):
                out += [(own, i, s) for s, i in tree.search(np.asarray(q, dtype=np.float64), k, own)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
