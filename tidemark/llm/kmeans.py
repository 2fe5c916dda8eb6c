"""Operator 12: centroid clustering by sort-means.

Vectors become integers, floor(scale * x). Each round orders, for every centroid, all others by
their distance from it. A vector scans that list of the centroid it was assigned to in the round
before, nearest first, and stops at the first centroid that lies strictly beyond twice the vector's
distance from its own: no later one can be as near (triangle inequality; compared as
integers, D^2 > 4 d^2, so ties aren't lost). In a batch the rows of one centroid are sorted by their own
distance, so those that still scan are a prefix, and each step is one matrix product.

Each round writes the vectors with their assignment to the shared folder once (a small integer
type: less than the input) and reads them back for the sums by cluster and for the next round. Sums are
aggregated before the shuffle, so k rows a task move whatever a cluster's size; k * dim numbers
(at most MODEL) go through the driver and to each task, and nothing else.

Arithmetic is exact: in float64 as long as all sums stay below 2^53, else in Python integers; sums by
cluster turn to decimals where longs might not hold them. Distances and inertias beyond a long
count as its largest value.

Defined cases: vectors of other lengths, null vectors, and ones with null or non-finite components
take no part; components beyond a long count as the nearest long; repeated rows count as
often as they stand; a null id hashes like an empty one and its vector takes part; equal hashes are ordered by vector; fewer
vectors than k give as many centroids; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

K, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: components of all centroids together, at most
MODEL = 1 << 22
LARGEST = (1 << 63) - 1


@dataclass
class Plan:
    """What a round needs of its centroids: them, and for each the others' order and squared distances."""

    centroids: list[list[int]]

    def __post_init__(self) -> None:
        self.limit = math.isqrt((1 << 51) // len(self.centroids[0]))  # products of so large components, summed, stay below 2^53
        self.small = all(abs(x) < self.limit for c in self.centroids for x in c)
        self.c = np.array(self.centroids, dtype=np.float64 if self.small else object)
        k = len(self.c)
        self.apart = np.array([[((self.c[i] - self.c[j]) ** 2).sum() for j in range(k)] for i in range(k)], dtype=self.c.dtype).reshape(k, k)
        self.order = [sorted((j for j in range(k) if j != i), key=lambda j, i=i: (self.apart[i, j], j)) for i in range(k)]

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, distances computed) of integer rows, from the clusters assigned before."""
        exact = self.small and (not len(x) or max(int(x.max()), -int(x.min())) < self.limit)
        x = x.astype(np.float64 if exact else object)
        c = self.c if exact else np.array(self.centroids, dtype=object)
        x2, c2 = (x * x).sum(axis=1), (c * c).sum(axis=1)
        apart = lambda rows, norms, j: norms - 2 * (rows @ c[j]) + c2[j]
        cluster, found, computed = before.copy(), np.zeros(len(x), x.dtype), 0
        for own in np.unique(before):
            at = np.flatnonzero(before == own)
            d = apart(x[at], x2[at], own)
            down = np.argsort(-d, kind="stable")  # the farthest scan longest
            at, d = at[down], d[down]
            rows, norms, best, chosen, live = x[at], x2[at], d.copy(), np.full(len(at), own), len(at)
            computed += len(at)
            for j in self.order[own]:
                far = self.apart[own, j] > 4 * d[:live]
                live -= int(np.count_nonzero(far))  # d falls along the rows, so these are the last of them
                if not live:
                    break
                computed += live
                e = apart(rows[:live], norms[:live], j)
                nearer = (e < best[:live]) | ((e == best[:live]) & (j < chosen[:live]))
                best[:live][nearer], chosen[:live][nearer] = e[nearer], j
            cluster[at], found[at] = chosen, best
        if not exact:
            found = np.array([min(int(d), LARGEST) for d in found], dtype=np.int64)
        return cluster, found.astype(np.int64), computed


def quantized(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.isnan(e))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).where(sound)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors of the smallest hashes of seed and id: only k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[int(x) for x in r["v"]] for r in vectors.withColumn("_key", key).orderBy("_key", "v").limit(k).collect()]


def _assigned(vectors: DataFrame, centroids: list[list[int]], schema: str) -> DataFrame:
    """vectors(vec_id, v, cluster) with cluster and distance under these centroids."""
    plan = Plan(centroids)
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            cluster, distance, _ = plan.assign(x, b.column("cluster").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), v, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, schema)


def _means(rows: DataFrame, centroids: list[list[int]], wide: bool) -> list[list[int]]:
    """The floors of the clusters' means; a cluster without rows keeps its centroid."""
    at = lambda i: F.get("v", F.lit(i)).cast("decimal(20,0)") if wide else F.get("v", F.lit(i))
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(at(i)).alias(f"s{i}") for i in range(len(centroids[0]))))
    new = list(centroids)
    for r in sums.collect():  # one row a cluster
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(len(centroids[0]))]
    return new


def sort_means(
    embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, distance) of each vector that takes part, and the final centroids."""
    if k < 1 or k * dim > MODEL:
        raise ValueError(f"k * dim must lie between dim and {MODEL}")
    spark = embeddings.sparkSession
    ship(spark)
    keep = Scratch(spark)
    vectors = quantized(embeddings, dim, scale)
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, v array<bigint>, cluster int, distance bigint"
    centroids = first_centroids(vectors, k, seed)
    rows, wide = vectors.withColumn("cluster", F.lit(0)), None
    if not centroids:
        return rows.withColumn("distance", F.lit(0).cast("long")), []
    for i in range(rounds):
        rows = keep(_assigned(rows, centroids, schema), f"round{i}")
        if wide is None:
            n, top, low = rows.agg(F.count("*"), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
            wide = n * max(top, -low) > LARGEST
        centroids = _means(rows, centroids, wide)
        keep.drop(f"round{i - 1}")
    out = keep(_assigned(rows, centroids, schema), "assigned")
    keep.drop(f"round{rounds - 1}")
    return out, centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the hash of the cluster's centroid: one row a cluster is broadcast."""
    by = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    held = {r["cluster"]: int(r["s"]) for r in by.collect()}
    total = sum(held.values())
    rows = [(c, min(s, LARGEST), min(total, LARGEST), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in held.items()]
    table = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(rounds: int = ROUNDS) -> str:
    """The same clustering in SQL, by comparing every vector with every centroid."""
    parts = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS k, v AS c FROM v QUALIFY k < {K})"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT r, vec_id, v, k, CAST(list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM v, c{i}),
a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range({DIM})) AS i FROM a{i}) GROUP BY 1, 2),
m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY 1),
c{i + 1} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, a{rounds}.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)
"""
