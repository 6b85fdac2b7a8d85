"""Centroid clustering with Ptolemaic pivots, in integers.

For pivots p and s, Ptolemy's inequality bounds the distance of a vector v and a centroid c from both sides:

    |d(v,p) d(c,s) - d(v,s) d(c,p)|  <=  d(v,c) d(p,s)  <=  d(v,p) d(c,s) + d(v,s) d(c,p)

The distances of the vectors to the pivots never change, so they are computed once and stored with the vectors; a round needs only those of
the few centroids.  A centroid whose lower bound, rounded down, exceeds the least upper bound, rounded up, or the best exact distance so far is left out;
the others are checked exactly, those with the least lower bounds first.  Sums are formed inside tasks; a round brings
``clusters * dimension`` integers to the driver, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, ship_code
from .lattice import integers, matrix, whole

DIM, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
# Pivots, and the vectors (first by hash) they are chosen from.
PIVOTS, POOL = 4, 64
# Relative error that a bound of floats stays below, with room.
ROUNDING = 2.0**-46


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, pair by pair."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(pool: np.ndarray, count: int) -> np.ndarray:
    """Far from each other: the pool's first vector farthest from its middle, then always the one farthest from those chosen; distinct."""
    if not len(pool):
        return pool
    away = ((pool - pool.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(away.argmax())]
    least = squared(pool, pool[chosen[0]][None, :])
    while len(chosen) < count and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squared(pool, pool[chosen[-1]][None, :]))
    return pool[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p[None, :]) for p in pivots], axis=1).astype(np.float64)) if len(pivots) else np.empty((len(x), 0))


def bounds(far: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of vectors (by their pivot distances) to centroids, on the safe side of all rounding."""
    low, high = np.zeros((len(far), len(centroids))), np.full((len(far), len(centroids)), np.inf)
    between, of = pivot_distances(pivots, pivots), pivot_distances(centroids, pivots)
    for p in range(len(pivots)):
        for s in range(p + 1, len(pivots)):
            a, b = far[:, p, None] * of[None, :, s], far[:, s, None] * of[None, :, p]
            np.maximum(low, (np.abs(a - b) - ROUNDING * (a + b)) / between[p, s], out=low)
            np.minimum(high, (a + b) / between[p, s], out=high)
    return low**2 * (1 - ROUNDING), high**2 * (1 + ROUNDING)


def assign(x: np.ndarray, far: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number), squared distance, and how many distances were computed."""
    low, high = bounds(far, pivots, centroids)
    limit = high.min(axis=1)
    order = np.argsort(low, axis=1, kind="stable")
    best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(centroids))
    left, checked = np.arange(len(x)), 0
    for turn in range(len(centroids)):
        at = order[left, turn]
        near = low[left, at] <= np.minimum(limit[left], best[left].astype(np.float64) * (1 + ROUNDING))
        left, at = left[near], at[near]  # later ones have larger bounds
        if not len(left):
            break
        d = squared(x[left], centroids[at])
        checked += len(left)
        better = (d < best[left]) | ((d == best[left]) & (at < cluster[left]))
        best[left[better]], cluster[left[better]] = d[better], at[better]
    return cluster, best, checked


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(id, vec, far)``: distances to the pivots as 64-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = pivot_distances(matrix(b.column("vec"), pivots.shape[1]), pivots)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array([r.tobytes() for r in far], pa.binary())], ["id", "vec", "far"])

    return rows.select("id", "vec").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, vec binary, far binary")


def assigned(b: pa.RecordBatch, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    x = matrix(b.column("vec"), centroids.shape[1])
    far = np.frombuffer(b"".join(b.column("far").to_pylist()), dtype=np.float64).reshape(len(x), len(pivots))
    return x, *assign(x, far, pivots, centroids)


def cluster_sums(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> tuple[dict[int, int], dict[int, list[int]], int]:
    """Sizes and component sums of the clusters, and the number of distances computed; summed in every task first."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total, checks = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        for b in batches:
            x, cluster, _, n = assigned(b, pivots, centroids)
            checks += n
            size += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        # position -1 holds the size, -2 of cluster 0 the distances computed
        cells = [(c, -1, int(size[c])) for c in range(k)] + [(c, i, int(total[c, i])) for c in range(k) if size[c] for i in range(dim)] + [(0, -2, checks)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*cells), (pa.int32(), pa.int32(), pa.int64()))], ["cluster", "part", "total"])

    rows = table.mapInArrow(run, "cluster int, part int, total bigint").groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
    found = {(r.cluster, r.part): r.total for r in rows}
    sizes = {c: found.get((c, -1), 0) for c in range(k)}
    return sizes, {c: [found[c, i] for i in range(dim)] for c in range(k) if sizes[c]}, found.get((0, -2), 0)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, pivots: int = PIVOTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(<key>, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` per vector of exactly ``dim`` finite components.

    Components become ``floor(scale * x)``.  Centroids start as the vectors with the smallest sha256 of ``1:<key>`` (of equal keys those with the
    smaller vector first); each round assigns all vectors and replaces every non-empty centroid by the exact floor of its mean.  Fewer vectors than clusters make fewer
    centroids.  Other vectors are left out; rows with a null key take part but start no centroid (with no key at all there is no result);
    repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    kind = dict(vectors.dtypes)[key]
    kept = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec")).filter(whole(F.col("vec")) & (F.size("vec") == dim))
    ordered = kept.filter(F.col("id").isNotNull()).orderBy(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256), "vec").limit(max(POOL, clusters))
    pool = [[int(np.floor(scale * np.float64(c))) for c in r.vec] for r in ordered.collect()]
    if not pool:
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    pool = np.array(pool, dtype=np.int64)
    at, centroids = choose_pivots(pool, pivots), pool[:clusters]
    table = cut(with_pivots(integers(kept, "vec", scale), at))
    for _ in range(rounds):
        sizes, sums, _ = cluster_sums(table, at, centroids)
        centroids = np.array([[s // sizes[c] for s in sums[c]] if sizes[c] else old.tolist() for c, old in enumerate(centroids)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, cluster, distance, _ = assigned(b, at, centroids)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    last = cut(table.mapInArrow(run, f"id {kind}, cluster int, distance bigint"))
    inertia = {r.cluster: r.total for r in last.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per = spark.createDataFrame([(c, t, sum(inertia.values()), names[c]) for c, t in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return last.join(F.broadcast(per), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
