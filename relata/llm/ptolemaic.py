"""Centroid clustering in whole numbers, with Ptolemaic lower bounds over fixed pivot pairs.

Lloyd's rounds on vectors turned into integers.  For Euclidean distance
Ptolemy's inequality holds: for pivots p, s and points x, c

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s).

Every vector's distances to a few fixed pivots are computed once and kept with
it; a round computes only the centroids' distances to the pivots.  A centroid
whose bound over all pivot pairs exceeds the distance already found is passed
over; bounds are rounded down by more than floating point can err, and what
survives is compared by exact integer distance, so results are those of the
full search.  Each round is one pass over the vectors: tasks send per-cluster
sums, which Spark adds up; only ``k`` rows come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import checkpoint, rows_frame

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
PIVOTS = 8
#: Components (after scaling) up to this size have squared distances below 2^63.
LARGEST = 1 << 27
#: Bounds are lowered by this share; their own rounding is some ten units of 2^-53.
SLACK = 1e-12
SLICE = 1024
PAIRS = 16_384


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part, components ``floor(scale * x)``."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    good = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(LARGEST) / scale)))
    v = v.filter(F.col("x").isNotNull() & (F.size("x") == dims) & F.coalesce(good, F.lit(False)))
    return v.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def starting(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id (rows without id last), in that order; bounded by k."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), len(first[0].v) if first else 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of equal place."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def far_pivots(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` different points, each the farthest from those before it (ties: the first)."""
    if not len(points):
        return points
    chosen, gap = [0], squared(points, points[:1])
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(points, points[chosen[-1:]]))
    return points[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p[None]) for p in pivots], axis=1).astype(np.float64))


class Assigner:
    """Nearest centroid of each vector (ties: the smaller number), with its exact squared distance."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.pairs = [(i, j, 1 / float(to_pivots(pivots[i][None], pivots[j][None])[0, 0])) for i, j in combinations(range(len(pivots)), 2)]
        self.c = to_pivots(centroids, pivots)
        self.checked = 0

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance of each vector (by its pivot distances) to each centroid."""
        low = np.zeros((len(x), len(self.centroids)))
        for i, j, one in self.pairs:
            a, b = x[:, i, None] * self.c[None, :, j], x[:, j, None] * self.c[None, :, i]
            np.maximum(low, (np.abs(a - b) - SLACK * (a + b)) * one, out=low)
        return low * (1 - SLACK)

    def __call__(self, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.bounds(x)
        rows = np.arange(len(v))
        guess = low.argmin(axis=1)
        best = squared(v, self.centroids[guess])
        left = low <= np.sqrt(best.astype(np.float64))[:, None] * (1 + SLACK)
        left[rows, guess] = False
        at, c = np.nonzero(left)
        self.checked += len(at) + len(v)
        dist = np.full(low.shape, np.iinfo(np.int64).max, np.int64)
        dist[rows, guess] = best
        for i in range(0, len(at), PAIRS):
            a, b = at[i:i + PAIRS], c[i:i + PAIRS]
            dist[a, b] = squared(v[a], self.centroids[b])
        cluster = dist.argmin(axis=1)  # the first of equals
        return cluster, dist[rows, cluster]


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), kind))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored.
    Vectors take part if they have exactly ``dims`` components, none null or
    non-finite, and none so large that a squared distance would not fit a long
    (``LARGEST`` after scaling).  Fewer than ``k`` vectors make as many
    centroids as there are; equal vectors make equal centroids, of which the
    smaller number takes all.  Rows that repeat an id are vectors of their own;
    a row without id takes part and starts a centroid only after all others.
    No vectors, no rows.
    """
    rows = whole_vectors(vectors, dims, scale)
    spark = rows.sparkSession
    centroids = starting(rows, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    pivots = far_pivots(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                c = b.slice(at, SLICE)
                v = _matrix(c, "v").astype(np.int64)
                yield pa.RecordBatch.from_arrays([c.column("vec_id"), _lists(v, pa.int32()), _lists(to_pivots(v, pivots), pa.float64())],
                                                 names=["vec_id", "v", "x"])

    known = checkpoint(rows.mapInArrow(measure, "vec_id long, v array<int>, x array<double>"))

    def slices(batches: Iterator[pa.RecordBatch], assign: Assigner):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                c = b.slice(at, SLICE)
                v = _matrix(c, "v").astype(np.int64)
                yield c, v, *assign(v, _matrix(c, "x"))

    def sums_for(now: np.ndarray):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for _, v, of, _ in slices(batches, Assigner(now, pivots)):
                order = np.argsort(of, kind="stable")
                met, first = np.unique(of[order], return_index=True)
                total[met] += np.add.reduceat(v[order], first, axis=0)
                n += np.bincount(of, minlength=len(now))
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), _lists(total[some], pa.int64())],
                                                 names=["cluster", "n", "s"])
        return sums

    for _ in range(rounds):
        part = known.mapInArrow(sums_for(centroids), "cluster int, n long, s array<long>")
        whole = part.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)))
        centroids = centroids.copy()
        for r in whole.collect():  # at most k rows
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]

    final = centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, _, of, dist in slices(batches, Assigner(final, pivots)):
            yield pa.RecordBatch.from_arrays([c.column("vec_id"), pa.array(of, pa.int32()), pa.array(dist, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    placed = checkpoint(known.mapInArrow(place, "vec_id long, cluster int, distance long"))
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k rows
    inertia = sum(int(r.s) for r in sums)
    named = [(r.cluster, int(r.s), inertia, hashlib.sha256(",".join(map(str, final[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    ends = rows_frame(spark, named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(ends), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
