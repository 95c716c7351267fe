"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

Vectors are scaled to unit length, where Euclidean distance orders like
cosine.  A fixed Gaussian (2-stable) projection takes them to ``DIMS``
dimensions; squared projected distance over squared distance then follows the
chi-square distribution with ``DIMS`` degrees of freedom.  Each block of
candidates is a kd-tree over the projections.  A query descends it best first,
so that rows come in the order of their leaves' projected distance, and
verifies them on the original vectors; it stops when a row nearer than its
k-th so far would have been projected closer than the next node with
probability ``CONFIDENCE``.  Scores are sums in one order for every row, so
equal vectors have equal scores and ties are settled by id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from relata.llm.vectors import clean, search

K = 5
DIMS = 8
LEAF = 32
CONFIDENCE = 0.6
SEED = 4


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """x with P(chi-square of an even number of degrees <= x) = p, by bisection of the closed form."""
    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class KdTree:
    """Median cuts of the widest side; node i has a box, and either two children or rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.rows, self.children, low, high = [], [], [], []
        todo = [(np.arange(len(points)), -1)]
        while todo:
            rows, parent = todo.pop()
            node, p = len(self.rows), points[rows]
            low.append(p.min(axis=0))
            high.append(p.max(axis=0))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= leaf:
                self.rows.append(rows)
                continue
            self.rows.append(None)
            side = int(np.argmax(high[-1] - low[-1]))
            order = np.argpartition(p[:, side], len(rows) // 2)
            todo += [(rows[order[:len(rows) // 2]], node), (rows[order[len(rows) // 2:]], node)]
        self.low, self.high = np.array(low), np.array(high)

    def leaves(self, at: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Squared distance and rows of the leaves, nearest first; a node is opened only when it is the nearest left."""
        gap = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        far = (gap * gap).sum(axis=1).tolist()
        heap = [(far[0], 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.rows[node] is not None:
                yield d, self.rows[node]
            for c in self.children[node]:
                heapq.heappush(heap, (far[c], c))


def dots(rows: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order wherever the row stands (a matrix product does not promise that)."""
    return (rows * u).sum(axis=1)


def projected_search(q_ids, q, ids, m, k: int = K, confidence: float = CONFIDENCE, verified: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k nearest rows of one block found for each query; ``verified`` takes the number of rows compared."""
    def length(x):  # scaled first, so that very small or large components neither vanish nor overflow
        top = np.abs(x).max(axis=1, keepdims=True)
        return top[:, 0] * np.sqrt(((x / top) ** 2).sum(axis=1))

    unit, q_unit = m / length(m)[:, None], q / length(q)[:, None]
    project = np.random.default_rng(SEED).standard_normal((m.shape[1], DIMS))
    tree, q_points = KdTree(unit @ project), q_unit @ project
    limit = chi_square_quantile(confidence)
    for one, u, at in zip(q_ids, q_unit, q_points):
        met, scores, waiting, n, batch = np.empty(0, np.int64), np.empty(0), [], 0, 4 * k

        def check():
            nonlocal met, scores, waiting, n
            rows = np.concatenate(waiting)
            rows, waiting = rows[ids[rows] != one], []
            n += len(rows)
            met, scores = np.concatenate([met, rows]), np.concatenate([scores, dots(unit[rows], u)])
            best = np.lexsort((ids[met], -scores))[:k]
            met, scores = met[best], scores[best]

        for far, rows in tree.leaves(at):
            if len(met) >= k and far >= limit * max(2 - 2 * float(scores[-1]), 0.0) + 1e-12:
                break  # checked against the k-th of what is verified: waiting rows can only bring it nearer
            waiting.append(rows)
            if sum(map(len, waiting)) >= batch:
                check()
                batch = min(2 * batch, 512)
        if waiting:
            check()
        if verified is not None:
            verified.append(n)
        yield int(one), ids[met], scores


def nearest(vectors: DataFrame, every: int = 50, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found by cosine (double precision).

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored.
    Queries are the rows whose id is divisible by ``every``, candidates all
    other rows; every row is indexed.  Ties go to the smaller id.  Vectors that
    are null, empty or zero or hold null or non-finite components, and rows
    without id, take no part; vectors meet only vectors of their own length.  A
    query with fewer than k candidates gets them all.  Rows that repeat an id
    are candidates of their own, except for queries of the same id.
    """
    return search(clean(vectors, nonzero=True), every, k, lambda *a: projected_search(*a, k=k, confidence=confidence), "double")
