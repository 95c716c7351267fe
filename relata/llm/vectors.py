"""Blocks of vectors, shared by the two vector searches.

Candidates are dealt once into blocks of about ``CANDIDATES`` rows, by a hash
of the row itself, so that blocks are the same whatever the cores, files or
order.  Queries are sent to every task in groups of at most ``QUERY_BYTES``;
for each group the blocks are read in place, and a search returns the best of
its block for each query, which a window merges.  Vectors are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.llm.common import checkpoint, lean

CANDIDATES = 16_384
QUERY_BYTES = 1 << 25


def clean(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """``(vec_id, v)`` as doubles, without null ids, null, empty or (if asked) zero vectors and such with null or non-finite components."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))
    return v.filter(F.exists("v", lambda x: x != 0)) if nonzero else v


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def _matrix(ids: pa.ChunkedArray | pa.Array, vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return ids.to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dim, ids, matrix)`` of each block of a partition that is sorted by block."""
    key, parts = None, []
    for b in batches:
        dims, blocks = b.column("dim").to_numpy(), b.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if hi == lo:
                continue
            if key is not None and key != (dims[lo], blocks[lo]):
                yield key[0], *(np.concatenate(x) for x in zip(*parts))
                parts = []
            key = (dims[lo], blocks[lo])
            parts.append(_matrix(b.column("vec_id").slice(lo, hi - lo), b.column("v").slice(lo, hi - lo)))
    if parts:
        yield key[0], *(np.concatenate(x) for x in zip(*parts))


def search(vectors: DataFrame, every: int, k: int, find: Search, score: str) -> DataFrame:
    """The ``k`` best of all rows for each row whose id is divisible by ``every``.

    ``find(query ids, query matrix, ids, matrix)`` yields ``(query id, ids,
    scores)``, at most ``k`` of the block, the query's own row left out.
    Vectors meet only vectors of their own length.  Ties go to the smaller id.
    Rows equal in id and vector are candidates of their own (more than ``k`` of
    them cannot matter) and one query.
    """
    spark = vectors.sparkSession
    kind, arrow = (np.int64, pa.int64()) if score == "long" else (np.float64, pa.float64())
    told = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("times"))  # combined where it is read
    told = checkpoint(told.select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("vec_id", "v").alias("deal"), "times"))
    sizes = told.agg(F.count("*").alias("n"), F.max("dim").alias("dim"),
                     F.coalesce(F.sum(F.when(F.pmod("vec_id", F.lit(every)) == 0, F.col("dim").cast("long"))), F.lit(0)).alias("asked")).first()
    n_blocks, n_groups = max(1, -(-sizes.n // CANDIDATES)), max(1, -(-8 * sizes.asked // QUERY_BYTES))
    rows = told.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    rows = rows.select("vec_id", "v", "dim", F.pmod("deal", F.lit(n_blocks)).cast("int").alias("block"))
    rows = checkpoint(rows.repartition(n_blocks, "dim", "block").sortWithinPartitions("dim", "block", "vec_id"))
    asks = told.filter(F.pmod("vec_id", F.lit(every)) == 0).select(
        "vec_id", "v", "dim", F.pmod(F.xxhash64("deal"), F.lit(n_groups)).alias("group"))

    def searched(group: int) -> DataFrame:
        mine = asks.filter(F.col("group") == group).select("vec_id", "v", "dim").toArrow()  # at most about QUERY_BYTES
        dims = mine.column("dim").to_numpy()
        ids, v = mine.column("vec_id"), mine.column("v")
        shared = spark.sparkContext.broadcast({int(d): _matrix(ids.filter(pa.array(dims == d)), v.filter(pa.array(dims == d))) for d in np.unique(dims)})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for dim, ids, data in _blocks(batches):
                if dim in shared.value:
                    found = [(np.full(len(i), one), i, s) for one, i, s in find(*shared.value[dim], ids, data)]
                    cols = [np.concatenate([f[j] for f in found]) if found else np.empty(0) for j in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)),
                                                      pa.array(cols[2].astype(kind), arrow)], names=["query_id", "vec_id", "score"])

        return rows.mapInArrow(lean(run), f"query_id long, vec_id long, score {score}")

    best = searched(0)
    for group in range(1, n_groups):
        best = best.union(searched(group))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
