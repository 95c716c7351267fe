"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder of ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, wish
    while name.lower() in taken:
        name += "_"
    return name


def rows_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-side rows (numbers and plain text) as an inline table."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else str(v)

    names = [re.split(r"\s+", c.strip())[0] for c in schema.split(",")]
    casts = [f"CAST({c.strip().split()[0]} AS {c.strip().split()[1]}) AS {c.strip().split()[0]}" for c in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(casts)} FROM VALUES {values} AS t({', '.join(names)})")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` whose worker gives memory back as it goes.

    Spark reuses Python workers, and Arrow's own allocator keeps what it once
    took; with the system's, freed batches go back between slices and tasks.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            for i, out in enumerate(run(batches)):
                yield out
                if i % 8 == 7:
                    pa.default_memory_pool().release_unused()
        finally:
            pa.default_memory_pool().release_unused()

    return task


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a text column (no decoding)."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def split_coded(batch: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space: the distinct ones, each word's number among them in text order, words per row."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    lists = pc.ascii_split_whitespace(col)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:  # from white space at a text's ends
        kept = index != blank
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[kept], minlength=len(counts))
        index = index[kept]
    return coded.dictionary, index, counts


def split_words(batch: pa.RecordBatch, column: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``split_coded`` with the distinct words as bytes."""
    words, index, counts = split_coded(batch, column)
    return words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).to_pylist(), index, counts


def gather(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pieces of ``flat``, whose lengths are ``size``, those of ``index`` one after the other, and the length of each."""
    first = np.cumsum(size) - size
    n = size[index]
    kind_at = np.int32 if len(flat) < 2**31 and n.sum() < 2**31 else np.int64
    at = np.repeat((first[index] - (np.cumsum(n) - n)).astype(kind_at), n)
    at += np.arange(len(at), dtype=kind_at)
    return flat[at], n


def dense_sum(df: DataFrame, accumulate: Callable[[pa.RecordBatch, np.ndarray], None], length: int,
              block: int = 4096, task_type: type = np.int64,
              finish: Callable[[np.ndarray], np.ndarray] | None = None, out_type: type = np.int64) -> np.ndarray:
    """Sum a fixed-length integer vector that every task fills from its rows.

    Each task sends its non-zero blocks (compressed); blocks are dealt out by
    number and summed as a stream, so no task holds more than its blocks and
    the driver gets ``length`` numbers, whatever the size of ``df``.  A task's
    vector has ``task_type``; sums are 64-bit, and ``finish`` can turn them
    into a smaller ``out_type`` before they reach the driver.
    """
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(length, task_type)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                accumulate(b.slice(at, 512), acc)
        kept = []
        for i in range((length + block - 1) // block):
            x = acc[i * block:(i + 1) * block]
            if x.any():
                kept.append((i, pa.compress(x.tobytes(), codec="zstd", asbytes=True)))
            if len(kept) == 64:
                yield packed(kept)
                kept = []
        if kept:
            yield packed(kept)

    def packed(some: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["block", "payload"])

    def opened(i: int, payload: bytes, kind: type) -> np.ndarray:
        n = min(block, length - i * block)
        return np.frombuffer(pa.decompress(payload, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i in acc:
                    acc[i] += opened(i, x, task_type)
                else:
                    acc[i] = opened(i, x, task_type).astype(np.int64)
        for i, x in acc.items():
            x = (finish(x) if finish else x).astype(out_type)
            yield packed([(i, pa.compress(x.tobytes(), codec="zstd", asbytes=True))])

    schema = "block int, payload binary"
    parts = min(64, max(1, (length + block - 1) // block))
    sums = df.mapInArrow(lean(part), schema).repartition(parts, "block").mapInArrow(lean(total), schema)
    out = np.zeros(length, out_type)
    for r in sums.collect():
        out[r.block * block:(r.block + 1) * block] = opened(r.block, r.payload, out_type)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``: one row ``(node, label)`` for
    each node whose component holds a smaller node; label is the smallest.

    Alternating large-star and small-star rounds: each joins neighbours with a
    per-node minimum (combined map-side), so a hub is never gathered; every
    round is checkpointed and the rounds end when the links no longer change.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").distinct()

    e = checkpoint(pairs(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == state or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = pairs(both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        e = checkpoint(pairs(small))
