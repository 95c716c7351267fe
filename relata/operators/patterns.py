"""Pattern join (J21): which texts hold which patterns, in one pass over the texts.

The patterns are dealt into blocks of bounded size; the patterns of a block go
to every task as one automaton (Aho and Corasick), which finds all of them in
a text in time linear in its length, however many there are and however short.
Texts are read in place: what leaves a task are ids alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.catalog import qcol

#: Characters of distinct patterns in one automaton (some 60 MB); more make more blocks, each with a pass of its own.
BLOCK_CHARS = 1 << 20
ROWS = 1024


def join_contains(a: DataFrame, a_id: str, a_text: str, b: DataFrame, b_id: str, b_text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs ``(a_id, b_id)`` with ``a.text LIKE '%' || b.text || '%'``, wildcards in patterns taken as characters.

    Exact for patterns of any length: an empty pattern is in every text that
    is not null.  Null texts and null patterns match nothing.
    """
    spark = a.sparkSession
    pats = b.select(qcol(b_id).alias("__bid"), qcol(b_text).cast("string").alias("__pat")).filter("__pat IS NOT NULL")
    distinct = pats.groupBy("__pat").agg(F.lit(1).alias("one")).select("__pat", F.xxhash64("__pat").alias("__hash"))
    chars = distinct.agg(F.coalesce(F.sum(F.length("__pat") + 1), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-chars // block_chars))
    texts = a.select(qcol(a_id).alias("__aid"), qcol(a_text).cast("string").alias("__txt")).filter("__txt IS NOT NULL")
    out_type = T.StructType([T.StructField("__aid", texts.schema["__aid"].dataType), T.StructField("__pat", T.StringType())])

    def found(block: int) -> DataFrame:
        words = [r["__pat"] for r in distinct.filter(F.pmod("__hash", F.lit(n_blocks)) == block).select("__pat").collect()]
        shared = spark.sparkContext.broadcast(words)  # about block_chars characters

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine, always = ahocorasick.Automaton(), "" in shared.value
            for w in shared.value:
                if w:
                    machine.add_word(w, w)
            some = len(machine) > 0
            if some:
                machine.make_automaton()
            for big in batches:
                for at in range(0, big.num_rows, ROWS):
                    batch = big.slice(at, ROWS)
                    raw = batch.column(1)
                    raw = raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary())
                    rows, hits = [], []
                    for i, text in enumerate(raw.to_pylist()):
                        mine = {w for _, w in machine.iter(text.decode("utf-8", "replace"))} if some else set()
                        if always:
                            mine.add("")
                        rows += [i] * len(mine)
                        hits += mine
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())],
                                                     names=["__aid", "__pat"])

        return texts.mapInArrow(scan, out_type)

    hits = found(0)
    for block in range(1, n_blocks):
        hits = hits.unionByName(found(block))
    return hits.join(pats, "__pat").select(F.col("__aid").alias(a_id), F.col("__bid").alias(b_id))
