"""Consistent-hash ring with virtual nodes and bounded loads.

DataFrame operations only.  Each shard has ``VNODES`` points on a ring; a
document's key lands on the arc that ends at the next point clockwise, whose
shard is its home.  A shard takes at most its capacity: the keys of its own
arcs first, clockwise and in a fixed order within an arc; what does not fit
goes on clockwise to the next shards with room.  Capacities differ by one at most and add up to the
number of rows, so the counts are balanced exactly, and a document moves only
where its home is full.

Spark counts rows by arc; the walk round the ring needs those counts only (a
fixed number of arcs) and gives intervals of ranks within an arc.  Ranks come
from one window over pieces of arcs, so no shard is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.llm.common import checkpoint, rows_frame

VNODES = 64
#: An arc is ranked in as many pieces (by a hash of the row) as its counted rows fill; a run of identical rows is cut likewise.
PIECE_ROWS = 1 << 18
_RING = 1 << 60


def ring_points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """``(position, shard)`` of every virtual node, in ring order."""
    def at(s: int, v: int) -> int:
        return int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:15], 16)

    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(points: list[tuple[int, int]], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Place the counted keys of each arc: ``(arc, first rank, end rank, shard, first slot)``."""
    room = capacities(sum(counts), shards)
    size = room[:]
    placed, over = [], []

    def put(arc: int, lo: int, hi: int, shard: int) -> int:
        take = min(hi - lo, room[shard])
        if take:
            placed.append((arc, lo, lo + take, shard, size[shard] - room[shard]))
            room[shard] -= take
        return lo + take

    for arc, (_, shard) in enumerate(points):  # homes first
        rest = put(arc, 0, counts[arc], shard)
        over.append((arc, rest, counts[arc]))
    queue: deque[tuple[int, int, int]] = deque()
    for turn in range(2):  # then clockwise; the second turn brings round what passed the end
        for arc, (_, shard) in enumerate(points):
            if turn == 0 and over[arc][1] < over[arc][2]:
                queue.append(over[arc])
            while queue and room[shard]:
                a, lo, hi = queue.popleft()
                lo = put(a, lo, hi, shard)
                if lo < hi:
                    queue.appendleft((a, lo, hi))
    return placed


def _position(key: Column) -> Column:
    """60 bits of MD5: a ring position that any engine computes alike."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def shard_rows(docs: DataFrame, shards: int = 24, vnodes: int = VNODES) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  The key
    is doc_id (null: the empty key); rows of one key are told apart by their
    text's checksum and size, and identical rows are interchangeable.  Null and
    empty texts have 8 bytes and checksum 0.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    points = ring_points(shards, vnodes)
    ends = F.array(*(F.lit(p) for p, _ in points))
    n = len(points)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = rows.withColumn("at", _position(key))
    # the bucket of a position narrows the arcs to the few whose ends lie near it
    cells = 4096
    first = [0] * (cells + 1)
    for c in range(cells + 1):
        first[c] = sum(p < c * (_RING // cells) for p, _ in points)
    cell = F.shiftright("at", 48).cast("int")
    table = rows_frame(docs.sparkSession, [(c, first[c], first[c + 1]) for c in range(cells)], "cell int, lo int, hi int")
    rows = rows.withColumn("cell", cell).join(F.broadcast(table), "cell")
    inside = F.aggregate(F.slice(ends, F.col("lo") + 1, F.col("hi") - F.col("lo")), F.lit(0),
                         lambda s, e: s + (e < F.col("at")).cast("int"))
    arc = F.pmod(F.col("lo") + F.when(F.col("hi") > F.col("lo"), inside).otherwise(0), F.lit(n))
    # identical rows are one row with a count until they get their slots
    like = ["doc_id", "size", "text_crc32", "at", "arc"]
    rows = checkpoint(rows.withColumn("arc", arc.cast("int")).groupBy(*like).agg(F.count("*").alias("times")))
    in_arc = {r.arc: r.n for r in rows.groupBy("arc").agg(F.sum("times").alias("n")).collect()}
    counts = [in_arc.get(a, 0) for a in range(n)]
    cuts = rows_frame(docs.sparkSession, [(a, max(1, -(-c // PIECE_ROWS))) for a, c in enumerate(counts)], "arc int, pieces int")
    rows = rows.join(F.broadcast(cuts), "arc").withColumn("piece", F.pmod(F.xxhash64("at", "text_crc32", "size"), F.col("pieces")).cast("int"))
    counted = rows.groupBy("arc", "piece").agg(F.sum("times").alias("n")).collect()  # a row for each PIECE_ROWS rows, and each arc
    bases, plan, before = [], walk(points, counts, shards), [0] * n
    for r in sorted(counted, key=lambda r: (r.arc, r.piece)):
        bases.append((r.arc, r.piece, before[r.arc], points[r.arc][1]))
        before[r.arc] += r.n
    base = rows_frame(docs.sparkSession, bases, "arc int, piece int, base long, home_shard int")
    taken = rows_frame(docs.sparkSession, plan, "arc int, lo long, hi long, shard int, first long")
    order = Window.partitionBy("arc", "piece").orderBy("at", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("ahead", F.coalesce(F.sum("times").over(order), F.lit(0))).join(F.broadcast(base), ["arc", "piece"])
    # long runs of identical rows are dealt out in parts before each row gets its own rank
    run = F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(PIECE_ROWS).cast("long"))
    runs = ranked.filter(F.col("times") > PIECE_ROWS).withColumn("at_run", F.explode(run))
    runs = runs.repartition("arc", "piece", "text_crc32", "at_run").withColumn("copy", F.explode(F.sequence(
        F.col("at_run"), F.least(F.col("at_run") + PIECE_ROWS, F.col("times")) - 1))).drop("at_run")
    few = ranked.filter(F.col("times") <= PIECE_ROWS).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    ranked = few.unionByName(runs).withColumn("rank", F.col("base") + F.col("ahead") + F.col("copy"))
    placed = ranked.alias("r").join(F.broadcast(taken).alias("t"), (F.col("r.arc") == F.col("t.arc"))
                                    & (F.col("r.rank") >= F.col("t.lo")) & (F.col("r.rank") < F.col("t.hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                         "home_shard")
