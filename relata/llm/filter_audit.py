"""Filter interaction audit: what each of five text filters removes in every order of application.

Filters A to D are conditions on a row's own text; E (a copy of a text with a
smaller ``doc_id``) is an existential self-join: a left-semi join on the
text's hash, the exact text and a smaller id marks the rows that fail it.  The
failing ids of E are united with those of the other filters, each row's
failures become one bit combination, and combinations are counted per part.
All 120 orders follow from these at most 32 counts a part: a filter removes,
in a given order, the combinations that hold its bit and none of those before.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.llm.common import checkpoint

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
SPACE = r"[ \t\n\x0B\f\r]+"  # ASCII white space
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def tests(ws: Column, n: Column) -> Column:
        bad = (n < 200, F.size(F.array_distinct(ws)) * 100 < n * 50,
               (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) * 100 > F.length(text) * 2,
               text.rlike(r"[#$%&*|]"))
        return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bad)), F.lit(0))

    # bound once: an array of one element, so that the words are not split for every use
    return F.transform(F.array(words), lambda ws: tests(ws, F.size(ws)))[0]


def copies(rows: DataFrame) -> DataFrame:
    """The rows ``(id, hash, part, text)`` whose exact text also stands under a smaller id.

    Only texts whose hash occurs more than once are compared.  The other side
    holds each text once, with its smallest id (combined before the shuffle),
    so a group of copies costs its size, not its square; the planner splits a
    hot group's left rows.
    """
    twice = rows.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1").select("hash")
    some = checkpoint(rows.join(twice, "hash", "left_semi"))
    first = some.filter("id IS NOT NULL").groupBy("hash", "text").agg(F.min("id").alias("first"))
    first = first.toDF("h", "t", "first")
    met = (F.col("hash") == F.col("h")) & (F.col("text") == F.col("t")) & (F.col("first") < F.col("id"))
    return some.join(first, met, "left_semi")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and bit combination of failed filters: ``part, bits, n, good, toxic``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary"))))
    key = ["id", "hash", "part"]
    own = rows.select(*key, failures(F.col("text")).alias("bits"), F.lit(1).alias("n"))
    copied = copies(rows).select(*key, F.lit(COPY).alias("bits"), F.lit(0).alias("n"))
    # rows equal in id, text and part fail the same filters and are counted together
    failed = own.union(copied).groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").filter("id IS NOT NULL").groupBy("id")
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"),
                  F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic")))
    both = failed.join(marks, "id", "left")
    return both.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``, ``labels`` ``doc_id``,
    ``quality`` and ``toxic``; other columns are ignored.  A null text counts
    as empty, a null source as the part ``''``.  A row without id is never a
    copy and makes no other row one; rows that repeat an id are judged each by
    its own text, and equal texts under one id are not copies of each other.  A
    document is good (toxic) if any label row of its id says so.  An empty
    table has no parts and gives no rows.
    """
    counts = combinations(docs, labels).groupBy("part").agg(  # at most 32 entries a part
        F.map_from_entries(F.collect_list(F.struct("bits", F.struct(*COUNTS)))).alias("c"))
    steps = []
    for order in permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            before = sum(1 << i for i in order[:step])
            steps.append(F.struct(F.lit("".join(FILTERS[i] for i in order)).alias("filter_order"), F.lit(step + 1).alias("step"),
                                  F.lit(before).alias("before"), F.lit(1 << f).alias("f")))
    grid = counts.select("part", F.array(*(F.coalesce(F.col("c")[i], F.struct(*(F.lit(0).cast("long").alias(x) for x in COUNTS)))
                                           for i in range(1 << len(FILTERS)))).alias("c"), F.explode(F.array(*steps)).alias("s"))
    grid = grid.select("part", "c", "s.*")

    def total(which, what: str = "n") -> Column:
        """Sum over the bit combinations for which ``which(bits)`` holds."""
        zero = F.lit(0).cast("long")
        of = F.transform("c", lambda x, bits: F.when(which(bits), x[what]).otherwise(zero))
        return F.aggregate(of, zero, lambda a, x: a + x)

    def has(bits: Column, some: Column) -> Column:
        return bits.bitwiseAND(some) != 0

    before, f = F.col("before"), F.col("f")
    removed = [total(lambda b: has(b, f) & ~has(b, before), what) for what in COUNTS]
    zero = F.lit(0).cast("long")
    # of 120 orders, a row that fails k filters falls to each of them in 120 / k
    share = F.transform("c", lambda x, b: F.when(has(b, f), x["n"] * (F.lit(120) / F.greatest(F.bit_count(b), F.lit(1))).cast("long")).otherwise(zero))
    return grid.select(
        "part", "filter_order", "step", total(lambda b: ~has(b, before.bitwiseOR(f))).alias("kept"), removed[0].alias("removed"),
        total(lambda b: has(b, f) & has(b, before)).alias("redundant"), total(lambda b: b == f).alias("unique_fails"),
        removed[1].alias("good_lost"), removed[2].alias("toxic_lost"), F.aggregate(share, zero, lambda a, x: a + x).alias("shapley"))
