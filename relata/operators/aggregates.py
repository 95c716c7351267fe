"""Aggregations.

Lists of "first lines" are bounded: ``row_number() <= k`` lets Spark
apply a per-group limit before the shuffle, so a value that holds a third
of all rows still ships at most ``k`` rows per map task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

FIRST_LINES = 5


def first_lines(df: DataFrame, by: list[str], line: str = "id_import", k: int = FIRST_LINES, out: str = "lines") -> DataFrame:
    """Per group: the ``k`` smallest line ids as a sorted array (bounded)."""
    w = Window.partitionBy(*by).orderBy(F.col(line))
    top = df.select(*by, line).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
    return top.groupBy(*by).agg(F.sort_array(F.collect_list(line)).alias(out))


def value_profile(df: DataFrame, by: list[str], line: str = "id_import", k: int = FIRST_LINES) -> DataFrame:
    """Grouped profile (A5): count and first ``k`` lines per value."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("nb_lines"))
    firsts = first_lines(df, by, line, k)
    return counts.join(firsts, by, "left")


def collapse(df: DataFrame, cols: list[str], line: str = "id_import") -> DataFrame:
    """Collapse identical rows (A3): one row per distinct ``cols`` with its first line and count.

    The full list of lines is not kept (it grows with the data); lines of a
    collapsed row are recovered by joining back on ``cols`` (``lines_of``).
    """
    return df.groupBy(*cols).agg(F.min(line).alias(line), F.count(F.lit(1)).alias("nb_lines"))


def lines_of(raw: DataFrame, collapsed: DataFrame, cols: list[str], line: str = "id_import") -> DataFrame:
    """Raw line -> collapsed line (J10), by null-safe equality on the grouped columns."""
    c = collapsed.select(*[F.col(x).alias(f"__c_{x}") for x in cols], F.col(line).alias("__first"))
    cond = None
    for x in cols:
        e = F.col(x).eqNullSafe(F.col(f"__c_{x}"))
        cond = e if cond is None else cond & e
    return raw.join(c, cond, "inner").select(F.col(line), F.col("__first").alias("first_line"))


def key_conflicts(df: DataFrame, unique: list[str], cols: list[str], line: str = "id_import") -> DataFrame:
    """Natural-key conflicts (A4): keys carrying more than one distinct row.

    Exact duplicates are not conflicts.  Two aggregates, both combined
    map-side; NULL keys group together.
    """
    distinct_rows = df.select(*dict.fromkeys(unique + cols)).distinct()
    bad = distinct_rows.groupBy(*unique).agg(F.count(F.lit(1)).alias("nb_distinct")).filter(F.col("nb_distinct") > 1)
    keys = bad.select(*unique)
    rows = df.join(keys, _ns_cond(df, keys, unique), "left_semi")
    prof = rows.groupBy(*unique).agg(F.count(F.lit(1)).alias("nb_lines"))
    firsts = first_lines(rows, unique, line)
    out = prof.join(bad, _ns_cond(prof, bad, unique)).select(*[prof[u] for u in unique], "nb_lines", "nb_distinct")
    return out.join(firsts, _ns_cond(out, firsts, unique), "left").drop(*[firsts[u] for u in unique])


def _ns_cond(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = None
    for k in keys:
        e = a[k].eqNullSafe(b[k])
        cond = e if cond is None else cond & e
    return cond


def required_profile(df: DataFrame, cols: list[str], line: str = "id_import", k: int = FIRST_LINES) -> DataFrame:
    """NULL count and first lines per required column (A18), in one pass over ``df``.

    Columns are unpivoted only for the NULL cells, then profiled.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, nb_lines long, lines array<long>")
    arr = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    cells = df.select(F.col(line), F.explode(F.array_compact(arr)).alias("column"))
    counts = cells.groupBy("column").agg(F.count(F.lit(1)).alias("nb_lines"))
    return counts.join(first_lines(cells, ["column"], line, k), "column", "left")


def frequencies(df: DataFrame, cols: list[str], out: str = "n") -> DataFrame:
    """Frequency table (A15), most frequent first."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out)).orderBy(F.col(out).desc(), *cols)


def having(df: DataFrame, by: list[str], agg: Column, pred) -> DataFrame:
    """Aggregate then filter groups."""
    out = df.groupBy(*by).agg(agg)
    return out.filter(pred)


def agg_text(df: DataFrame, by: list[str], col: str, out: str, sep: str = ", ", distinct: bool = False) -> DataFrame:
    """Ordered string aggregation (A7): the values of ``col`` per group, sorted, joined by ``sep``.

    Values are first counted per (group, value), combined map-side, so a
    group made of many copies of few values is small before the shuffle;
    repeats are expanded again only in the final text.
    """
    v = F.col(col).cast("string")
    counted = df.filter(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col("__v"), F.col("__n"))))
    if distinct:
        vals = F.transform(pairs, lambda x: x["__v"])
    else:
        vals = F.flatten(F.transform(pairs, lambda x: F.array_repeat(x["__v"], x["__n"].cast("int"))))
    return counted.groupBy(*by).agg(F.array_join(vals, sep).alias(out))


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key (A12) under a total ``order``; never an order-blind dropDuplicates.

    ``row_number() == 1`` gets a map-side per-group limit (WindowGroupLimit).
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def any_equals(col: Column, value) -> Column:
    """Aggregate: does any row of the group equal ``value``."""
    return F.bool_or(col == F.lit(value))


def count_distinct(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """COUNT(DISTINCT col)."""
    return df.agg(F.count_distinct(F.col(col)).alias(out))


def export_view(df: DataFrame, scalar: list[str], many: list[str], sep: str = ", ") -> DataFrame:
    """Flattened export (A6/S13): group by scalar columns, distinct sorted text of to-many columns."""
    aggs = [F.array_join(F.array_sort(F.collect_set(F.col(m).cast("string"))), sep).alias(m) for m in many]
    return df.groupBy(*scalar).agg(*aggs)


def observe_counts(df: DataFrame, name: str, **counts: Column):
    """Counts of a stage collected while the frame is computed anyway.

    ``counts`` are named aggregates (by default ``rows``).  Returns (frame,
    Observation); read ``obs.get`` after an action on the frame: no extra job
    is run.  Names may repeat: each call observes for itself.
    """
    obs = Observation(f"{name}_{uuid.uuid4().hex}")
    counts = counts or {"rows": F.count(F.lit(1))}
    return df.observe(obs, *[c.alias(k) for k, c in counts.items()]), obs
