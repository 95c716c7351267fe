"""Sort, paging and row numbering.

No operator here funnels the whole input through one partition:

* a page is ``orderBy().offset().limit()`` -> top-(offset+size) per partition,
  merged in one task (TakeOrderedAndProject); a page that ends deep in the
  order (known from its number and size alone) is cut from global row numbers;
* global row numbers (W1) are range-partitioned, numbered inside each
  partition, then shifted by the running count of the preceding partitions
  (a table with one row per partition, the only thing broadcast);
* the page of a given row (W3) counts the rows that sort before it: one
  aggregate, no window.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.catalog import Catalog, col_name, qcol, with_computed
from relata.functions.text import natural_keys
from relata.session import checkpoint_dir
from relata.operators.relations import attach_to_one, child_frame, prefix_name, KEY

# A page via orderBy().offset().limit() keeps the top (offset+size) rows of every partition and
# merges them in one task.  A page that ends after this many rows is cut from global row numbers
# instead (a distributed path).
DEEP_PAGE_ROWS = 100_000
LETTERS_FIRST, DIGITS_FIRST = "letters first", "digits first"


_SORT_MARK = re.compile(r"[-+*%]")


def parse_sort(spec) -> list[tuple[str, bool, str | None]]:
    """``"a,b-,c*"`` -> [(field, descending, natural kind)]; marks may stand anywhere in a key."""
    keys = []
    for key in spec.split(",") if isinstance(spec, str) else spec or ():
        field, marks = _SORT_MARK.sub("", key).strip(), set(_SORT_MARK.findall(key))
        if field or marks:
            natural = LETTERS_FIRST if "*" in marks else DIGITS_FIRST if "%" in marks else None
            keys.append((field, "-" in marks, natural))
    return keys


def sort_columns(
    catalog: Catalog, code: str, df: DataFrame, spec, add_pk: bool = True
) -> tuple[DataFrame, list[Column]]:
    """Resolve a sort spec into ordered Columns (NULLs last both ways), joining paths as needed.

    To-many paths sort by the smallest (ascending) or largest (descending)
    related value, aggregated per object before the join.
    """
    sd = catalog.schema(code)
    items = parse_sort(spec)
    reqs: dict[tuple[str, ...], set[str]] = defaultdict(set)
    resolved = []
    for f, desc, kind in items:
        hops, last = catalog.split_path(code, f)
        if any(h.to_many for h in hops):
            i = next(k for k, h in enumerate(hops) if h.to_many)
            rel = hops[i]
            prefix = tuple(h.name for h in hops[:i])
            if prefix:
                reqs[prefix].add(rel.local_key)
            resolved.append(("many", prefix, rel, tuple(hops[i + 1 :]), last, desc, kind))
        elif hops:
            prefix = tuple(h.name for h in hops)
            reqs[prefix].add(last)
            resolved.append(("one", prefix, None, (), last, desc, kind))
        else:
            resolved.append(("own", (), None, (), last, desc, kind))
    if reqs:
        df = attach_to_one(catalog, code, df, reqs)
    cols: list[Column] = []
    for n, (kind_, prefix, rel, rest, last, desc, nat) in enumerate(resolved):
        if kind_ == "many":
            agg_name = f"__sort_{n}"
            agg = _extremes(catalog, rel, rest, last, desc).withColumnRenamed("__value", agg_name)
            left = col_name(prefix_name(prefix), rel.local_key)
            df = df.join(agg, qcol(left) == F.col(KEY), "left").drop(KEY)
            c = F.col(agg_name)
        elif kind_ == "one":
            c = qcol(col_name(prefix_name(prefix), last))
        else:
            if last in sd.computed and last not in df.columns:
                df = df.withColumn(last, sd.computed[last](df))
            c = qcol(last)
        keys = natural_keys(c, nat == LETTERS_FIRST) if nat else [c]
        for k in keys:
            name = f"__s{len(cols)}"
            df = df.withColumn(name, k)
            cols.append(F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_last())
    if add_pk:
        df = with_computed(catalog, code, df, [sd.pk])
        name = f"__s{len(cols)}"
        df = df.withColumn(name, qcol(sd.pk))
        cols.append(F.col(name).asc_nulls_last())
    return df, cols


def _extremes(catalog: Catalog, rel, rest: tuple, last: str, desc: bool) -> DataFrame:
    """``(__key, __value)``: per object the smallest (largest) value at the end of a path.

    Every to-many hop is aggregated by itself before it meets the hop above.
    """
    i = next((k for k, h in enumerate(rest) if h.to_many), len(rest))
    names = tuple(h.name for h in rest[:i])
    deeper = rest[i] if i < len(rest) else None
    need = deeper.local_key if deeper else last
    ch = child_frame(catalog, rel, None if names else [need], dedupe=False)  # min/max ignore repeats
    if names:
        ch = attach_to_one(catalog, rel.target, ch, {names: {need}})
    value = qcol(col_name(prefix_name(names), need))
    if deeper:
        inner = _extremes(catalog, deeper, rest[i + 1 :], last, desc).withColumnRenamed(KEY, "__inner")
        ch = ch.join(inner, value == F.col("__inner"), "left")
        value = F.col("__value")
    return ch.groupBy(KEY).agg((F.max if desc else F.min)(value).alias("__value"))


def sort_helpers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("__s") and c[3:].isdigit()]


def page(df: DataFrame, order: list[Column], page_no: int | None, page_size: int | None) -> DataFrame:
    """Limit/offset page (O5); page_size <= 0 or None returns everything, sorted."""
    if not page_size or int(page_size) <= 0:
        return df.orderBy(*order) if order else df
    size = int(page_size)
    p = max(int(page_no or 1), 1)
    off = (p - 1) * size
    if off + size <= DEEP_PAGE_ROWS or not order:
        q = df.orderBy(*order) if order else df
        return q.offset(off).limit(size) if off else q.limit(size)
    rn = "__rn"
    numbered = with_row_number(df, order, rn)
    return numbered.filter((F.col(rn) > off) & (F.col(rn) <= off + size)).orderBy(rn).drop(rn)


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """Global ``ROW_NUMBER() OVER (ORDER BY order)`` (W1) without a one-partition window.

    ``order`` must be a total order (append the PK).  The frame is
    range-partitioned and sorted inside each partition, then written once
    with ``checkpoint()`` to the shared checkpoint folder: range bounds come
    from a sample that differs between two evaluations, so the partition
    counts and the in-partition positions must be read from the same
    materialised partitions.  This also cuts the lineage, so a lost
    executor does not renumber anything.  Only the per-partition counts (one
    row per partition) are broadcast.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    out = ranged.join(F.broadcast(offsets), "__pid")
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return out.withColumn(name, F.col("__off") + local + 1).drop("__pid", "__mid", "__off")


def lex_before(keys: list[tuple[Column, Column, bool]]) -> Column:
    """Row sorts strictly before the target: lexicographic, NULLs last in both directions.

    ``keys`` = [(row value, target value, descending)].
    """
    out = F.lit(False)
    eq = F.lit(True)
    for v, t, desc in keys:
        less = (v < t) if not desc else (v > t)
        before = F.when(v.isNull(), F.lit(False)).when(t.isNull(), F.lit(True)).otherwise(less)
        same = v.eqNullSafe(t)
        out = out | (eq & before)
        eq = eq & same
    return out


def page_of(
    catalog: Catalog, code: str, df: DataFrame, spec, pk_value, page_size: int
) -> DataFrame:
    """Page holding a given object (W3): count rows sorting before it, then ``ceil``.

    The target's sort keys are fetched once (one row, by key) and compared as
    literals in one aggregate over ``df``.
    """
    sd = catalog.schema(code)
    df2, _ = sort_columns(catalog, code, df, spec)
    desc: list[bool] = []
    for f, d, kind in parse_sort(spec):
        desc.extend([d] * (3 if kind else 1))
    desc.append(False)  # primary key
    names = sort_helpers(df2)
    # the target's sort keys: one row fetched by primary key, then used as literals
    t = df2.filter(qcol(sd.pk) == F.lit(pk_value)).select(*names).first()
    if t is None:
        return df2.select(F.lit(pk_value).cast(df2.schema[sd.pk].dataType).alias("pk"), F.lit(None).cast("long").alias("row_number"),
                          F.lit(None).cast("long").alias("page")).limit(0)
    types = {f.name: f.dataType for f in df2.schema.fields}
    before = lex_before([(F.col(k), F.lit(t[k]).cast(types[k]), d) for k, d in zip(names, desc)])
    cnt = df2.select(*names).agg(F.count_if(before).alias("n_before"))
    return cnt.select(
        F.lit(pk_value).cast(df2.schema[sd.pk].dataType).alias("pk"),
        (F.col("n_before") + 1).alias("row_number"),
        F.ceil((F.col("n_before") + 1) / F.lit(page_size)).cast("long").alias("page"),
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per group.

    ``row_number() <= k`` lets Spark insert a partial per-group limit before
    the shuffle (WindowGroupLimit), so a hot group ships at most ``k`` rows
    per map task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def fetch_keys(df: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    """Rows whose key is in ``keys`` (O9): semi join, keys never collected."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(pk)), pk, "left_semi")
