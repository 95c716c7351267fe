"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_distinct(dfs: list[DataFrame]) -> DataFrame:
    """UNION of frames by column name, duplicates removed."""
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """DISTINCT (U2)."""
    return (df.select(*cols) if cols else df).distinct()


def except_rows(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of ``a`` absent from ``b`` (U4): ``EXCEPT``, not ``EXCEPT ALL``."""
    return a.select(*key).subtract(b.select(*key))


def merge_lists(*cols: Column) -> Column:
    """Ordered de-duplication of concatenated lists."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.array()) for c in cols])))
