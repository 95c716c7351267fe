"""Set-based changes: change sets, deep change tests, history, cascades.

A table is never modified in place; every operator returns the new table
as a DataFrame (write it to a new snapshot path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.catalog import qcol


def update_from(df: DataFrame, other: DataFrame, on: list[str], sets: dict[str, Column | str]) -> DataFrame:
    """``UPDATE df SET col = expr FROM other WHERE df.on = other.on``.

    ``sets`` expressions may use ``other``'s columns (prefixed ``__o_``) and
    ``df``'s columns; rows without a match keep their values.  ``other``
    should hold one row per key; if it repeats one, the smallest row wins.
    """
    rest = [c for c in other.columns if c not in on]
    # one row per key, chosen deterministically (smallest values) when ``other`` repeats a key
    o = other.groupBy(*[F.col(k).alias(f"__ok_{k}") for k in on]).agg(
        F.min(F.struct(*[F.col(c).alias(f"__o_{c}") for c in rest])).alias("__r")) if rest else other.select(
        *[F.col(k).alias(f"__ok_{k}") for k in on]).distinct()
    if rest:
        o = o.select(*[f"__ok_{k}" for k in on], *[F.col(f"__r.__o_{c}").alias(f"__o_{c}") for c in rest])
    cond = None
    for k in on:
        e = qcol(k) == F.col(f"__ok_{k}")
        cond = e if cond is None else cond & e
    j = df.join(o, cond, "left")
    hit = F.col(f"__ok_{on[0]}").isNotNull()
    out = []
    for c in df.columns:
        if c in sets:
            v = sets[c]
            v = F.expr(v) if isinstance(v, str) else v
            out.append(F.when(hit, v).otherwise(qcol(c)).alias(c))
        else:
            out.append(qcol(c))
    return j.select(*out)


def delete_using(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``DELETE FROM df USING other WHERE ...`` (J20): anti join."""
    return df.join(other.select(*on), on, "left_anti")


def is_changed(old: Column, new: Column, dtype: T.DataType) -> Column:
    """Deep change test (C19): scalars compared as text, records on shared fields, lists as unordered multisets."""
    if isinstance(dtype, T.ArrayType):
        norm = lambda c: F.sort_array(F.transform(c, lambda x: F.to_json(x) if isinstance(dtype.elementType, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string")))
        return ~norm(old).eqNullSafe(norm(new))
    if isinstance(dtype, T.StructType):
        out = F.lit(False)
        for f in dtype.fields:
            out = out | is_changed(old[f.name], new[f.name], f.dataType)
        return F.when(old.isNull() | new.isNull(), ~(old.isNull() & new.isNull())).otherwise(out)
    return ~old.cast("string").eqNullSafe(new.cast("string"))


def apply_changes(table: DataFrame, changes: DataFrame, key: list[str], writable: list[str] | None = None) -> DataFrame:
    """Bulk insert / update / delete by key in one merge.

    ``changes`` has the table's columns plus ``op`` in ('insert', 'update',
    'delete').  Updates only touch ``writable`` columns and only when a value
    differs; deletes match the whole key; inserts of existing keys become
    updates.  Of several changes of one key one counts: a delete before an
    update before an insert, then the greatest values.  One full outer join.
    """
    weight = F.when(F.col("op") == "delete", 3).when(F.col("op") == "update", 2).otherwise(1)
    whole = F.struct(*[F.col(c) for c in changes.columns])
    changes = changes.groupBy(*[F.col(k).alias(f"__k_{k}") for k in key]).agg(
        F.max_by(whole, F.struct(weight, F.to_json(whole))).alias("__change")).select("__change.*")
    cols = [c for c in table.columns]
    writable = writable or [c for c in cols if c not in key]
    ch = changes.select(*[F.col(c).alias(f"__n_{c}") for c in changes.columns if c != "op"], F.col("op").alias("__op"))
    cond = None
    for k in key:
        e = qcol(k) == F.col(f"__n_{k}")
        cond = e if cond is None else cond & e
    j = table.withColumn("__present", F.lit(True)).join(ch, cond, "full")
    present = F.coalesce(F.col("__present"), F.lit(False))
    op = F.col("__op")
    out = []
    for c in cols:
        newc = F.col(f"__n_{c}") if f"__n_{c}" in ch.columns else qcol(c)
        if c in key:
            out.append(F.when(present, qcol(c)).otherwise(newc).alias(c))
        elif c in writable:
            out.append(F.when(present & op.isin("update", "insert"), newc).when(~present, newc).otherwise(qcol(c)).alias(c))
        else:
            out.append(F.when(present, qcol(c)).otherwise(newc).alias(c))
    keep = ~(op == "delete") | op.isNull()
    keep = keep & (present | op.isin("insert", "update"))
    return j.filter(keep).select(*out)


def with_history(before: DataFrame, after: DataFrame, key: list[str], ts: str | None = None) -> DataFrame:
    """Change history between two snapshots (C21): one row per inserted, updated or deleted key.

    Columns: key columns, ``op`` (I/U/D), ``before`` and ``after`` as JSON
    text of the whole row, and a run timestamp when given (E19).
    """
    cols = [c for c in before.columns]
    b = before.select(*[F.col(k).alias(f"__bk_{k}") for k in key], F.to_json(F.struct(*[qcol(c) for c in cols])).alias("before"))
    a = after.select(*[F.col(k).alias(f"__ak_{k}") for k in key], F.to_json(F.struct(*[qcol(c) for c in cols])).alias("after"))
    cond = None
    for k in key:
        e = F.col(f"__bk_{k}") == F.col(f"__ak_{k}")
        cond = e if cond is None else cond & e
    j = b.join(a, cond, "full")
    op = F.when(F.col(f"__bk_{key[0]}").isNull(), F.lit("I")).when(F.col(f"__ak_{key[0]}").isNull(), F.lit("D")).when(
        ~F.col("before").eqNullSafe(F.col("after")), F.lit("U"))
    out = j.select(*[F.coalesce(F.col(f"__bk_{k}"), F.col(f"__ak_{k}")).alias(k) for k in key], op.alias("op"), "before", "after")
    out = out.filter(F.col("op").isNotNull())
    if ts:
        out = out.withColumn("changed_at", F.lit(ts).cast("timestamp_ntz"))
    return out


def cascade_delete(children: DataFrame, fk: str, parents_left: DataFrame, pk: str) -> DataFrame:
    """Children of deleted parents go too (C22): keep only children whose parent remains (semi join)."""
    return children.join(parents_left.select(F.col(pk).alias(fk)), fk, "left_semi")


def stamp(df: DataFrame, created: str, updated: str, ts: str) -> DataFrame:
    """Create/update stamps (E19): a literal run timestamp, identical on recompute."""
    t = F.lit(ts).cast("timestamp_ntz")
    return df.withColumn(created, F.coalesce(qcol(created), t) if created in df.columns else t).withColumn(updated, t)
