"""Ownership scope and permission filters.

Scope levels: 1 = the user's own row, 2 = a row of the user's
organisation, 3 = any other row.  Rules are plain functions on the
object definition; flags coming from to-many relations are aggregated per
object (distinct keys, combined map-side) before they meet the object.
The user is looked up as a one-row frame (bounded, so broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.catalog import Catalog, qcol


def scope_of(catalog: Catalog, code: str, df: DataFrame, user) -> DataFrame:
    """Add a ``scope`` column (X1/X2); 0 when the object has no scope rule."""
    sd = catalog.schema(code)
    if sd.scope_rule is None or user is None:
        return df.withColumn("scope", F.lit(0))
    return sd.scope_rule(catalog, df, user)


def restrict(catalog: Catalog, code: str, df: DataFrame, user, allowed: int = 3) -> DataFrame:
    """Keep rows with ``scope <= allowed`` (X3); no user or ``allowed >= 3`` means no restriction."""
    if user is None or allowed is None or allowed >= 3:
        return df
    cols = df.columns
    sd = catalog.schema(code)
    if sd.scope_rule is None:
        return df
    scoped = scope_of(catalog, code, df, user)
    return scoped.filter((F.col("scope") > 0) & (F.col("scope") <= allowed)).select(*[qcol(c) for c in cols])


def restrict_sensitive(catalog: Catalog, code: str, df: DataFrame, column: str = "sensitivity") -> DataFrame:
    """Only rows at sensitivity code ``'0'``."""
    sd = catalog.schema(code)
    if column in sd.computed and column not in df.columns:
        df = df.withColumn(column, sd.computed[column](df))
        return df.filter(F.col(column) == "0").drop(column)
    return df.filter(F.col(column) == "0")


def inherit_scope(catalog: Catalog, parent_code: str, child: DataFrame, fk: str, user) -> DataFrame:
    """Child rows take the scope of their parent."""
    psd = catalog.schema(parent_code)
    parents = scope_of(catalog, parent_code, catalog.frame(parent_code), user)
    parents = parents.select(F.col(psd.pk).alias("__pk"), "scope")
    return child.join(parents, qcol(fk) == F.col("__pk"), "left").drop("__pk")


def prune_rights(granted: DataFrame, offered: DataFrame, key: list[str]) -> DataFrame:
    """Drop rights that are no longer offered (X7): distinct EXCEPT on the key, then delete-using."""
    gone = granted.select(*key).subtract(offered.select(*key))
    return granted.join(gone, key, "left_anti")


# ---------------------------------------------------------------- rules on the driver tables
def _user_row(catalog: Catalog, user) -> tuple:
    """The user's key and organisation (a customer and its nation): one row fetched by key."""
    c = catalog.frame("customer")
    r = c.filter(F.col("c_custkey") == F.lit(user)).select("c_custkey", "c_nationkey").first()
    return (user, r["c_nationkey"] if r is not None else None)


def customer_scope(catalog: Catalog, df: DataFrame, user) -> DataFrame:
    me, org = _user_row(catalog, user)
    out = df
    if "c_nationkey" not in df.columns:
        base = catalog.frame("customer").select(F.col("c_custkey").alias("__ck"), "c_nationkey")
        out = df.join(base, F.col("c_custkey") == F.col("__ck"), "left").drop("__ck")
    org_lit = F.lit(org).cast("int")
    level = (
        F.when(F.col("c_custkey") == F.lit(me), 1)
        .when(F.col("c_nationkey").isNotNull() & org_lit.isNotNull() & (F.col("c_nationkey") == org_lit), 2)
        .otherwise(3)
    )
    return out.select(*[qcol(c) for c in df.columns], level.alias("scope"))


def order_scope(catalog: Catalog, df: DataFrame, user) -> DataFrame:
    """Order: creator (o_custkey) = me -> 1; a line supplied by my organisation -> 2; else 3.

    The organisation flag is the distinct order keys of lines whose supplier
    is in the user's nation (combined map-side), left-joined by order key.
    """
    me, org = _user_row(catalog, user)
    li = catalog.frame("lineitem").select("l_orderkey", "l_suppkey")
    sup = catalog.frame("supplier").select("s_suppkey", "s_nationkey").filter(F.col("s_nationkey") == F.lit(org))
    org_lines = (
        li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("l_orderkey").alias("__ok"))
        .distinct()
        .withColumn("__org_hit", F.lit(True))
    )
    out = df.join(org_lines, F.col("o_orderkey") == F.col("__ok"), "left")
    level = (
        F.when(F.col("o_custkey") == F.lit(me), 1)
        .when(F.coalesce(F.col("__org_hit"), F.lit(False)), 2)
        .otherwise(3)
    )
    return out.select(*[qcol(c) for c in df.columns], level.alias("scope"))
