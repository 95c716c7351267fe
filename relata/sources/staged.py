"""Staged (all-text) import inputs derived from the driver tables.

Faults are injected by key arithmetic so the expected outcome of every
check can be computed in plain SQL; every row of the source table is
staged (nothing is sampled away).

customers, faulty
    name blank                          key % 89 = 5
    unknown nation code 'NATION_X'      key % 101 = 7
    unparsable balance 'n/a<key % 3>'   key % 97 = 3
    exact duplicate line                key % 53 = 0   (line id 2*key+2)
    conflicting line (balance '0.5')    key % 59 = 0   (line id 2*key+2, 2*key+3 if also duplicated)
customers, clean
    balance + 1 (update)                key % 7 = 0
    new customer key + 10,000,000       key % 11 = 0   (an extra line)
    exact duplicate line                key % 53 = 0
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.plans.ingest import FieldSpec, ImportSpec
from relata.sources.tables import load_table

NEW_KEY_OFFSET = 10_000_000


def _customers_named(spark: SparkSession, sf: str) -> DataFrame:
    c = load_table(spark, sf, "customer")
    n = F.broadcast(load_table(spark, sf, "nation").select("n_nationkey", "n_name"))  # 25-row code list
    return c.join(n, c.c_nationkey == n.n_nationkey, "left")


def staged_customers_faulty(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers_named(spark, sf)
    k = F.col("c_custkey")
    base = c.select(
        (k * 2 + 1).alias("id_import"),
        k.cast("string").alias("c_custkey"),
        F.when(k % 89 == 5, F.lit(None)).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 101 == 7, F.lit("NATION_X")).otherwise(F.col("n_name")).alias("c_nationkey"),
        F.when(k % 97 == 3, F.concat(F.lit("n/a"), (k % 3).cast("string"))).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.col("c_mktsegment"),
    )
    dup = base.filter((F.col("c_custkey").cast("long") % 53) == 0).withColumn("id_import", F.col("id_import") + 1)
    conf = base.filter((F.col("c_custkey").cast("long") % 59) == 0).withColumn(
        "id_import", F.col("id_import") + F.when((F.col("c_custkey").cast("long") % 53) == 0, 2).otherwise(1)
    ).withColumn("c_acctbal", F.lit("0.5"))
    return base.unionByName(dup).unionByName(conf)


def staged_customers_clean(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers_named(spark, sf)
    k = F.col("c_custkey")
    base = c.select(
        (k * 3 + 1).alias("id_import"),
        k.cast("string").alias("c_custkey"),
        F.col("c_name"),
        F.col("n_name").alias("c_nationkey"),
        F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).cast("string").alias("c_acctbal"),
        F.col("c_mktsegment"),
    )
    dup = base.filter((F.col("c_custkey").cast("long") % 53) == 0).withColumn("id_import", F.col("id_import") + 1)
    new = c.filter(k % 11 == 0).select(
        (k * 3 + 3).alias("id_import"),
        (k + NEW_KEY_OFFSET).cast("string").alias("c_custkey"),
        F.concat(F.lit("New#"), k.cast("string")).alias("c_name"),
        F.col("n_name").alias("c_nationkey"),
        F.col("c_acctbal").cast("string").alias("c_acctbal"),
        F.col("c_mktsegment"),
    )
    return base.unionByName(dup).unionByName(new)


def customer_import_spec() -> ImportSpec:
    return ImportSpec(
        code="customer",
        unique=["c_custkey"],
        fields={
            "c_custkey": FieldSpec("integer", required=True),
            "c_name": FieldSpec("string", required=True),
            "c_nationkey": FieldSpec("integer", required=True, ref="nation", ref_unique=["n_name"]),
            "c_acctbal": FieldSpec("number"),
            "c_mktsegment": FieldSpec("string"),
        },
    )


def staged_orders_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their priority as a code to resolve against the code list; unknown code when key % 211 = 0."""
    o = load_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (k + 1).alias("id_import"), k.cast("string").alias("o_orderkey"),
        F.when(k % 211 == 0, F.lit("9-NEVER")).otherwise(F.col("o_orderpriority")).alias("id_priority"),
    )


def staged_order_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their parts as a comma list (n-n column); for key % 5 = 0 the list drops its largest part."""
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    k = F.col("l_orderkey")
    trimmed = F.when((k % 5 == 0) & (F.size("parts") > 1), F.slice("parts", 1, F.size("parts") - 1)).otherwise(F.col("parts"))
    return lists.select(
        (k + 1).alias("id_import"), k.cast("string").alias("o_orderkey"),
        F.array_join(F.transform(trimmed, lambda x: x.cast("string")), ", ").alias("parts"),
    )
