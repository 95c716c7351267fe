"""Table sources (S6) and the object catalog over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.catalog import Catalog, Relation, SchemaDef
from relata.operators import geo
from relata.operators import scope as scope_ops

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_point_x(df: DataFrame):
    """Longitude derived from the key by integer arithmetic (same in SQL): 5.000..5.999."""
    return F.lit(5.0) + (F.col("c_custkey") % 1000) / F.lit(1000.0)


def customer_point_y(df: DataFrame):
    """Latitude derived from the key: 45.000..45.999."""
    return F.lit(45.0) + ((F.col("c_custkey") * 37) % 1000) / F.lit(1000.0)


def supplier_point_x(df: DataFrame):
    return F.lit(5.0) + ((F.col("s_suppkey") * 13) % 1000) / F.lit(1000.0)


def supplier_point_y(df: DataFrame):
    return F.lit(45.0) + ((F.col("s_suppkey") * 29) % 1000) / F.lit(1000.0)


def code_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code list (nomenclature) derived from the driver tables.

    Columns: id_nomenclature, type, cd_nomenclature, label.  Each type is a
    ``distinct`` over one column (combined map-side), so the frame is as big
    as the number of codes, not the tables.
    """
    parts = [
        load_table(spark, sf_dir, "region").select(F.lit("region").alias("type"), F.col("r_name").alias("code")),
        load_table(spark, sf_dir, "nation").select(F.lit("nation").alias("type"), F.col("n_name").alias("code")),
        load_table(spark, sf_dir, "orders").select(F.lit("priority").alias("type"), F.col("o_orderpriority").alias("code")).distinct(),
        load_table(spark, sf_dir, "part").select(F.lit("brand").alias("type"), F.col("p_brand").alias("code")).distinct(),
        load_table(spark, sf_dir, "customer").select(F.lit("segment").alias("type"), F.col("c_mktsegment").alias("code")).distinct(),
    ]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.distinct()
    # the code list is tiny; a global window over it is bounded
    w = Window.orderBy("type", "code")
    return df.select(
        F.row_number().over(w).cast("int").alias("id_nomenclature"),
        F.col("type"),
        F.col("code").alias("cd_nomenclature"),
        F.initcap(F.lower(F.col("code"))).alias("label"),
    )


def driver_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    cache: dict[str, DataFrame] = {}

    def loader(table: str) -> DataFrame:
        if table == "nomenclature":
            if table not in cache:
                cache[table] = code_list(spark, sf_dir)
            return cache[table]
        return load_table(spark, sf_dir, table)

    cat = Catalog(spark, loader)
    cat.add(SchemaDef(
        "region", "region", "r_regionkey", unique=["r_name"], label="r_name", bounded=True,
        relations={"nations": Relation("nations", "1-n", "nation", "r_regionkey", "n_regionkey")},
    ))
    cat.add(SchemaDef(
        "nation", "nation", "n_nationkey", unique=["n_name"], label="n_name", bounded=True,
        relations={
            "region": Relation("region", "n-1", "region", "n_regionkey", "r_regionkey"),
            "customers": Relation("customers", "1-n", "customer", "n_nationkey", "c_nationkey"),
            "suppliers": Relation("suppliers", "1-n", "supplier", "n_nationkey", "s_nationkey"),
        },
    ))
    cat.add(SchemaDef(
        "customer", "customer", "c_custkey", unique=["c_custkey"], label="c_name",
        relations={
            "nation": Relation("nation", "n-1", "nation", "c_nationkey", "n_nationkey"),
            "orders": Relation("orders", "1-n", "order", "c_custkey", "o_custkey"),
            "events": Relation("events", "1-n", "event", "c_custkey", "user_id"),
        },
        computed={
            "x": customer_point_x,
            "y": customer_point_y,
            "geom": lambda df: geo.make_point(customer_point_x(df), customer_point_y(df), 4326),
        },
        code_columns={"c_mktsegment": "segment"},
        geometry="geom",
        scope_rule=scope_ops.customer_scope,
        titles={"c_name": "Name", "c_acctbal": "Balance", "nation": "Nation"},
    ))
    cat.add(SchemaDef(
        "supplier", "supplier", "s_suppkey", unique=["s_suppkey"], label="s_name",
        relations={
            "nation": Relation("nation", "n-1", "nation", "s_nationkey", "n_nationkey"),
            "lineitems": Relation("lineitems", "1-n", "lineitem", "s_suppkey", "l_suppkey"),
        },
        computed={
            "x": supplier_point_x,
            "y": supplier_point_y,
            "geom": lambda df: geo.make_point(supplier_point_x(df), supplier_point_y(df), 4326),
        },
        geometry="geom",
    ))
    cat.add(SchemaDef(
        "part", "part", "p_partkey", unique=["p_partkey"], label="p_name",
        relations={"lineitems": Relation("lineitems", "1-n", "lineitem", "p_partkey", "l_partkey")},
        code_columns={"p_brand": "brand"},
    ))
    cat.add(SchemaDef(
        "order", "orders", "o_orderkey", unique=["o_orderkey"], label="o_orderkey",
        relations={
            "customer": Relation("customer", "n-1", "customer", "o_custkey", "c_custkey"),
            "lineitems": Relation("lineitems", "1-n", "lineitem", "o_orderkey", "l_orderkey"),
            "parts": Relation("parts", "n-n", "part", "o_orderkey", "p_partkey",
                              bridge="lineitem", bridge_local="l_orderkey", bridge_foreign="l_partkey"),
        },
        computed={
            "sensitivity": lambda df: F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("4")).otherwise(F.lit("0")),
        },
        code_columns={"o_orderpriority": "priority"},
        scope_rule=scope_ops.order_scope,
    ))
    cat.add(SchemaDef(
        "lineitem", "lineitem", "l_rowid",
        computed={
            "l_rowid": lambda df: F.concat_ws(
                "|", *[F.col(c).cast("string") for c in (
                    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]
            ),
        },
        relations={
            "order": Relation("order", "n-1", "order", "l_orderkey", "o_orderkey"),
            "part": Relation("part", "n-1", "part", "l_partkey", "p_partkey"),
            "supplier": Relation("supplier", "n-1", "supplier", "l_suppkey", "s_suppkey"),
        },
    ))
    cat.add(SchemaDef(
        "event", "events", "event_id", label="event_type",
        relations={"user": Relation("user", "n-1", "customer", "user_id", "c_custkey")},
    ))
    cat.add(SchemaDef(
        "document", "documents", "doc_id", label="doc_id",
        relations={"labels": Relation("labels", "1-1", "label", "doc_id", "doc_id")},
    ))
    cat.add(SchemaDef("label", "labels", "doc_id"))
    cat.add(SchemaDef(
        "nomenclature", "nomenclature", "id_nomenclature", unique=["type", "cd_nomenclature"],
        label="label", bounded=True,
    ))
    return cat
