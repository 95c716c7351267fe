"""Registered queries of whole imports: the inbox, a resumed run, observed counts, child tables; each with its DuckDB oracle."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import functions as F

from relata.plans.ingest import ChildSpec, FieldSpec, ImportSpec, run_import
from relata.queries import _CLEAN_COUNTS_SQL, _ORDER_PARTS_SQL, _cat, register
from relata.session import checkpoint_dir
from relata.sources.staged import customer_import_spec, staged_customers_clean, staged_order_parts
from relata.sources.tables import load_table


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def _order_lists_spec() -> ImportSpec:
    return ImportSpec("order", unique=["o_orderkey"], fields={
        "o_orderkey": FieldSpec("integer", required=True), "parts": FieldSpec(nn="part", nn_unique="p_partkey")})


# ---------------------------------------------------------------- inbox
@register("inbox_links", _ORDER_PARTS_SQL + """
SELECT l_orderkey AS o_orderkey, l_partkey AS p_partkey FROM ranked WHERE NOT (l_orderkey % 5 = 0 AND n > 1 AND rdesc = 1)
""")
def q_inbox_links(spark, sf):
    # the order lists arrive as three files: what the first two set is still there after the third
    from relata.streaming.inbox import start_inbox, store

    cat, inbox, state = _cat(spark, sf), _folder(spark, "inbox"), _folder(spark, "state")
    lists = staged_order_parts(spark, sf).drop("id_import")
    # dealt by hash: ranges would make all lists twice, once to find the bounds
    lists.repartition(3, "o_orderkey").write.options(header=True, sep=";").csv(inbox)
    runs = []
    start_inbox(spark, inbox, state, cat, _order_lists_spec(), cat.frame("order"), on_run=runs.append)
    if any(r["status"] != "DONE" for r in runs):
        raise RuntimeError(f"inbox runs: {runs}")
    return store(spark, state)[1]["parts"].select(F.col("__pk").alias("o_orderkey"), F.col("__link").alias("p_partkey"))


# ---------------------------------------------------------------- resume, counts
@register("import_resumed", _CLEAN_COUNTS_SQL.replace("SELECT (", "SELECT 'init,data_table,mapping_view,pre_check,raw_view' AS resumed, (", 1))
def q_import_resumed(spark, sf):
    # stopped after raw_view; the second run gets no source rows and goes on from the stored steps
    steps, spec, staged = _folder(spark, "steps"), customer_import_spec(), staged_customers_clean(spark, sf)
    spec.target_step = "raw_view"
    first = run_import(_cat(spark, sf), spec, staged, steps=steps)
    spec = customer_import_spec()
    r = run_import(_cat(spark, sf), spec, staged.limit(0), steps=steps)
    if (first.status, r.status) != ("PENDING", "DONE"):
        raise RuntimeError(f"import was {first.status}, then {r.status}: {r.errors.limit(5).collect()}")
    keys = ["nb_data", "nb_raw", "nb_process", "nb_insert", "nb_update", "nb_unchanged"]
    return spark.createDataFrame([(",".join(r.resumed), *(int(r.res[k]) for k in keys))],
                                 "resumed string, " + ", ".join(f"{k} long" for k in keys))


@register("stage_counts", """
SELECT 'nb_data' AS stage, (SELECT COUNT(*) FROM orders WHERE o_orderkey % 2 = 0) + (SELECT COUNT(*) FROM orders) AS n
UNION ALL SELECT 'nb_raw', 2 * (SELECT COUNT(*) FROM orders WHERE o_orderkey % 2 = 0)
UNION ALL SELECT 'nb_process', COUNT(*) FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'nb_insert', 0
""")
def q_stage_counts(spark, sf):
    # even orders staged twice, odd ones dropped by the row filter of the mapping; counts observed as the frames are kept
    o = load_table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
    both = o.withColumn("times", F.when(F.col("o_orderkey").cast("long") % 2 == 0, 2).otherwise(1))
    lines = both.withColumn("line", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    staged = lines.select((F.col("o_orderkey").cast("long") * 2 + F.col("line")).alias("id_import"), "o_orderkey", "o_orderstatus")
    spec = ImportSpec("order", unique=["o_orderkey"], where="o_orderkey % 2 = 0", target_step="import_view",
                      fields={"o_orderkey": FieldSpec("integer", required=True), "o_orderstatus": FieldSpec("string")})
    r = run_import(_cat(spark, sf), spec, staged)
    r.release()
    return spark.createDataFrame([(k, int(r.res[k])) for k in ("nb_data", "nb_raw", "nb_process", "nb_insert")], "stage string, n long")


# ---------------------------------------------------------------- child tables, creator, dump-only columns
@register("import_children", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey % 2 = 1
UNION ALL
SELECT (SELECT MAX(s_suppkey) FROM supplier) + ROW_NUMBER() OVER (ORDER BY s_nationkey, s_name), 'New ' || s_name, s_nationkey, s_acctbal
FROM supplier WHERE s_nationkey % 2 = 0
""")
def q_import_children(spark, sf):
    # lines of even nations with dotted child columns: their suppliers are replaced; lines without child cells add nothing
    s, n = load_table(spark, sf, "supplier"), load_table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select("n_nationkey", "n_name")
    child = s.join(n, s.s_nationkey == n.n_nationkey).select(
        (F.col("s_suppkey") + 100).alias("id_import"), "n_name", F.concat(F.lit("New "), "s_name").alias("suppliers.s_name"),
        F.col("s_acctbal").cast("string").alias("suppliers.s_acctbal"))
    blank = n.select((F.col("n_nationkey") + 1).cast("long").alias("id_import"), "n_name", F.lit(None).cast("string").alias("suppliers.s_name"),
                     F.lit(None).cast("string").alias("suppliers.s_acctbal"))
    spec = ImportSpec("nation", unique=["n_name"], fields={"n_name": FieldSpec("string", required=True)}, children={
        "suppliers": ChildSpec("supplier", "s_nationkey", {"s_name": FieldSpec("string", required=True), "s_acctbal": FieldSpec("number")})})
    r = run_import(_cat(spark, sf), spec, child.unionByName(blank))
    out = r.children["suppliers"].select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").checkpoint(eager=True)
    r.release()
    return out


@register("import_creator", """
SELECT c_custkey, c_name || '!' AS c_name, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 10000000, 'New#' || CAST(c_custkey AS VARCHAR), NULL, 'IMPORT' FROM customer WHERE c_custkey % 11 = 0
""")
def q_import_creator(spark, sf):
    # the creator is set on new rows alone; a dump-only column of the file is never written
    cat = _cat(spark, sf)
    cat.add(dataclasses.replace(cat.schema("customer"), dump_only=["c_acctbal"]))
    staged = staged_customers_clean(spark, sf).drop("c_nationkey", "c_mktsegment").withColumn(
        "c_name", F.when(F.col("c_name").startswith("New#"), F.col("c_name")).otherwise(F.concat("c_name", F.lit("!"))))
    spec = ImportSpec("customer", unique=["c_custkey"], creator=("c_mktsegment", "IMPORT"), fields={
        "c_custkey": FieldSpec("integer", required=True), "c_name": FieldSpec("string", required=True), "c_acctbal": FieldSpec("number")})
    r = run_import(cat, spec, staged)
    out = r.table.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").checkpoint(eager=True)
    r.release()
    return out


# ---------------------------------------------------------------- records that do not fit
@register("stage_errors", """
WITH n AS (SELECT c_custkey, c_name, ROW_NUMBER() OVER (ORDER BY c_custkey) AS line FROM customer)
SELECT line, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN 'ERR_IMPORT_DATA_LINE_CELLS' ELSE 'staged' END AS state,
       CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_name || chr(10) || 'next; line' ELSE c_name END AS name
FROM n
""")
def q_stage_errors(spark, sf):
    # every customer a record, some over two lines, some with a cell too few or too many
    from relata.sources.stage import stage_file

    k, name = F.col("c_custkey"), F.col("c_name")
    quoted = F.concat(F.lit('"'), name, F.lit('\nnext; line"'))
    line = F.concat_ws(";", k.cast("string"), F.when(k % 17 == 0, F.lit(None)).when(k % 5 == 0, quoted).otherwise(name), F.when((k % 19 == 0) & (k % 17 != 0), F.lit("more")))
    path = _folder(spark, "lines") + ".csv"
    c = load_table(spark, sf, "customer").repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")
    head = F.when(F.monotonically_increasing_id() % (1 << 33) == 0, F.concat(F.lit("key;name\n"), line)).otherwise(line)
    c.select(head.alias("value")).write.text(path)  # a header in every part
    staged = stage_file(spark, path)
    good = staged.rows.select(F.col("id_import").alias("line"), F.lit("staged").alias("state"), "name")
    return good.unionByName(staged.errors.select(F.col("lines")[0].alias("line"), F.col("error_code").alias("state"), F.lit(None).cast("string").alias("name")))


# ---------------------------------------------------------------- feature loads
def _supplier_features(spark, sf):
    """Suppliers as a JSON-lines file in key order, some rows with a fault, loaded over the suppliers."""
    from relata.plans.ingest import load_features

    s, n = load_table(spark, sf, "supplier"), load_table(spark, sf, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    row = F.to_json(F.struct(
        F.when(k % 10 != 4, k).alias("s_suppkey"), F.when(k % 2 == 0, F.concat("s_name", F.lit("*"))).alias("s_name"),
        F.when(k % 10 == 7, F.lit("Nowhere")).otherwise(F.col("n_name")).alias("s_nationkey"),
        F.when(k % 10 == 5, F.lit("much")).otherwise(F.lit("1.5")).alias("s_acctbal"), F.lit("dropped").alias("no_such_column")))
    row = F.when(k % 10 == 3, F.lit('["too", "few"]')).otherwise(row)
    path = _folder(spark, "features")
    s.join(n, s.s_nationkey == n.n_nationkey).repartitionByRange("s_suppkey").sortWithinPartitions("s_suppkey").select(row.alias("value")).write.text(path)
    spec = ImportSpec("supplier", unique=["s_suppkey"], fields={
        "s_suppkey": FieldSpec("integer", required=True), "s_name": FieldSpec("string"),
        "s_nationkey": FieldSpec(ref="nation", ref_unique=["n_name"]), "s_acctbal": FieldSpec("number")})
    group = {"code": "supplier", "file": path, "keys": list(spec.fields), "copy": {"s_nationkey": ["s_name"]}}
    r = load_features(_cat(spark, sf), [group], {"supplier": spec})["supplier"]
    if r.status != "DONE":
        raise RuntimeError(f"features: {r.errors.limit(5).collect()}")
    return r


_FAULTS = "s_suppkey % 10 IN (3, 4, 5, 7)"


@register("features_file", f"""
SELECT s_suppkey, s_nationkey, CASE WHEN {_FAULTS} THEN s_acctbal ELSE 1.5 END AS s_acctbal FROM supplier
""")
def q_features_file(spark, sf):
    # rows of the file upserted; rows with an error leave their object as it was
    r = _supplier_features(spark, sf)
    out = r.table.select("s_suppkey", "s_nationkey", "s_acctbal").checkpoint(eager=True)
    r.release()
    return out


@register("features_copy", f"""
SELECT s_suppkey, CASE WHEN {_FAULTS} THEN s_name WHEN s_suppkey % 2 = 0 THEN s_name || '*' ELSE CAST(s_nationkey AS VARCHAR) END AS s_name FROM supplier
""")
def q_features_copy(spark, sf):
    # where a row has no name the nation is copied there, resolved like the nation itself
    r = _supplier_features(spark, sf)
    out = r.table.select("s_suppkey", "s_name").checkpoint(eager=True)
    r.release()
    return out


@register("features_errors", """
WITH n AS (SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY s_suppkey) AS line FROM supplier)
SELECT line, 'ERR_FEATURE_ROW_LENGTH' AS error_code, NULL AS key FROM n WHERE s_suppkey % 10 = 3
UNION ALL SELECT line, 'ERR_IMPORT_REQUIRED', 's_suppkey' FROM n WHERE s_suppkey % 10 = 4
UNION ALL SELECT line, 'ERR_IMPORT_INVALID_VALUE_FOR_TYPE', 's_acctbal' FROM n WHERE s_suppkey % 10 = 5
UNION ALL SELECT line, 'ERR_IMPORT_UNRESOLVED', 's_nationkey' FROM n WHERE s_suppkey % 10 = 7
""")
def q_features_errors(spark, sf):
    r = _supplier_features(spark, sf)
    out = r.row_errors.select(F.col("id_import").alias("line"), "error_code", "key").checkpoint(eager=True)
    r.release()
    return out
