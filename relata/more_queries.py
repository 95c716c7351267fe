"""More registered queries: staging and sinks, mapping, recipes, deep paths, change sets; each with its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from relata.queries import (
    _BOX_SQL, _BOY_SQL, _CX, _CY, _ORDER_PARTS_SQL, _STAGED_FAULTY_SQL, _cat, _customer_points, _dist_sql, _list, _nation_areas, register)
from relata.session import checkpoint_dir
from relata.sources.tables import load_table


# ---------------------------------------------------------------- files
def _staged_customers(spark, sf):
    """Customers written as a delimited file into the shared folder, then staged."""
    from relata.sources.sinks import export_csv
    from relata.sources.stage import stage_csv

    c = load_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("C_CustKey"), "c_name", F.concat(F.lit('a;"'), "c_mktsegment", F.lit('"')).alias("quoted"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return stage_csv(spark, export_csv(c, f"{checkpoint_dir(spark)}/staged-{uuid.uuid4()}.csv", sep=";"))


@register("stage_csv", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 'a;"' || c_mktsegment || '"' AS quoted, NULLIF(c_mktsegment, 'BUILDING') AS segment
FROM customer
""")
def q_stage_csv(spark, sf):
    # delimiter found, header folded, quoted delimiters and quotes, blank -> NULL
    return _staged_customers(spark, sf).drop("id_import")


@register("stage_line_numbers", "SELECT CAST(1 AS BIGINT) AS first, COUNT(*) AS last, COUNT(*) AS n FROM customer")
def q_stage_line_numbers(spark, sf):
    return _staged_customers(spark, sf).agg(
        F.min("id_import").alias("first"), F.max("id_import").alias("last"), F.count_distinct("id_import").alias("n"))


@register("nested_json_file", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def q_nested_json_file(spark, sf):
    from relata.sources.sinks import write_nested_json

    nested = _list(spark, sf, "customer", fields=["c_custkey", "orders.o_orderkey"])
    path = write_nested_json(nested, f"{checkpoint_dir(spark)}/nested-{uuid.uuid4()}")
    back = spark.read.schema("c_custkey long, orders array<struct<o_orderkey: long>>").json(path)
    return back.select("c_custkey", F.explode("orders.o_orderkey").alias("o_orderkey"))


@register("geojson_read", """
SELECT c_custkey, CAST(5.0 AS DOUBLE) + CAST(c_custkey % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS x,
       CAST(45.0 AS DOUBLE) + CAST(c_custkey * 37 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS y FROM customer
""")
def q_geojson_read(spark, sf):
    from relata.operators import geo
    from relata.sources.sinks import geojson_features

    cat = _cat(spark, sf)
    c = cat.frame("customer")
    f = geojson_features(c.select("c_custkey", cat.schema("customer").computed["geom"](c).alias("geom")), "geom")
    g = f.select(F.get_json_object("feature", "$.properties.c_custkey").cast("long").alias("c_custkey"),
                 geo.from_geojson(F.get_json_object("feature", "$.geometry")).alias("g"))
    return g.select("c_custkey", geo.point_xy(F.col("g"))["x"].alias("x"), geo.point_xy(F.col("g"))["y"].alias("y"))


# ---------------------------------------------------------------- import steps
@register("map_fields", """
SELECT c_custkey, upper(substring(c_name, 1, 8)) || ';' AS tag, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS seg,
       json_object('c_mktsegment', c_mktsegment, 'c_nationkey', CAST(c_nationkey AS VARCHAR))::VARCHAR AS extras
FROM customer WHERE c_acctbal > 0
""")
def q_map_fields(spark, sf):
    from relata.plans.ingest import map_fields

    out = map_fields(load_table(spark, sf, "customer"), {
        "tag": "concat(upper(substring(c_name, 1, 8)), ';')", "seg": "c_mktsegment", "extras": ["c_mktsegment", "c_nationkey"],
    }, values={"seg": {"BUILDING": "B"}}, where="c_acctbal > 0")
    return out.select("c_custkey", "tag", "seg", "extras")


@register("resolve_nullable_key", "SELECT c_custkey, c_nationkey FROM customer")
def q_resolve_nullable_key(spark, sf):
    # nation 3 has no name: lines without a name resolve to it by null-safe equality
    from relata.plans.ingest import resolve_key

    cat = _cat(spark, sf)
    n = load_table(spark, sf, "nation").withColumn("n_name", F.when(F.col("n_nationkey") != 3, F.col("n_name")))
    cat.set_frame("nation", n)
    c = load_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    named = c.join(n.select("n_nationkey", "n_name"), c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("c_nationkey"))
    return resolve_key(cat, named, "c_nationkey", "nation", ["n_name"], nullable=True)


@register("lines_of", _STAGED_FAULTY_SQL + """
SELECT id_import, MIN(id_import) OVER (PARTITION BY k, c_name, nat, bad_bal, bal, c_mktsegment) AS first_line FROM staged
""")
def q_lines_of(spark, sf):
    from relata.operators.aggregates import collapse, lines_of
    from relata.sources.staged import staged_customers_faulty

    staged = staged_customers_faulty(spark, sf)
    cols = [c for c in staged.columns if c != "id_import"]
    return lines_of(staged, collapse(staged, cols), cols)


@register("natural_key_fill", """
WITH h AS (SELECT c_custkey, md5('run' || chr(1) || c_name || chr(1) || c_mktsegment) AS h FROM customer)
SELECT c_custkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-4' || substring(h, 14, 3) || '-' || substring(h, 17, 4)
       || '-' || substring(h, 21, 12) AS uid FROM h
""")
def q_natural_key_fill(spark, sf):
    from relata.plans.ingest import FieldSpec, ImportSpec, fill_natural_key

    spec = ImportSpec("customer", unique=["uid"], fields={"uid": FieldSpec("uuid", default_uuid=True)})
    return fill_natural_key(load_table(spark, sf, "customer"), spec, ["c_name", "c_mktsegment"]).select("c_custkey", "uid")


def _order_lists_import(spark, sf, emptied: bool):
    """Order lists imported without a links store: the bridge of the relation is the store."""
    from relata.plans.ingest import FieldSpec, ImportSpec, run_import
    from relata.sources.staged import staged_order_parts

    staged = staged_order_parts(spark, sf)
    if emptied:
        staged = staged.withColumn("parts", F.when(F.col("o_orderkey").cast("long") % 7 != 0, F.col("parts")))
    spec = ImportSpec("order", unique=["o_orderkey"], fields={
        "o_orderkey": FieldSpec("integer", required=True), "parts": FieldSpec(nn="part", nn_unique="p_partkey")})
    return run_import(_cat(spark, sf), spec, staged)


@register("links_default_store", _ORDER_PARTS_SQL + """
SELECT (SELECT COUNT(DISTINCT l_orderkey) FROM ranked WHERE l_orderkey % 5 = 0 AND n > 1) AS nb_update,
       (SELECT COUNT(DISTINCT l_orderkey) FROM ranked) AS nb_process, 'DONE' AS status
""")
def q_links_default_store(spark, sf):
    from relata.plans.ingest import run_record

    r = _order_lists_import(spark, sf, emptied=False)
    rec = run_record(spark, r, "run")
    r.release()
    return rec.select(F.get_json_object("res", "$.nb_update").cast("long").alias("nb_update"),
                      F.get_json_object("res", "$.nb_process").cast("long").alias("nb_process"), "status")


@register("links_emptied", _ORDER_PARTS_SQL + """
SELECT l_orderkey AS o_orderkey, l_partkey AS p_partkey FROM ranked
WHERE l_orderkey % 7 <> 0 AND NOT (l_orderkey % 5 = 0 AND n > 1 AND rdesc = 1)
""")
def q_links_emptied(spark, sf):
    r = _order_lists_import(spark, sf, emptied=True)
    checkpoint_dir(spark)
    links = r.links["parts"].select(F.col("__pk").alias("o_orderkey"), F.col("__link").alias("p_partkey")).checkpoint(eager=True)
    r.release()  # the result is written
    return links


# ---------------------------------------------------------------- deep paths
@register("nested_two_levels", """
WITH page AS (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 50)
SELECT c_custkey, string_agg(DISTINCT o_orderkey, ',' ORDER BY o_orderkey) AS orders, string_agg(l_partkey, ',' ORDER BY l_partkey) AS parts
FROM page LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey
""")
def q_nested_two_levels(spark, sf):
    out = _list(spark, sf, "customer", fields=["c_custkey", "orders.o_orderkey", "orders.lineitems.l_partkey"], sort="c_custkey-", page_size=50)
    parts = F.array_sort(F.flatten(F.transform("orders", lambda o: F.coalesce(o["lineitems"]["l_partkey"], F.array().cast("array<bigint>")))))

    def text(a):
        return F.when(F.size(a) > 0, F.array_join(a.cast("array<string>"), ","))

    return out.select("c_custkey", text(F.array_sort(F.col("orders.o_orderkey"))).alias("orders"), text(parts).alias("parts"))


@register("nested_below_to_one", """
WITH page AS (SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 20)
SELECT s_suppkey, COUNT(c_custkey) AS n, MIN(c_custkey) AS low, MAX(c_custkey) AS high
FROM page LEFT JOIN customer ON c_nationkey = s_nationkey GROUP BY s_suppkey
""")
def q_nested_below_to_one(spark, sf):
    out = _list(spark, sf, "supplier", fields=["s_suppkey", "nation.customers.c_custkey"], sort="s_suppkey", page_size=20)
    keys = F.coalesce(F.col("nation__customers.c_custkey"), F.array().cast("array<bigint>"))
    return out.select("s_suppkey", F.size(keys).cast("long").alias("n"), F.array_min(keys).alias("low"), F.array_max(keys).alias("high"))


@register("sort_two_hops", """
SELECT r_regionkey, r_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
GROUP BY r_regionkey, r_name ORDER BY MAX(c_acctbal) DESC NULLS LAST, r_regionkey LIMIT 3
""")
def q_sort_two_hops(spark, sf):
    return _list(spark, sf, "region", fields=["r_regionkey", "r_name"], sort="nations.customers.c_acctbal-", page_size=3)


@register("export_below_to_one", """
SELECT o_orderkey, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN events ON user_id = c_custkey GROUP BY o_orderkey
""")
def q_export_below_to_one(spark, sf):
    from relata.plans.exports import export_view_of

    return export_view_of(_cat(spark, sf), "order", ["o_orderkey", "customer.events.event_type"], names={"customer.events.event_type": "types"})


# ---------------------------------------------------------------- functions, sets, changes
@register("more_functions", """
SELECT c_custkey, md5('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS hash,
       concat_ws('-', NULLIF(c_mktsegment, 'BUILDING'), c_name) AS label,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE c_mktsegment || ',BUILDING' END AS merged,
       c_mktsegment = 'MACHINERY' AS has_machinery,
       TIMESTAMP '2024-01-02 03:04:05' AS created, TIMESTAMP '2024-01-02 03:04:05' AS updated
FROM customer
""")
def q_more_functions(spark, sf):
    from relata.functions.text import concat0
    from relata.functions.types import row_hash
    from relata.operators.changes import stamp
    from relata.operators.sets import merge_lists

    seg = F.col("c_mktsegment")
    merged = merge_lists(F.array(seg, F.lit("BUILDING")), F.array(seg))
    c = load_table(spark, sf, "customer").select(
        "c_custkey", row_hash(F.col("c_custkey"), F.col("c_name")).alias("hash"),
        concat0(F.nullif(seg, F.lit("BUILDING")), F.col("c_name"), sep="-").alias("label"),
        F.array_join(merged, ",").alias("merged"), F.array_contains(merged, "MACHINERY").alias("has_machinery"))
    return stamp(c, "created", "updated", "2024-01-02 03:04:05")


@register("top_per_group", """
SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
WHERE rn <= 2
""")
def q_top_per_group(spark, sf):
    from relata.operators.ordering import top_per_group

    top = top_per_group(load_table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 2)
    return top.select("o_custkey", "o_orderkey")


@register("is_changed", """
SELECT c_custkey, c_custkey % 7 = 0 AS record, c_mktsegment <> 'BUILDING' AS list FROM customer
""")
def q_is_changed(spark, sf):
    # a record with another balance, a list with another element; the same list in another order is no change
    from relata.operators.changes import is_changed

    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    c = load_table(spark, sf, "customer").select(
        "c_custkey", F.struct("c_name", "c_acctbal").alias("r0"),
        F.struct("c_name", F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal")).alias("r1"),
        F.array("c_name", seg).alias("l0"), F.array(F.lit("BUILDING"), "c_name").alias("l1"))
    t = {f.name: f.dataType for f in c.schema.fields}
    return c.select("c_custkey", is_changed(F.col("r0"), F.col("r1"), t["r0"]).alias("record"), is_changed(F.col("l0"), F.col("l1"), t["l0"]).alias("list"))


@register("cascade_delete", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 13 <> 0")
def q_cascade_delete(spark, sf):
    from relata.operators.changes import cascade_delete

    left = load_table(spark, sf, "customer").filter(F.col("c_custkey") % 13 != 0)
    return cascade_delete(load_table(spark, sf, "orders"), "o_custkey", left, "c_custkey").select("o_orderkey")


# ---------------------------------------------------------------- sibling branches of a filter
@register("filter_sibling_branches", """
SELECT s_suppkey FROM supplier WHERE EXISTS (
  SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = c_custkey
  WHERE c_nationkey = s_nationkey AND o_totalprice > 400000 AND event_type = 'purchase' AND value > 150)
""")
def q_filter_sibling_branches(spark, sf):
    # one customer of the supplier's nation has both: a large order and a large purchase
    return _list(spark, sf, "supplier", fields=["s_suppkey"], filters=(
        "nation.customers.orders.o_totalprice > 400000,nation.customers.events.event_type = purchase,nation.customers.events.value > 150"))


# ---------------------------------------------------------------- exact spatial predicates
_XY_SQL = f"(SELECT c_custkey AS pid, {_CX} AS x, {_CY} AS y FROM customer)"
_AREAS_SQL = f"(SELECT n_nationkey AS aid, {_BOX_SQL} AS b_x, {_BOY_SQL} AS b_y FROM nation)"


def _customer_shapes(spark, sf, kind, vertices):
    """Customers as lines or polygons: ``vertices(x, y)`` gives the corners."""
    from relata.operators import geo

    ring = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in vertices(F.col("x"), F.col("y"))))
    return _customer_points(spark, sf).select("pid", geo.make_geom(F.lit(kind), F.lit(4326), F.array(F.array(ring))).alias("geom"))


@register("lines_in_areas", f"""
SELECT pid, aid FROM {_XY_SQL}, {_AREAS_SQL}
WHERE y > b_y + 1e-9 AND y < b_y + 0.2 - 1e-9 AND x + 0.3 > b_x + 1e-9 AND x < b_x + 0.2 - 1e-9
""")
def q_lines_in_areas(spark, sf):
    from relata.operators import geo

    lines = _customer_shapes(spark, sf, "LINESTRING", lambda x, y: [(x, y), (x + 0.3, y)])
    return geo.link_areas(lines, _nation_areas(spark, sf), 0.1, aid="aid", agg="geom")


@register("polygons_in_areas", f"""
SELECT pid, aid FROM {_XY_SQL}, {_AREAS_SQL}
WHERE y + 0.07 > b_y + 1e-9 AND y < b_y + 0.2 - 1e-9 AND x + 0.3 > b_x + 1e-9 AND x < b_x + 0.2 - 1e-9
""")
def q_polygons_in_areas(spark, sf):
    from relata.operators import geo

    boxes = _customer_shapes(spark, sf, "POLYGON", lambda x, y: [(x, y), (x, y + 0.07), (x + 0.3, y + 0.07), (x + 0.3, y), (x, y)])
    return geo.link_areas(boxes, _nation_areas(spark, sf), 0.1, aid="aid", agg="geom")


@register("bbox_lines", f"""
SELECT pid FROM {_XY_SQL}
WHERE GREATEST(5.2005 - x, 45.2003 - y, 0) <= LEAST(5.4007 - x, 45.5009 - y, 0.3)
""")
def q_bbox_lines(spark, sf):
    from relata.operators import geo

    lines = _customer_shapes(spark, sf, "LINESTRING", lambda x, y: [(x, y), (x + 0.3, y + 0.3)])
    return lines.filter(geo.filter_atom(F.col("geom"), "bbox", "5.2005;45.2003;5.4007;45.5009", None)).select("pid")


@register("dwithin_lines", f"""
SELECT pid FROM {_XY_SQL} WHERE {_dist_sql('LEAST(GREATEST(CAST(5.5 AS DOUBLE), x), x + 0.3)', 'y', 'CAST(5.5 AS DOUBLE)', 'CAST(45.5 AS DOUBLE)')} <= 20000
""")
def q_dwithin_lines(spark, sf):
    from relata.operators import geo

    lines = _customer_shapes(spark, sf, "LINESTRING", lambda x, y: [(x, y), (x + 0.3, y)])
    return lines.filter(geo.filter_atom(F.col("geom"), "dwithin", "5.5;45.5;20000", None)).select("pid")


# ---------------------------------------------------------------- recipes (R-1 to R-8)
@register("recipe_railways", """
SELECT CAST(o_orderkey AS VARCHAR) AS linear_code, 'C' || c_custkey AS groups, 'C' || c_custkey || ' ' || o_orderkey AS linear_name,
       CASE WHEN o_orderkey % 4 = 0 THEN 'VF_LGV' ELSE 'VF_P' END AS id_type
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 <> 3 AND o_orderkey % 20 <= 10
""")
def q_recipe_railways(spark, sf):
    # customers as railway lines 200 m apart, orders as segments 0 to 19 m beside the line of their customer
    from relata.plans import recipes

    def line(*xy):
        return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in xy))

    k, o = F.col("c_custkey"), F.col("o_orderkey")
    c = load_table(spark, sf, "customer").withColumn("code_ligne", F.concat(F.lit("C"), k.cast("string")))
    status = c.select("code_ligne", F.col("c_name").alias("lib_ligne"), line((k * 200, F.lit(0)), (k * 200 + 50, F.lit(0))).alias("line"))
    kinds = c.select("code_ligne", F.when(k % 3 == 0, F.lit(recipes.RAIL_HIGH_SPEED)).otherwise(F.col("c_mktsegment")).alias("catlig"))
    natures = F.array(F.lit("LGV"), F.lit("Voie de service"), F.lit("Voie ferrée principale"), F.lit("Autre"))
    at = F.col("o_custkey") * 200 + 25
    segments = load_table(spark, sf, "orders").select(
        o.alias("gid"), o.cast("string").alias("id"), F.get(natures, (o % 4).cast("int")).alias("nature"), line((at, o % 20), (at, o % 20 + 5)).alias("line"))
    return recipes.railways(status, kinds, segments, r=10.0)[1].select("linear_code", "groups", "linear_name", "id_type")


@register("recipe_routes", """
SELECT substring('AND', CAST(c_custkey // 2 % 3 AS INT) + 1, 1) || CAST(c_custkey // 2 AS VARCHAR) AS code,
       CASE c_custkey // 2 % 3 WHEN 0 THEN 'RT_AUT' WHEN 1 THEN 'RT_NAT' ELSE 'RT_DEP' END AS id_type, COUNT(*) AS n_parts
FROM customer GROUP BY c_custkey // 2
""")
def q_recipe_routes(spark, sf):
    # two route tables that share some rows: pairs of customers make one route
    from relata.operators import geo
    from relata.plans.recipes import route_summary

    k = F.floor(F.col("pid") / 2)
    number = F.concat(F.substring(F.lit("AND"), (k % 3 + 1).cast("int"), F.lit(1)), F.lit(" "), k.cast("string"))
    routes = _customer_points(spark, sf).select("pid", number.alias("numero"), geo.make_point(F.col("x"), F.col("y")).alias("geom"))
    merged = route_summary(routes.filter("pid % 5 <> 0"), routes.filter("pid % 5 = 0 OR pid % 3 = 0"))
    return merged.select("code", "id_type", "n_parts")


@register("recipe_roads", """
WITH nm AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'D' || c_custkey || ' (' || n_regionkey || ')' ELSE 'D' || c_custkey END AS dept
            FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
seg AS (SELECT o_orderkey // 2 AS id, arg_min(o_custkey, o_orderkey) AS o_custkey, MIN(o_orderkey) AS gid FROM orders GROUP BY 1)
SELECT CASE WHEN gid % 2 = 0 THEN 'RT_NAT' ELSE 'RT_DEP' END AS id_type, 'TRONROUT000000' || id AS linear_code,
       dept || ' TR ' || id AS linear_name, dept AS groups
FROM seg JOIN nm ON c_custkey = o_custkey
""")
def q_recipe_roads(spark, sf):
    # orders as road segments (two lines an id), customers as the named roads they belong to, nations as the areas
    from relata.plans import recipes

    k = F.col("o_orderkey")
    seg = load_table(spark, sf, "orders").select(
        k.alias("gid"), F.concat(F.lit(recipes.SEGMENT_ID_PREFIX), F.floor(k / 2).cast("string")).alias("id"), F.col("o_custkey").cast("string").alias("id_rn"),
        F.when(k % 2 == 0, F.lit("Nationale")).otherwise(F.lit("Départementale")).alias("cl_admin"), F.lit(7.0).alias("largeur"), F.lit(None).cast("string").alias("geom"))
    c, n = load_table(spark, sf, "customer"), load_table(spark, sf, "nation")
    key = F.col("c_custkey")
    kind = F.when(key % 3 == 0, F.lit("Départementale")).when(key % 3 == 1, F.lit("Nationale")).otherwise(F.lit("Autoroute"))
    names = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        key.alias("gid"), key.cast("string").alias("id"), F.concat(F.lit("D"), key.cast("string")).alias("numero"),
        kind.alias("type_route"), F.col("n_name").alias("gestion"))
    areas = n.select(F.col("n_name").alias("area_name"), F.col("n_regionkey").cast("string").alias("area_code"))
    return recipes.roads(seg, names, areas)[1].select("id_type", "linear_code", "linear_name", "groups")


@register("recipe_waterways", """
WITH pairs AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT o_orderkey AS id, COALESCE((SELECT string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) FROM pairs JOIN part ON p_partkey = l_partkey
       WHERE l_orderkey = o_orderkey), o_orderpriority) AS name FROM orders
""")
def q_recipe_waterways(spark, sf):
    from relata.plans.recipes import waterways

    li = load_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("p")).distinct()
    lists = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list("p"), "/").alias("id_ce"))
    o = load_table(spark, sf, "orders")
    seg = o.join(lists, o.o_orderkey == lists.l_orderkey, "left").select(F.col("o_orderkey").alias("id"), "id_ce", F.col("o_orderpriority").alias("nom"))
    rivers = load_table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("toponyme"))
    return waterways(seg, rivers)


@register("recipe_markers", """
SELECT id, numero, dept, json_object('numero', numero)::VARCHAR AS extras FROM (
  SELECT c_custkey // 2 AS id, arg_min(c_name, c_custkey) AS numero, arg_min(c_mktsegment, c_custkey) AS type, arg_min(c_nationkey, c_custkey) AS nk
  FROM customer GROUP BY 1) m LEFT JOIN (SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS dept FROM nation) n ON n_nationkey = nk
WHERE type IN ('BUILDING', 'MACHINERY')
""")
def q_recipe_markers(spark, sf):
    from relata.functions.text import json_of
    from relata.operators import geo
    from relata.plans.recipes import markers

    c, n = load_table(spark, sf, "customer"), load_table(spark, sf, "nation")
    pts = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias("gid"), F.floor(F.col("c_custkey") / 2).cast("long").alias("id"), F.col("c_name").alias("numero"),
        F.lit("D").alias("cote"), F.col("c_mktsegment").alias("type"), F.col("n_name").alias("dept_name"), geo.make_point(F.lit(5.0), F.lit(45.0)).alias("geom"))
    areas = n.select(F.col("n_name").alias("area_name"), F.col("n_regionkey").cast("string").alias("area_code"))
    return markers(pts, areas, ["BUILDING", "MACHINERY"]).select("id", "numero", "dept", json_of(["numero"]).alias("extras"))


@register("recipe_observations", """
SELECT 'o' || c_custkey AS id_obs, o_orderkey AS cd_nom, CASE WHEN c_custkey % 2 = 0 THEN 'exact' ELSE 'unknown' END AS precision
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority <> '1-URGENT'
""")
def q_recipe_observations(spark, sf):
    from relata.plans.recipes import observations

    k = F.col("c_custkey")
    g = load_table(spark, sf, "customer").select(k, F.concat(F.lit("o"), k.cast("string")).alias("id_obs"), F.lit("g").alias("geom"),
                                                 F.when(k % 2 == 0, F.lit("exact")).alias("precision"))
    d = load_table(spark, sf, "orders").select(
        F.concat(F.lit("o"), F.col("o_custkey").cast("string"), F.lit("."), F.col("o_orderkey").cast("string")).alias("id_obs"),
        F.col("o_orderkey").alias("cd_nom"), (F.col("o_orderpriority") == "1-URGENT").alias("sensitive"), F.col("o_totalprice").alias("altitude"))
    return observations(*[g.filter(k % 3 == i) for i in range(3)], d).select("id_obs", "cd_nom", "precision")


@register("recipe_reassign", """
SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN 'R1' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def q_recipe_reassign(spark, sf):
    from relata.plans.recipes import reassign

    c = load_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load_table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("R1").alias("seg"))
    return reassign(c, n, ["c_nationkey"], "c_mktsegment", "seg").select("c_custkey", "c_mktsegment")


@register("recipe_profile", """
SELECT 'frequency' AS kind, o_orderpriority AS value, COUNT(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'duplicated', CAST(o_custkey AS VARCHAR), COUNT(*) FROM orders GROUP BY 2 HAVING COUNT(*) > 1
UNION ALL SELECT 'unmatched', 'orders', COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def q_recipe_profile(spark, sf):
    from relata.plans.recipes import profile

    known = load_table(spark, sf, "customer").filter("c_acctbal > 0")
    p = profile(load_table(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", known, "c_custkey")
    freq = p["frequencies"].select(F.lit("frequency").alias("kind"), F.col("o_orderpriority").alias("value"), "n")
    dup = p["duplicated_keys"].select(F.lit("duplicated").alias("kind"), F.col("o_custkey").cast("string").alias("value"), "n")
    un = p["unmatched"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("unmatched").alias("kind"), F.lit("orders").alias("value"), "n")
    return freq.unionByName(dup).unionByName(un)


# ---------------------------------------------------------------- many conditions, siblings below a to-one hop
_FORTY_SQL = "l_orderkey = o_orderkey AND l_quantity IN (" + ", ".join(map(str, range(1, 41))) + ") AND o_orderkey > l_quantity * 100"


@register("filter_forty_conditions", f"""
SELECT 'or' AS form, o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE {_FORTY_SQL})
UNION ALL
SELECT 'not', o_orderkey FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT ({_FORTY_SQL}))
   OR (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND o_orderkey <= 100)
""")
def q_filter_forty_conditions(spark, sf):
    ored = ",|,".join(f"[,lineitems.l_quantity = {i},*,o_orderkey > {i * 100},]" for i in range(1, 41))
    forms = {"or": ored, "not": f"!,[,{ored},]"}
    found = [_list(spark, sf, "order", fields=["o_orderkey"], filters=f).select(F.lit(form).alias("form"), "o_orderkey") for form, f in forms.items()]
    return found[0].unionByName(found[1])


@register("filter_siblings_below_to_one", """
SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)
  AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n_nationkey AND s.s_acctbal < 2000) AND l_linenumber = 1
""")
def q_filter_siblings_below_to_one(spark, sf):
    # lines of an order whose supplier's nation has both a rich customer and a poor supplier
    out = _list(spark, sf, "lineitem", fields=["l_orderkey", "l_linenumber"],
                filters="supplier.nation.customers.c_acctbal > 9000,supplier.nation.suppliers.s_acctbal < 2000,l_linenumber = 1")
    return out.select("l_orderkey", "l_linenumber").distinct()
