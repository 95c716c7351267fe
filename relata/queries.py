"""Registered queries (one per operator family of the survey) and their DuckDB oracles.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  ``ORACLES[name]`` is the same result in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.session import checkpoint_dir

from relata.plans.list_query import ListQuery
from relata.sources.tables import driver_catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def _cat(spark: SparkSession, sf: str):
    return driver_catalog(spark, sf)


# ---------------------------------------------------------------- list query
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    q = ListQuery(
        _cat(spark, sf), "customer",
        fields=["c_custkey", "c_name", "nation.n_name", "nation.region.r_name", "c_acctbal"],
        filters="nation.region.r_name = ASIA,c_acctbal > 1000",
        sort="c_acctbal-", page_size=20,
    )
    return q.build()


register("list_customer_path", """
SELECT c.c_custkey, c.c_name, n.n_name AS nation__n_name, r.r_name AS nation__region__r_name, c.c_acctbal
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name = 'ASIA' AND c.c_acctbal > 1000
ORDER BY c.c_acctbal DESC NULLS LAST, c.c_custkey LIMIT 20
""")(flagship)


def _list(spark, sf, code, **kw) -> DataFrame:
    return ListQuery(_cat(spark, sf), code, **kw).build()


# ---------------------------------------------------------------- filters
@register("filter_bool_mix", """
SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer
WHERE ((CAST(c_nationkey AS VARCHAR) IN ('1','2','3') OR c_acctbal < 0) AND NOT (c_mktsegment = 'HOUSEHOLD'))
   OR c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 9900
""")
def q_filter_bool_mix(spark, sf):
    # left-associative, no precedence: ((A | B) * !C) | D * E  ==  (((A|B) & !C) | D) & E
    return _list(spark, sf, "customer", fields=["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"],
                 filters="[,[,c_nationkey in 1;2;3,|,c_acctbal < 0,],!,c_mktsegment = HOUSEHOLD,],|,[,c_mktsegment = AUTOMOBILE,*,c_acctbal > 9900,]")


_UNACCENT_SQL = "replace(replace(replace(replace(replace(strip_accents({c}), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'), 'ß', 'ss')"


@register("filter_text_unaccent", f"""
SELECT doc_id, lang FROM documents
WHERE {_UNACCENT_SQL.format(c='text')} ILIKE '%iess%' AND {_UNACCENT_SQL.format(c='text')} ILIKE '%ete%'
""")
def q_filter_text_unaccent(spark, sf):
    # '~': every word, accent- and case-insensitive ('ß' searches as 'ss', 'É' as 'e')
    return _list(spark, sf, "document", fields=["doc_id", "lang"], filters="text ~ iEß Été")


@register("filter_like_unaccent", f"""
SELECT doc_id, lang FROM documents
WHERE {_UNACCENT_SQL.format(c='text')} LIKE '%ene\\_%' ESCAPE '\\' OR {_UNACCENT_SQL.format(c='text')} ILIKE 'en%'
""")
def q_filter_like_unaccent(spark, sf):
    # like: value without % is wrapped and '_' escaped; ilike with % used as is
    return _list(spark, sf, "document", fields=["doc_id", "lang"], filters="text like ene_,|,text ilike en%")


@register("filter_not_equal_text", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE CAST(c_nationkey AS VARCHAR) != '3' AND c_mktsegment != 'BUILDING' AND c_acctbal >= 9000
""")
def q_filter_not_equal_text(spark, sf):
    return _list(spark, sf, "customer", fields=["c_custkey", "c_mktsegment"], filters=[
        {"field": "c_nationkey", "type": "!=", "value": 3},
        {"field": "c_mktsegment", "type": "!=", "value": "BUILDING"},
        {"field": "c_acctbal", "type": ">=", "value": 9000},
    ])


@register("filter_to_many_path", """
SELECT c.c_custkey, c.c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)
""")
def q_filter_to_many_path(spark, sf):
    return _list(spark, sf, "customer", fields=["c_custkey", "c_name"], filters="orders.o_totalprice > 450000")


@register("filter_same_child_row", """
SELECT c.c_custkey FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
              AND (c.c_acctbal > 9000 OR o.o_orderstatus = 'F') AND o.o_totalprice < 5000)
""")
def q_filter_same_child_row(spark, sf):
    # one joined row must satisfy the whole expression (base and child columns mixed)
    return _list(spark, sf, "customer", fields=["c_custkey"],
                 filters="c_acctbal > 9000,|,orders.o_orderstatus = F,*,orders.o_totalprice < 5000")


@register("filter_negated_path", """
SELECT o.o_orderkey FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND NOT (l.l_returnflag = 'R')
              AND (NOT (l.l_quantity = 50 AND l.l_quantity > 0) OR o.o_orderkey < 0))
  AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def q_filter_negated_path(spark, sf):
    # '! lineitems.l_returnflag = R' keeps an order having any other line; both conditions on
    # lineitems must hold on the same joined line (row-matching rule)
    return _list(spark, sf, "order", fields=["o_orderkey"], filters=[
        "!,lineitems.l_returnflag = R",
        "o_orderpriority in 1-URGENT;2-HIGH",
        ["!", [{"field": "lineitems.l_quantity", "type": "=", "value": 50}, "*", {"field": "lineitems.l_quantity", "type": ">", "value": 0}], "|", "o_orderkey < 0"],
    ])


@register("filter_null_path", """
SELECT o.o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
   OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag IS NULL)
""")
def q_filter_null_path(spark, sf):
    # '= None' on a to-many column is true on the empty joined row: objects without lines
    return _list(spark, sf, "order", fields=["o_orderkey"],
                 filters=[{"field": "lineitems.l_returnflag", "type": "=", "value": None}])


@register("filter_any", """
SELECT o.o_orderkey, o.o_orderstatus FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AND o.o_orderstatus = 'P'
""")
def q_filter_any(spark, sf):
    return _list(spark, sf, "order", fields=["o_orderkey", "o_orderstatus"], filters="lineitems any,o_orderstatus = P")


@register("filter_not_any", """
SELECT o.o_orderkey, o.o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
""")
def q_filter_not_any(spark, sf):
    return _list(spark, sf, "order", fields=["o_orderkey", "o_custkey"], filters="!,has_lineitems")


@register("filter_any_in_or", """
SELECT o.o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) OR o.o_totalprice > 480000
""")
def q_filter_any_in_or(spark, sf):
    return _list(spark, sf, "order", fields=["o_orderkey"], filters="!,lineitems any,|,o_totalprice > 480000")


@register("filter_nn_path", """
SELECT o.o_orderkey FROM orders o
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b JOIN part p ON p.p_partkey = b.l_partkey
              WHERE b.l_orderkey = o.o_orderkey AND p.p_brand = 'Brand#7' AND p.p_size > 45)
""")
def q_filter_nn_path(spark, sf):
    return _list(spark, sf, "order", fields=["o_orderkey"], filters="parts.p_brand = Brand#7,parts.p_size > 45")


@register("filter_deep_path", """
SELECT r.r_name FROM region r
WHERE EXISTS (SELECT 1 FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey
              WHERE n.n_regionkey = r.r_regionkey AND c.c_acctbal < -990)
""")
def q_filter_deep_path(spark, sf):
    # region -> nations (1-n) -> customers (1-n): two to-many hops inside one relation frame
    return _list(spark, sf, "region", fields=["r_name"], filters="nations.customers.c_acctbal < -990")


# ---------------------------------------------------------------- projections
@register("nested_orders", """
WITH page AS (
  SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 20)
SELECT p.c_custkey, COUNT(o.o_orderkey) AS n_orders,
       string_agg(CAST(o.o_orderkey AS VARCHAR), ',' ORDER BY o.o_orderkey) AS order_keys,
       ROUND(SUM(o.o_totalprice), 2) AS total_price
FROM page p LEFT JOIN orders o ON o.o_custkey = p.c_custkey GROUP BY p.c_custkey
""")
def q_nested_orders(spark, sf):
    df = ListQuery(_cat(spark, sf), "customer", fields=["c_custkey", "orders.o_orderkey", "orders.o_totalprice"],
                   sort="c_acctbal-", page=3, page_size=10).build()
    o = F.col("orders")
    return df.select(
        "c_custkey",
        F.coalesce(F.size(o), F.lit(0)).cast("long").alias("n_orders"),
        F.array_join(F.transform(o, lambda x: x["o_orderkey"].cast("string")), ",").alias("order_keys"),
        F.round(F.aggregate(o, F.lit(0.0), lambda a, x: a + x["o_totalprice"]), 2).alias("total_price"),
    )


@register("label_list", """
SELECT o.o_orderkey, (SELECT string_agg(DISTINCT p.p_brand, ', ' ORDER BY p.p_brand)
                      FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_orderkey = o.o_orderkey) AS brands
FROM orders o
""")
def q_label_list(spark, sf):
    from relata.operators.relations import related_labels

    cat = _cat(spark, sf)
    df = cat.frame("order").select("o_orderkey")
    return related_labels(cat, "order", df, "parts", "p_brand", "brands", distinct=True)


@register("concat_template", """
SELECT e.event_id, CASE WHEN c.c_custkey IS NOT NULL THEN concat(e.event_type, ' by ', c.c_name) END AS title
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
""")
def q_concat_template(spark, sf):
    from relata.operators.relations import concat_template

    cat = _cat(spark, sf)
    df = concat_template(cat, "event", cat.frame("event"), "<event_type> by <user.c_name>", "title")
    return df.select("event_id", "title")


@register("json_field", """
SELECT event_id, json_extract_string(props, '$.k') AS props__k, user_id, c.c_mktsegment AS user__c_mktsegment
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'purchase'
""")
def q_json_field(spark, sf):
    return _list(spark, sf, "event", fields=["event_id", "props.k", "user_id", "user.c_mktsegment"], filters="event_type = purchase")


@register("default_fields", """
SELECT s.s_suppkey, n.n_nationkey AS nation__n_nationkey, n.n_name AS nation__n_name
FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
""")
def q_default_fields(spark, sf):
    # a relation asked for without a sub-field gives its default fields
    return _list(spark, sf, "supplier", fields=["s_suppkey", "nation", "no_such_field"])


# ---------------------------------------------------------------- sort, page, row numbers
@register("natural_sort_page", """
SELECT p_partkey, p_brand, p_size FROM part
ORDER BY NULLIF(regexp_extract(p_brand, '[a-zA-Z]+'), '') NULLS LAST,
         CAST(NULLIF(regexp_extract(p_brand, '[0-9]+'), '') AS DECIMAL(38,0)) NULLS LAST,
         p_brand NULLS LAST, p_size DESC NULLS LAST, p_partkey
LIMIT 30 OFFSET 60
""")
def q_natural_sort_page(spark, sf):
    return _list(spark, sf, "part", fields=["p_partkey", "p_brand", "p_size"], sort="p_brand*,p_size-", page=3, page_size=30)


@register("natural_sort_digits_first", """
SELECT c_custkey, c_name FROM customer
ORDER BY CAST(NULLIF(regexp_extract(c_name, '[0-9]+'), '') AS DECIMAL(38,0)) DESC NULLS LAST,
         NULLIF(regexp_extract(c_name, '[a-zA-Z]+'), '') DESC NULLS LAST, c_name DESC NULLS LAST, c_custkey
LIMIT 15
""")
def q_natural_sort_digits_first(spark, sf):
    return _list(spark, sf, "customer", fields=["c_custkey", "c_name"], sort="c_name%-", page_size=15)


@register("sort_relation_path", """
SELECT o.o_orderkey, c.c_mktsegment AS customer__c_mktsegment FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
ORDER BY c.c_mktsegment NULLS LAST, c.c_acctbal DESC NULLS LAST, o.o_orderkey LIMIT 25 OFFSET 100
""")
def q_sort_relation_path(spark, sf):
    return _list(spark, sf, "order", fields=["o_orderkey", "customer.c_mktsegment"],
                 sort="customer.c_mktsegment,customer.c_acctbal-", page=5, page_size=25)


@register("page_info", """
SELECT 2 AS page, 25 AS page_size, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE c_acctbal > 5000 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')) AS filtered,
       CAST(CEIL(COUNT(*) / 25.0) AS BIGINT) AS last_page,
       CAST(CEIL(COUNT(*) FILTER (WHERE c_acctbal > 5000 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')) / 25.0) AS BIGINT) AS last_page_filtered
FROM customer c WHERE c_mktsegment = 'BUILDING'
""")
def q_page_info(spark, sf):
    return ListQuery(_cat(spark, sf), "customer", prefilters="c_mktsegment = BUILDING",
                     filters="c_acctbal > 5000,orders.o_orderstatus = P", page=2, page_size=25).info()


@register("page_of_row", """
SELECT pk, row_number, CAST(CEIL(row_number / 25.0) AS BIGINT) AS page FROM (
  SELECT c_custkey AS pk, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS row_number
  FROM customer WHERE c_mktsegment = 'MACHINERY') t
WHERE pk = (SELECT MIN(c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey >= (SELECT MAX(c_custkey) / 2 FROM customer))
""")
def q_page_of_row(spark, sf):
    return ListQuery(_cat(spark, sf), "customer", filters="c_mktsegment = MACHINERY", sort="c_acctbal-", page_size=25).page_of(
        _machinery_target(spark, sf))


def _machinery_target(spark, sf):
    """The MACHINERY customer with the smallest key at or above half the largest key (exists at every scale)."""
    from relata.sources.tables import load_table

    c = load_table(spark, sf, "customer")
    half = c.agg((F.max("c_custkey") / 2).alias("h")).first()["h"]  # one value
    return c.filter((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_custkey") >= F.lit(half))).agg(F.min("c_custkey")).first()[0]


@register("global_row_number", """
SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS row_number
FROM orders
""")
def q_global_row_number(spark, sf):
    return _list(spark, sf, "order", fields=["o_orderkey", "o_totalprice", "row_number"], sort="o_totalprice-")


@register("page_row_number", """
SELECT o_orderkey, row_number FROM (
  SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS row_number FROM orders)
WHERE row_number BETWEEN 41 AND 60
""")
def q_page_row_number(spark, sf):
    return _list(spark, sf, "order", fields=["o_orderkey", "row_number"], sort="o_orderdate-", page=3, page_size=20)


@register("lookup_label", f"""
SELECT c_custkey, c_name FROM customer WHERE {_UNACCENT_SQL.format(c='c_name')} ILIKE '%00000012%'
ORDER BY c_name NULLS LAST, c_custkey LIMIT 10
""")
def q_lookup_label(spark, sf):
    from relata.plans.list_query import lookup

    return lookup(_cat(spark, sf), "customer", "00000012", k=10)


# ---------------------------------------------------------------- scope
_SCOPE_SQL = """CASE WHEN o.o_custkey = 42 THEN 1
     WHEN EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
                  WHERE l.l_orderkey = o.o_orderkey AND s.s_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 42)) THEN 2
     ELSE 3 END"""


@register("scope_levels", f"SELECT o.o_orderkey, {_SCOPE_SQL} AS scope FROM orders o")
def q_scope_levels(spark, sf):
    return _list(spark, sf, "order", fields=["o_orderkey", "scope"], user=42)


@register("scope_filter", f"SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE {_SCOPE_SQL} <= 2")
def q_scope_filter(spark, sf):
    return _list(spark, sf, "order", fields=["o_orderkey", "o_custkey"], user=42, allowed_scope=2)


@register("scope_customer_user", """
SELECT c_custkey FROM customer WHERE c_custkey = 42 OR c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 42)
""")
def q_scope_customer_user(spark, sf):
    return _list(spark, sf, "customer", fields=["c_custkey"], user=42, allowed_scope=2)


@register("scope_inherited", f"""
SELECT scope, COUNT(*) AS n_lines FROM (
  SELECT {_SCOPE_SQL} AS scope FROM lineitem l0 JOIN orders o ON o.o_orderkey = l0.l_orderkey) GROUP BY scope
""")
def q_scope_inherited(spark, sf):
    from relata.operators.scope import inherit_scope

    cat = _cat(spark, sf)
    li = inherit_scope(cat, "order", cat.frame("lineitem").select("l_orderkey"), "l_orderkey", 42)
    return li.groupBy("scope").agg(F.count(F.lit(1)).alias("n_lines"))


@register("sensitive_filter", """
SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderpriority != '1-URGENT' AND o_orderstatus = 'O' GROUP BY o_orderpriority
""")
def q_sensitive_filter(spark, sf):
    q = ListQuery(_cat(spark, sf), "order", prefilters="o_orderstatus = O", sensitive_only=True)
    return q.total_frame().groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- import: checks, resolution, counts
_STAGED_FAULTY_SQL = """
WITH base AS (
  SELECT c.c_custkey AS k, c.c_custkey * 2 + 1 AS id_import,
         CASE WHEN c.c_custkey % 89 = 5 THEN NULL ELSE c.c_name END AS c_name,
         CASE WHEN c.c_custkey % 101 = 7 THEN 'NATION_X' ELSE n.n_name END AS nat,
         CASE WHEN c.c_custkey % 97 = 3 THEN 'n/a' || CAST(c.c_custkey % 3 AS VARCHAR) END AS bad_bal,
         CASE WHEN c.c_custkey % 97 = 3 THEN NULL ELSE c.c_acctbal END AS bal, c.c_mktsegment
  FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
staged AS (
  SELECT id_import, k, c_name, nat, bad_bal, bal, c_mktsegment FROM base
  UNION ALL SELECT id_import + 1, k, c_name, nat, bad_bal, bal, c_mktsegment FROM base WHERE k % 53 = 0
  UNION ALL SELECT id_import + CASE WHEN k % 53 = 0 THEN 2 ELSE 1 END, k, c_name, nat, NULL, 0.5, c_mktsegment FROM base WHERE k % 59 = 0)
"""


def _lines_text(c="lines"):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def _faulty_run(spark, sf, steps):
    from relata.plans.ingest import ImportRun
    from relata.sources.staged import customer_import_spec, staged_customers_faulty

    run = ImportRun(_cat(spark, sf), customer_import_spec(), staged_customers_faulty(spark, sf))
    run.keep = False
    for s in steps:
        getattr(run, f"step_{s}")()
    return run


@register("check_types", _STAGED_FAULTY_SQL + """
SELECT 'ERR_IMPORT_INVALID_VALUE_FOR_TYPE' AS error_code, 'c_acctbal' AS key, bad_bal AS value, COUNT(*) AS nb_lines,
       array_to_string(list_slice(list(id_import ORDER BY id_import), 1, 5), ',') AS lines
FROM staged WHERE bad_bal IS NOT NULL GROUP BY bad_bal
""")
def q_check_types(spark, sf):
    from relata.plans.ingest import type_errors
    from relata.sources.staged import customer_import_spec, staged_customers_faulty

    e = type_errors(staged_customers_faulty(spark, sf), customer_import_spec())
    return e.select("error_code", "key", "value", "nb_lines", _lines_text())


@register("check_required", _STAGED_FAULTY_SQL + """
SELECT 'ERR_IMPORT_REQUIRED' AS error_code, 'c_name' AS key, COUNT(*) AS nb_lines,
       array_to_string(list_slice(list(id_import ORDER BY id_import), 1, 5), ',') AS lines
FROM staged WHERE c_name IS NULL
""")
def q_check_required(spark, sf):
    run = _faulty_run(spark, sf, ["data_table", "mapping_view", "raw_view", "import_view", "post_check"])
    e = run.err_parts[0]
    return e.filter(F.col("error_code") == "ERR_IMPORT_REQUIRED").select("error_code", "key", "nb_lines", _lines_text())


@register("check_key_conflicts", _STAGED_FAULTY_SQL + """
SELECT 'ERR_IMPORT_UNIQUE_DOUBLON' AS error_code, CAST(k AS VARCHAR) AS value, COUNT(*) AS nb_lines,
       array_to_string(list_slice(list(id_import ORDER BY id_import), 1, 5), ',') AS lines
FROM staged WHERE k IN (SELECT k FROM base WHERE k % 59 = 0) GROUP BY k
""")
def q_check_key_conflicts(spark, sf):
    from relata.plans.ingest import conflict_errors
    from relata.sources.staged import customer_import_spec, staged_customers_faulty

    spec = customer_import_spec()
    e = conflict_errors(staged_customers_faulty(spark, sf), spec, list(spec.fields))
    return e.select("error_code", "value", "nb_lines", _lines_text())


@register("resolve_fk", _STAGED_FAULTY_SQL + """
SELECT s.id_import, s.k AS c_custkey, n.n_nationkey AS c_nationkey FROM staged s LEFT JOIN nation n ON n.n_name = s.nat
""")
def q_resolve_fk(spark, sf):
    from relata.plans.ingest import resolve_key
    from relata.sources.staged import staged_customers_faulty

    df = staged_customers_faulty(spark, sf)
    out = resolve_key(_cat(spark, sf), df, "c_nationkey", "nation", ["n_name"])
    return out.select("id_import", F.col("c_custkey").cast("long").alias("c_custkey"), "c_nationkey")


@register("resolve_fk_composite", """
SELECT c.c_custkey, n.n_nationkey AS c_nationkey
FROM customer c JOIN nation n0 ON n0.n_nationkey = c.c_nationkey JOIN region r0 ON r0.r_regionkey = n0.n_regionkey
LEFT JOIN region r ON r.r_name = CASE WHEN c.c_custkey % 13 = 0 THEN 'ASIA' ELSE r0.r_name END
LEFT JOIN nation n ON n.n_name = n0.n_name AND n.n_regionkey = r.r_regionkey
""")
def q_resolve_fk_composite(spark, sf):
    # composite natural key 'name|region name'; the region part is itself a key resolved first
    from relata.plans.ingest import resolve_key
    from relata.sources.tables import load_table

    c = load_table(spark, sf, "customer")
    n = F.broadcast(load_table(spark, sf, "nation"))
    r = F.broadcast(load_table(spark, sf, "region"))
    staged = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "c_custkey",
        F.concat_ws("|", "n_name", F.when(F.col("c_custkey") % 13 == 0, F.lit("ASIA")).otherwise(F.col("r_name"))).alias("c_nationkey"),
    )
    return resolve_key(_cat(spark, sf), staged, "c_nationkey", "nation", ["n_name", "region"])


@register("resolve_code", """
WITH codes AS (
  SELECT 'region' AS type, r_name AS code FROM region UNION SELECT 'nation', n_name FROM nation
  UNION SELECT 'priority', o_orderpriority FROM orders UNION SELECT 'brand', p_brand FROM part
  UNION SELECT 'segment', c_mktsegment FROM customer),
nom AS (SELECT CAST(row_number() OVER (ORDER BY type, code) AS INTEGER) AS id_nomenclature, type, code FROM codes)
SELECT o.o_orderkey, nom.id_nomenclature AS id_priority
FROM orders o LEFT JOIN nom ON nom.type = 'priority' AND nom.code = CASE WHEN o.o_orderkey % 211 = 0 THEN '9-NEVER' ELSE o.o_orderpriority END
""")
def q_resolve_code(spark, sf):
    from relata.plans.ingest import resolve_code
    from relata.sources.staged import staged_orders_codes

    df = resolve_code(_cat(spark, sf), staged_orders_codes(spark, sf), "id_priority", "priority")
    return df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "id_priority")


@register("unresolved_keys", _STAGED_FAULTY_SQL + """
SELECT 'ERR_IMPORT_UNRESOLVED' AS error_code, 'c_nationkey' AS key, nat AS value, COUNT(*) AS nb_lines,
       array_to_string(list_slice(list(id_import ORDER BY id_import), 1, 5), ',') AS lines
FROM staged WHERE nat NOT IN (SELECT n_name FROM nation) GROUP BY nat
""")
def q_unresolved_keys(spark, sf):
    run = _faulty_run(spark, sf, ["data_table", "mapping_view", "raw_view", "import_view", "post_check"])
    errs = run.err_parts[0]
    for e in run.err_parts[1:]:
        errs = errs.unionByName(e)
    return errs.filter(F.col("error_code") == "ERR_IMPORT_UNRESOLVED").select("error_code", "key", "value", "nb_lines", _lines_text())


@register("unresolved_codes", """
WITH codes AS (SELECT DISTINCT o_orderpriority AS code FROM orders)
SELECT 'ERR_IMPORT_UNRESOLVED' AS error_code, 'id_priority' AS key, '9-NEVER' AS value, COUNT(*) AS nb_lines,
       (SELECT string_agg(code, ', ' ORDER BY code) FROM codes) AS valid_values
FROM orders WHERE o_orderkey % 211 = 0
""")
def q_unresolved_codes(spark, sf):
    from relata.plans.ingest import FieldSpec, ImportRun, ImportSpec
    from relata.sources.staged import staged_orders_codes

    spec = ImportSpec("order", unique=["o_orderkey"], fields={
        "o_orderkey": FieldSpec("integer", required=True), "id_priority": FieldSpec("integer", code_type="priority")})
    run = ImportRun(_cat(spark, sf), spec, staged_orders_codes(spark, sf))
    run.keep = False
    for s in ["data_table", "mapping_view", "raw_view", "import_view", "post_check"]:
        getattr(run, f"step_{s}")()
    errs = run.err_parts[0]
    for e in run.err_parts[1:]:
        errs = errs.unionByName(e)
    return errs.filter(F.col("error_code") == "ERR_IMPORT_UNRESOLVED").select("error_code", "key", "value", "nb_lines", "valid_values")


@register("collapse_duplicates", _STAGED_FAULTY_SQL + """
, grp AS (SELECT k, c_name, nat, bal, c_mktsegment, MIN(id_import) AS id_import, COUNT(*) AS nb_lines
          FROM staged GROUP BY k, c_name, nat, bal, c_mktsegment)
SELECT id_import, nb_lines FROM grp WHERE nb_lines > 1
""")
def q_collapse_duplicates(spark, sf):
    run = _faulty_run(spark, sf, ["data_table", "mapping_view", "raw_view", "import_view"])
    p = run.r.frames["process"]
    return p.filter(F.col("nb_lines") > 1).select("id_import", F.col("nb_lines").cast("long").alias("nb_lines"))


_CLEAN_COUNTS_SQL = """
SELECT (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM customer WHERE c_custkey % 53 = 0)
         + (SELECT COUNT(*) FROM customer WHERE c_custkey % 11 = 0) AS nb_data,
       (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM customer WHERE c_custkey % 53 = 0)
         + (SELECT COUNT(*) FROM customer WHERE c_custkey % 11 = 0) AS nb_raw,
       (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM customer WHERE c_custkey % 11 = 0) AS nb_process,
       (SELECT COUNT(*) FROM customer WHERE c_custkey % 11 = 0) AS nb_insert,
       (SELECT COUNT(*) FROM customer WHERE c_custkey % 7 = 0) AS nb_update,
       (SELECT COUNT(*) FROM customer WHERE c_custkey % 7 != 0) AS nb_unchanged
"""


def _clean_import(spark, sf):
    from relata.plans.ingest import run_import
    from relata.sources.staged import customer_import_spec, staged_customers_clean

    return run_import(_cat(spark, sf), customer_import_spec(), staged_customers_clean(spark, sf))


@register("upsert_counts", _CLEAN_COUNTS_SQL)
def q_upsert_counts(spark, sf):
    r = _clean_import(spark, sf)
    if r.status != "DONE":
        raise RuntimeError(f"import stopped at {r.last_step}: {r.errors.limit(5).collect()}")
    keys = ["nb_data", "nb_raw", "nb_process", "nb_insert", "nb_update", "nb_unchanged"]
    r.release()
    return spark.createDataFrame([tuple(int(r.res[k]) for k in keys)], ", ".join(f"{k} long" for k in keys))


@register("upsert_result", """
SELECT c.c_custkey, c.c_name, c.c_nationkey, CASE WHEN c.c_custkey % 7 = 0 THEN c.c_acctbal + 1 ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment
FROM customer c
UNION ALL
SELECT c.c_custkey + 10000000, 'New#' || CAST(c.c_custkey AS VARCHAR), c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM customer c WHERE c.c_custkey % 11 = 0
""")
def q_upsert_result(spark, sf):
    return _clean_import(spark, sf).table


def _order_parts_import(spark, sf):
    from relata.plans.ingest import FieldSpec, ImportSpec, run_import
    from relata.sources.staged import staged_order_parts
    from relata.sources.tables import load_table

    spec = ImportSpec("order", unique=["o_orderkey"], fields={
        "o_orderkey": FieldSpec("integer", required=True),
        "parts": FieldSpec(nn="part", nn_unique="p_partkey"),
    })
    cur = load_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("__pk"), F.col("l_partkey").alias("__link")).distinct()
    return run_import(_cat(spark, sf), spec, staged_order_parts(spark, sf), links={"parts": cur})


_ORDER_PARTS_SQL = """
WITH pairs AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
ranked AS (SELECT l_orderkey, l_partkey, COUNT(*) OVER (PARTITION BY l_orderkey) AS n,
                  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC) AS rdesc FROM pairs)
"""


@register("relation_replace", _ORDER_PARTS_SQL + """
SELECT l_orderkey AS o_orderkey, l_partkey AS p_partkey FROM ranked WHERE NOT (l_orderkey % 5 = 0 AND n > 1 AND rdesc = 1)
""")
def q_relation_replace(spark, sf):
    r = _order_parts_import(spark, sf)
    checkpoint_dir(spark)
    links = r.links["parts"].select(F.col("__pk").alias("o_orderkey"), F.col("__link").alias("p_partkey")).checkpoint(eager=True)
    r.release()  # the result is written
    return links


@register("relation_update_counts", _ORDER_PARTS_SQL + """
SELECT (SELECT COUNT(DISTINCT l_orderkey) FROM pairs) AS nb_process,
       CAST(0 AS BIGINT) AS nb_insert,
       (SELECT COUNT(DISTINCT l_orderkey) FROM ranked WHERE l_orderkey % 5 = 0 AND n > 1) AS nb_update
""")
def q_relation_update_counts(spark, sf):
    r = _order_parts_import(spark, sf)
    keys = ["nb_process", "nb_insert", "nb_update"]
    r.release()
    return spark.createDataFrame([tuple(int(r.res[k]) for k in keys)], ", ".join(f"{k} long" for k in keys))


# ---------------------------------------------------------------- aggregates, sets, exports (A, U, S)
@register("export_flat", """
SELECT o.o_orderkey, c.c_name AS customer__c_name,
       string_agg(DISTINCT p.p_brand, ', ' ORDER BY p.p_brand) AS brands,
       string_agg(DISTINCT l.l_returnflag, ', ' ORDER BY l.l_returnflag) AS flags
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey
GROUP BY o.o_orderkey, c.c_name
""")
def q_export_flat(spark, sf):
    from relata.plans.exports import export_view_of

    return export_view_of(_cat(spark, sf), "order", ["o_orderkey", "customer.c_name", "lineitems.part.p_brand", "lineitems.l_returnflag"],
                          names={"lineitems.part.p_brand": "brands", "lineitems.l_returnflag": "flags"})


@register("dedupe_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn
  FROM lineitem) WHERE rn = 1
""")
def q_dedupe_keep_first(spark, sf):
    from relata.operators.aggregates import keep_first
    from relata.sources.tables import load_table

    li = load_table(spark, sf, "lineitem")
    kept = keep_first(li, ["l_orderkey", "l_linenumber"], [F.col(c).asc() for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("explode_membership", """
WITH pairs AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT pr.l_orderkey AS o_orderkey, string_agg(p.p_name, ', ' ORDER BY p.p_name) AS part_names, COUNT(*) AS n_parts
FROM pairs pr JOIN part p ON p.p_partkey = pr.l_partkey GROUP BY pr.l_orderkey
""")
def q_explode_membership(spark, sf):
    # delimited membership text 'k1/k2/...' per order, exploded and joined back (J13), names aggregated
    from relata.operators.aggregates import agg_text
    from relata.operators.relations import join_list
    from relata.sources.tables import load_table

    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    lists = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), "/").alias("members"))
    part = load_table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("member"), "p_name")
    joined = join_list(lists, "members", "/", part, "member")
    names = agg_text(joined, ["l_orderkey"], "p_name", "part_names")
    counts = joined.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_parts"))
    return names.join(counts, "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")


@register("value_map", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS priority, COUNT(*) AS n
FROM orders GROUP BY 1
""")
def q_value_map(spark, sf):
    from relata.functions.text import value_map
    from relata.sources.tables import load_table

    o = load_table(spark, sf, "orders")
    return o.groupBy(value_map(F.col("o_orderpriority"), {"1-URGENT": "urgent", "2-HIGH": "high"}).alias("priority")).agg(
        F.count(F.lit(1)).alias("n"))


@register("frequencies", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def q_frequencies(spark, sf):
    from relata.operators.aggregates import frequencies
    from relata.sources.tables import load_table

    return frequencies(load_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("having_count", """
SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15
""")
def q_having_count(spark, sf):
    from relata.operators.aggregates import having
    from relata.sources.tables import load_table

    return having(load_table(spark, sf, "orders"), ["o_custkey"], F.count(F.lit(1)).alias("n_orders"), F.col("n_orders") > 15)


@register("count_distinct", """
SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS n_parts, bool_or(l_returnflag = 'R') AS any_returned FROM lineitem GROUP BY l_suppkey
""")
def q_count_distinct(spark, sf):
    from relata.operators.aggregates import any_equals
    from relata.sources.tables import load_table

    li = load_table(spark, sf, "lineitem")
    return li.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"), any_equals(F.col("l_returnflag"), "R").alias("any_returned"))


@register("union_sources", """
SELECT CAST(floor((c_custkey % 1000) / 10) AS BIGINT) AS gx, CAST(floor((c_custkey * 37 % 1000) / 10) AS BIGINT) AS gy FROM customer
UNION SELECT CAST(floor((s_suppkey * 13 % 1000) / 10) AS BIGINT), CAST(floor((s_suppkey * 29 % 1000) / 10) AS BIGINT) FROM supplier
""")
def q_union_sources(spark, sf):
    from relata.operators.sets import union_distinct
    from relata.sources.tables import load_table

    c = load_table(spark, sf, "customer").select(
        F.floor((F.col("c_custkey") % 1000) / 10).cast("long").alias("gx"), F.floor(((F.col("c_custkey") * 37) % 1000) / 10).cast("long").alias("gy"))
    s = load_table(spark, sf, "supplier").select(
        F.floor(((F.col("s_suppkey") * 13) % 1000) / 10).cast("long").alias("gx"), F.floor(((F.col("s_suppkey") * 29) % 1000) / 10).cast("long").alias("gy"))
    return union_distinct([c, s])


@register("except_rows", """
SELECT DISTINCT c.c_nationkey AS nationkey, c.c_mktsegment AS segment FROM customer c
WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey
              AND CASE WHEN s.s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END = c.c_mktsegment)
""")
def q_except_rows(spark, sf):
    # rights granted (nation, segment): those no longer offered (EXCEPT) are deleted
    from relata.operators.scope import prune_rights
    from relata.sources.tables import load_table

    granted = load_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    offered = load_table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nationkey"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("BUILDING")).otherwise(F.lit("MACHINERY")).alias("segment"))
    return prune_rights(granted, offered, ["nationkey", "segment"]).distinct()


@register("change_history", """
SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'D' ELSE 'U' END AS op FROM customer WHERE c_custkey % 13 = 0 OR c_custkey % 7 = 0
UNION ALL SELECT c_custkey + 10000000, 'I' FROM customer WHERE c_custkey % 11 = 0
""")
def q_change_history(spark, sf):
    from relata.operators.changes import with_history
    from relata.sources.tables import load_table

    before = load_table(spark, sf, "customer")
    k = F.col("c_custkey")
    after = before.filter(k % 13 != 0).withColumn("c_acctbal", F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    new = before.filter(k % 11 == 0).withColumn("c_custkey", k + 10_000_000)
    return with_history(before, after.unionByName(new), ["c_custkey"], ts="2024-01-01 00:00:00").select("c_custkey", "op")


@register("apply_changes", """
SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 'gold' ELSE c_mktsegment END AS c_mktsegment, c_acctbal
FROM customer WHERE c_custkey % 19 != 0
UNION ALL SELECT c_custkey + 20000000, 'new', 0.0 FROM customer WHERE c_custkey % 23 = 0
""")
def q_apply_changes(spark, sf):
    # one change set with updates (key % 17), deletes (key % 19) and inserts (key % 23, new keys)
    from relata.operators.changes import apply_changes
    from relata.sources.tables import load_table

    t = load_table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey")
    upd = t.filter(k % 17 == 0).select("c_custkey", F.lit("gold").alias("c_mktsegment"), "c_acctbal", F.lit("update").alias("op"))
    dele = t.filter(k % 19 == 0).select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"), F.lit("delete").alias("op"))
    ins = t.filter(k % 23 == 0).select((k + 20_000_000).alias("c_custkey"), F.lit("new").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"), F.lit("insert").alias("op"))
    changes = upd.unionByName(dele.filter(k % 17 != 0)).unionByName(ins)
    both = t.filter((k % 17 == 0) & (k % 19 == 0)).select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"), F.lit("delete").alias("op"))
    changes = changes.join(both.select("c_custkey"), "c_custkey", "left_anti").unionByName(both)
    return apply_changes(t, changes, ["c_custkey"])


@register("update_from", """
SELECT c.c_custkey, CASE WHEN n.n_regionkey = 2 THEN c.c_acctbal * 2 ELSE c.c_acctbal END AS c_acctbal
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
""")
def q_update_from(spark, sf):
    # bulk re-assignment by area (J19, R-7): balances doubled for nations of region 2
    from relata.operators.changes import update_from
    from relata.sources.tables import load_table

    c = load_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = load_table(spark, sf, "nation").filter(F.col("n_regionkey") == 2).select(F.col("n_nationkey").alias("c_nationkey"))
    out = update_from(c, n, ["c_nationkey"], {"c_acctbal": F.col("c_acctbal") * 2})
    return out.select("c_custkey", "c_acctbal")


@register("text_functions", """
SELECT c_custkey,
       CASE WHEN strpos(c_name, '#') > 0 THEN substring(c_name, 1, strpos(c_name, '#') - 1) ELSE '' END AS before_hash,
       split_part(c_name, '#', 2) AS after_hash,
       CAST(ROUND(CAST(c_acctbal / 3 AS DECIMAL(38,10)), 2) AS DOUBLE) AS third,
       json_object('c_mktsegment', c_mktsegment, 'nation', CAST(c_nationkey AS VARCHAR))::VARCHAR AS extras,
       CASE WHEN c_mktsegment LIKE 'M%' THEN 'm' WHEN c_acctbal < 0 THEN 'neg' ELSE 'other' END AS klass,
       regexp_replace(c_name, '[0-9]+', 'N', 'g') AS masked,
       substring(c_name, 9) AS tail,
       COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'B') AS seg
FROM customer
""")
def q_text_functions(spark, sf):
    from relata.functions.text import before_first, classify, json_of, round_half_up
    from relata.sources.tables import load_table

    c = load_table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("string"))
    return c.select(
        "c_custkey",
        before_first(F.col("c_name"), "#").alias("before_hash"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)).alias("after_hash"),
        round_half_up(F.col("c_acctbal") / 3, 2).cast("double").alias("third"),
        json_of(["c_mktsegment", "nation"]).alias("extras"),
        classify([(F.col("c_mktsegment").like("M%"), "m"), (F.col("c_acctbal") < 0, "neg")], "other").alias("klass"),
        F.regexp_replace("c_name", "[0-9]+", "N").alias("masked"),
        F.substr("c_name", F.lit(9)).alias("tail"),
        F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("B")).alias("seg"),
    )


# ---------------------------------------------------------------- geometry
_CX = "(CAST(5.0 AS DOUBLE) + CAST(c_custkey % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
_CY = "(CAST(45.0 AS DOUBLE) + CAST(c_custkey * 37 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
_SX = "(CAST(5.0 AS DOUBLE) + CAST(s_suppkey * 13 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
_SY = "(CAST(45.0 AS DOUBLE) + CAST(s_suppkey * 29 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))"


def _dist_sql(x1, y1, x2, y2):
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi = f"radians(({y1} + {y2}) / 2)"
    w = f"sqrt(1 - {e2!r} * pow(sin({phi}), 2))"
    m = f"({a * (1 - e2)!r} / ({w} * {w} * {w}))"
    n = f"({a!r} / {w})"
    dx = f"(radians({x2} - {x1}) * {n} * cos({phi}))"
    dy = f"(radians({y2} - {y1}) * {m})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


@register("bbox_points", f"""
SELECT c_custkey FROM customer WHERE {_CX} BETWEEN 5.2 AND 5.4 AND {_CY} BETWEEN 45.2 AND 45.5
""")
def q_bbox_points(spark, sf):
    return _list(spark, sf, "customer", fields=["c_custkey"], filters="geom bbox 5.2;45.2;5.4;45.5")


@register("near_points", f"""
SELECT c_custkey FROM customer WHERE {_dist_sql(_CX, _CY, 'CAST(5.5 AS DOUBLE)', 'CAST(45.5 AS DOUBLE)')} <= 20000
""")
def q_near_points(spark, sf):
    return _list(spark, sf, "customer", fields=["c_custkey"], filters="geom dwithin 5.5;45.5;20000")


@register("near_object", f"""
SELECT c_custkey FROM customer, (SELECT {_CX} AS ox, {_CY} AS oy FROM customer WHERE c_custkey = 42) o
WHERE {_dist_sql(_CX, _CY, 'o.ox', 'o.oy')} <= 15000
""")
def q_near_object(spark, sf):
    # object form: within 15 km of customer 42's geometry (one-row broadcast)
    return _list(spark, sf, "customer", fields=["c_custkey"], filters="geom dwithin customer;42;geom;15000")


def _supplier_lines(spark, sf):
    from relata.sources.tables import load_table, supplier_point_x, supplier_point_y

    # lines of (at most) 4 consecutive suppliers: lid = key div 4, type = lid mod 5; arrays stay bounded
    s = load_table(spark, sf, "supplier")
    s = s.select(F.floor(F.col("s_suppkey") / 4).cast("long").alias("lid"), "s_suppkey",
                 supplier_point_x(s).alias("x"), supplier_point_y(s).alias("y"))
    lines = s.groupBy("lid").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "x", "y"))).alias("pts"))
    return lines.select("lid", F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"),
                        (F.col("lid") % 5).alias("type"))


def _customer_points(spark, sf):
    from relata.sources.tables import customer_point_x, customer_point_y, load_table

    c = load_table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("pid"), customer_point_x(c).alias("x"), customer_point_y(c).alias("y"))


_SEGS_SQL = f"""
WITH sp AS (SELECT s_suppkey, CAST(floor(s_suppkey / 4) AS BIGINT) AS lid, {_SX} AS x, {_SY} AS y FROM supplier),
seg AS (SELECT lid, x AS ax, y AS ay,
               LEAD(x) OVER (PARTITION BY lid ORDER BY s_suppkey) AS bx,
               LEAD(y) OVER (PARTITION BY lid ORDER BY s_suppkey) AS by_,
               COUNT(*) OVER (PARTITION BY lid) AS nv FROM sp),
pts AS (SELECT c_custkey AS pid, {_CX} AS px, {_CY} AS py FROM customer),
d AS (
  SELECT p.pid, s.lid,
         CASE WHEN s.nv = 1 THEN sqrt(pow(p.px - s.ax, 2) + pow(p.py - s.ay, 2)) ELSE
           sqrt(pow(p.px - (s.ax + t * (s.bx - s.ax)), 2) * 0 + (p.px - (s.ax + t * (s.bx - s.ax))) * (p.px - (s.ax + t * (s.bx - s.ax)))
                + (p.py - (s.ay + t * (s.by_ - s.ay))) * (p.py - (s.ay + t * (s.by_ - s.ay)))) END AS dist
  FROM pts p, (SELECT *, 0 AS dummy FROM seg WHERE bx IS NOT NULL OR nv = 1) s0(lid, ax, ay, bx, by_, nv, dummy),
       LATERAL (SELECT s0.lid AS lid, s0.ax AS ax, s0.ay AS ay, s0.bx AS bx, s0.by_ AS by_, s0.nv AS nv) s,
       LATERAL (SELECT CASE WHEN s.nv = 1 THEN 0.0 WHEN ((s.bx - s.ax) * (s.bx - s.ax) + (s.by_ - s.ay) * (s.by_ - s.ay)) > 0
                 THEN greatest(0.0, least(1.0, ((p.px - s.ax) * (s.bx - s.ax) + (p.py - s.ay) * (s.by_ - s.ay))
                      / ((s.bx - s.ax) * (s.bx - s.ax) + (s.by_ - s.ay) * (s.by_ - s.ay)))) ELSE 0.0 END AS t) tt)
"""


@register("near_lines", _SEGS_SQL + """
SELECT pid, lid, ROUND(MIN(dist), 9) AS dist FROM d GROUP BY pid, lid HAVING MIN(dist) <= 0.05
""")
def q_near_lines(spark, sf):
    # all point-line pairs within 0.05 (planar): grid-cell equi join + exact distance
    from relata.operators import geo

    pairs = geo.join_within(_customer_points(spark, sf), _supplier_lines(spark, sf), 0.05)
    return pairs.select("pid", "lid", geo.round9(F.col("dist")).alias("dist"))


@register("nearest_per_type", _SEGS_SQL + """
, pl AS (SELECT pid, lid, MIN(dist) AS dist FROM d GROUP BY pid, lid HAVING MIN(dist) <= 0.05),
typed AS (SELECT pl.*, pl.lid % 5 AS type, ROW_NUMBER() OVER (PARTITION BY pid, pl.lid % 5 ORDER BY dist, pl.lid) AS rn FROM pl)
SELECT pid, type, lid, ROUND(dist, 9) AS dist FROM typed WHERE rn = 1
""")
def q_nearest_per_type(spark, sf):
    from relata.operators import geo

    best = geo.nearest_within(_customer_points(spark, sf), _supplier_lines(spark, sf), 0.05)
    return best.select("pid", "type", "lid", F.round("dist", 9).alias("dist"))


def _nation_areas(spark, sf):
    from relata.operators import geo
    from relata.sources.tables import load_table

    n = load_table(spark, sf, "nation")
    x0 = F.lit(5.0005) + (F.col("n_nationkey") % 5) * F.lit(0.2)
    y0 = F.lit(45.0005) + F.floor(F.col("n_nationkey") / 5) * F.lit(0.2)
    x1, y1 = x0 + F.lit(0.2), y0 + F.lit(0.2)
    s = lambda c: F.format_number(c, 4).cast("string")
    wkt = F.concat(F.lit("POLYGON (("), s(x0), F.lit(" "), s(y0), F.lit(", "), s(x1), F.lit(" "), s(y0), F.lit(", "),
                   s(x1), F.lit(" "), s(y1), F.lit(", "), s(x0), F.lit(" "), s(y1), F.lit(", "), s(x0), F.lit(" "), s(y0), F.lit("))"))
    return n.select(F.col("n_nationkey").alias("aid"), wkt.alias("wkt")).withColumn("geom", geo.parse_wkt(F.col("wkt"), 4326))


_BOX_SQL = """(CAST(5.0005 AS DOUBLE) + (n_nationkey % 5) * CAST(0.2 AS DOUBLE))"""
_BOY_SQL = """(CAST(45.0005 AS DOUBLE) + floor(n_nationkey / 5) * CAST(0.2 AS DOUBLE))"""


@register("points_in_boxes", f"""
SELECT c.c_custkey AS pid, n.n_nationkey AS aid FROM customer c, nation n
WHERE {_CX.replace('c_custkey', 'c.c_custkey')} > {_BOX_SQL} AND {_CX.replace('c_custkey', 'c.c_custkey')} < {_BOX_SQL} + 0.2
  AND {_CY.replace('c_custkey', 'c.c_custkey')} > {_BOY_SQL} AND {_CY.replace('c_custkey', 'c.c_custkey')} < {_BOY_SQL} + 0.2
""")
def q_points_in_boxes(spark, sf):
    # area links: polygons explode to the 0.1-cells of their bbox, points to one cell, exact ray-casting test
    from relata.operators import geo

    return geo.points_in_polygons(_customer_points(spark, sf), _nation_areas(spark, sf), 0.1)


@register("wkt_roundtrip", f"""
SELECT n_nationkey AS aid, 'POLYGON' AS kind, 5 AS n_vertices,
       ROUND({_BOX_SQL}, 4) AS xmin, ROUND({_BOY_SQL}, 4) AS ymin, ROUND({_BOX_SQL} + 0.2, 4) AS xmax, ROUND({_BOY_SQL} + 0.2, 4) AS ymax
FROM nation
""")
def q_wkt_roundtrip(spark, sf):
    # WKT -> geometry -> WKT -> geometry
    from relata.operators import geo

    # each step bound to a column: geometry functions read their input several times
    a = _nation_areas(spark, sf).withColumn("w2", geo.to_wkt(F.col("geom"))).withColumn("g2", geo.parse_wkt(F.col("w2")))
    b = F.col("g2")["bbox"]
    return a.select("aid", F.col("g2")["kind"].alias("kind"), F.size(F.flatten(F.flatten(F.col("g2")["parts"]))).alias("n_vertices"),
                    F.round(b["xmin"], 4).alias("xmin"), F.round(b["ymin"], 4).alias("ymin"),
                    F.round(b["xmax"], 4).alias("xmax"), F.round(b["ymax"], 4).alias("ymax"))


@register("collect_geom", f"""
SELECT c_nationkey AS nation, 'MULTIPOINT' AS kind, COUNT(*) AS n_parts,
       ROUND(MIN({_CX}), 6) AS xmin, ROUND(MAX({_CY}), 6) AS ymax
FROM customer GROUP BY c_nationkey
""")
def q_collect_geom(spark, sf):
    from relata.operators import geo
    from relata.sources.tables import load_table

    cat = _cat(spark, sf)
    c = load_table(spark, sf, "customer")
    c = c.withColumn("geom", cat.schema("customer").computed["geom"](c))
    g = geo.collect_summary(c, ["c_nationkey"], "geom")
    return g.select(F.col("c_nationkey").alias("nation"), "kind", "n_parts",
                    F.round(F.col("bbox")["xmin"], 6).alias("xmin"), F.round(F.col("bbox")["ymax"], 6).alias("ymax"))


def _l93_sql():
    import math

    from relata.operators.geo import L93_LON0, L93_X0, L93_Y0, _lcc_consts

    e, a, n, f, rho0 = _lcc_consts()
    phi = f"radians({_CY})"
    es = f"({e!r} * sin({phi}))"
    t = f"(tan({math.pi / 4!r} - {phi} / 2) / pow((1 - {es}) / (1 + {es}), {e / 2!r}))"
    rho = f"({a * f!r} * pow({t}, {n!r}))"
    theta = f"({n!r} * radians({_CX} - {L93_LON0!r}))"
    return f"ROUND({L93_X0!r} + {rho} * sin({theta}), 2)", f"ROUND({L93_Y0 + rho0!r} - {rho} * cos({theta}), 2)"


@register("reproject_l93", f"""
SELECT c_custkey, {_l93_sql()[0]} AS x, {_l93_sql()[1]} AS y FROM customer
""")
def q_reproject_l93(spark, sf):
    # lon/lat -> Lambert-93 (EPSG:2154), closed form
    from relata.operators import geo

    pts = _customer_points(spark, sf)
    g = geo.reproject(geo.make_point(F.col("x"), F.col("y"), 4326), 4326, 2154)
    p = F.get(F.get(F.get(g["parts"], 0), 0), 0)
    return pts.select(F.col("pid").alias("c_custkey"), F.round(p["x"], 2).alias("x"), F.round(p["y"], 2).alias("y"))


@register("bbox_join", f"""
WITH sp AS (SELECT CAST(floor(s_suppkey / 4) AS BIGINT) AS bid, MIN({_SX}) AS bx0, MAX({_SX}) AS bx1, MIN({_SY}) AS by0, MAX({_SY}) AS by1
            FROM supplier GROUP BY 1),
ar AS (SELECT n_nationkey AS aid, ROUND({_BOX_SQL}, 4) AS ax0, ROUND({_BOX_SQL} + 0.2, 4) AS ax1, ROUND({_BOY_SQL}, 4) AS ay0, ROUND({_BOY_SQL} + 0.2, 4) AS ay1 FROM nation)
SELECT aid, bid FROM ar, sp WHERE ax1 >= bx0 AND ax0 <= bx1 AND ay1 >= by0 AND ay0 <= by1
""")
def q_bbox_join(spark, sf):
    # areas x lines whose bounding boxes overlap: both sides explode to their bbox cells
    from relata.operators import geo

    lines = _supplier_lines(spark, sf).withColumn("geom", geo.make_geom(F.lit("LINESTRING"), F.lit(4326), F.array(F.array(F.col("line")))))
    return geo.bbox_join(_nation_areas(spark, sf), lines, 0.1, aid="aid", ag="geom", bid="lid", bg="geom").withColumnRenamed("bid", "bid")


@register("geojson_features", f"""
SELECT c_custkey, {_CX} AS x, {_CY} AS y FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_geojson_features(spark, sf):
    # GeoJSON features written and read back
    from relata.sources.sinks import geojson_features

    cat = _cat(spark, sf)
    c = cat.frame("customer").filter(F.col("c_mktsegment") == "BUILDING")
    c = c.select("c_custkey", cat.schema("customer").computed["geom"](c).alias("geom"))
    f = geojson_features(c, "geom")
    return f.select(
        F.get_json_object("feature", "$.properties.c_custkey").cast("long").alias("c_custkey"),
        F.get_json_object("feature", "$.geometry.coordinates[0]").cast("double").alias("x"),
        F.get_json_object("feature", "$.geometry.coordinates[1]").cast("double").alias("y"),
    )


@register("validate_records", """
SELECT field, rule, COUNT(*) AS n FROM (
  SELECT 'c_acctbal' AS field, 'minimum' AS rule FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'c_mktsegment', 'enum' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
  UNION ALL SELECT 'c_name', 'pattern' FROM customer WHERE NOT regexp_matches(c_name, '^Customer#0000000[0-9]{2}$')
) GROUP BY field, rule
""")
def q_validate_records(spark, sf):
    from relata.operators.validation import validate
    from relata.sources.tables import load_table

    errs = validate(load_table(spark, sf, "customer"), "c_custkey", {
        "c_acctbal": {"type": "number", "minimum": 0},
        "c_mktsegment": {"required": True, "enum": ["BUILDING", "MACHINERY", "FURNITURE"]},
        "c_name": {"required": True, "pattern": "^Customer#0000000[0-9]{2}$"},
    })
    return errs.groupBy("field", "rule").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- more operators
@register("join_contains", """
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
""")
def q_join_contains(spark, sf):
    # which documents contain which benchmark passage, over whole texts
    from relata.operators.patterns import join_contains
    from relata.sources.tables import load_table

    d = load_table(spark, sf, "documents")
    b = load_table(spark, sf, "benchmark")
    return join_contains(d, "doc_id", "text", b, "item_id", "text")


@register("flat_render", """
WITH page AS (SELECT c_custkey, c_nationkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40)
SELECT p.c_custkey AS "Key", n.n_name AS "Nation",
       (SELECT string_agg(CAST(o.o_orderkey AS VARCHAR) || '_' || o.o_orderstatus, ', ' ORDER BY o.o_orderkey)
        FROM orders o WHERE o.o_custkey = p.c_custkey) AS orders
FROM page p LEFT JOIN nation n ON n.n_nationkey = p.c_nationkey
""")
def q_flat_render(spark, sf):
    # nested list rendered flat: records joined by '_', lists by ', ' (P10, S12), headings
    from relata.sources.sinks import export_headers, flatten

    df = ListQuery(_cat(spark, sf), "customer", fields=["c_custkey", "nation.n_name", "orders.o_orderkey", "orders.o_orderstatus"],
                   sort="c_custkey", page=3, page_size=20).build()
    flat = flatten(df, sep="__")
    return export_headers(flat, ["c_custkey,Key", "nation.n_name,Nation", "orders"])


@register("get_rows", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
""")
def q_get_rows(spark, sf):
    # bulk row lookup by key values held in a frame (F15, O9): semi join, keys never collected
    from relata.operators.relations import get_rows
    from relata.sources.tables import load_table

    keys = load_table(spark, sf, "customer").filter(F.col("c_nationkey") == 3).select(F.col("c_custkey").alias("o_custkey"))
    return get_rows(load_table(spark, sf, "orders"), keys, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@register("filter_nested", """
WITH page AS (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20)
SELECT p.c_custkey, COUNT(o.o_orderkey) AS n_finished,
       string_agg(CAST(o.o_orderkey AS VARCHAR), ',' ORDER BY o.o_orderkey) AS finished
FROM page p LEFT JOIN orders o ON o.o_custkey = p.c_custkey AND o.o_orderstatus = 'F' GROUP BY p.c_custkey
""")
def q_filter_nested(spark, sf):
    from relata.operators.relations import filter_nested

    df = ListQuery(_cat(spark, sf), "customer", fields=["c_custkey", "orders.o_orderkey", "orders.o_orderstatus"],
                   sort="c_custkey", page_size=20).build()
    df = filter_nested(df, "orders", "o_orderstatus", "F")
    return df.select("c_custkey", F.size("orders").cast("long").alias("n_finished"),
                     F.when(F.size("orders") > 0, F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",")).alias("finished"))


@register("expand_codes", """
SELECT r_name AS code FROM region WHERE r_name IN ('ASIA', 'EUROPE')
UNION SELECT n.n_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_name IN ('ASIA', 'EUROPE')
""")
def q_expand_codes(spark, sf):
    # a region code also selects the codes of its nations
    from relata.operators.relations import expand_codes
    from relata.sources.tables import load_table

    r = load_table(spark, sf, "region")
    n = load_table(spark, sf, "nation")
    mapping = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    chosen = r.filter(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_name").alias("code"))
    return expand_codes(chosen, "code", mapping)


@register("resolve_rows", """
WITH codes AS (
  SELECT 'region' AS type, r_name AS code FROM region UNION SELECT 'nation', n_name FROM nation
  UNION SELECT 'priority', o_orderpriority FROM orders UNION SELECT 'brand', p_brand FROM part
  UNION SELECT 'segment', c_mktsegment FROM customer),
nom AS (SELECT CAST(row_number() OVER (ORDER BY type, code) AS INTEGER) AS id_nomenclature, type, code FROM codes),
pairs AS (SELECT DISTINCT c.c_mktsegment, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey)
SELECT s.id_nomenclature AS c_mktsegment, n.n_nationkey AS n_name
FROM pairs p JOIN nom s ON s.type = 'segment' AND s.code = p.c_mktsegment JOIN nation n ON n.n_name = p.n_name
""")
def q_resolve_rows(spark, sf):
    # rows of codes resolved against several code tables by name
    from relata.operators.relations import resolve_rows
    from relata.sources.tables import load_table

    cat = _cat(spark, sf)
    c, n = load_table(spark, sf, "customer"), load_table(spark, sf, "nation")
    pairs = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("c_mktsegment", "n_name").distinct()
    seg = cat.frame("nomenclature").filter(F.col("type") == "segment")
    return resolve_rows(pairs, {"c_mktsegment": (seg, "cd_nomenclature", "id_nomenclature"), "n_name": (n, "n_name", "n_nationkey")})


@register("page_with_row", """
WITH ranked AS (SELECT c_custkey, c_acctbal, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rn
                FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT c_custkey, c_acctbal FROM ranked
WHERE CEIL(rn / 25.0) = (SELECT CEIL(rn / 25.0) FROM ranked WHERE c_custkey = (
  SELECT MIN(c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey >= (SELECT MAX(c_custkey) / 2 FROM customer)))
""")
def q_page_with_row(spark, sf):
    # the page holding a given object
    target = _machinery_target(spark, sf)
    q = ListQuery(_cat(spark, sf), "customer", fields=["c_custkey", "c_acctbal"], filters="c_mktsegment = MACHINERY", sort="c_acctbal-", page_size=25)
    return q.page_with(target)


@register("centroids", f"""
SELECT n_nationkey AS aid, ROUND({_BOX_SQL} + 0.1, 6) AS cx, ROUND({_BOY_SQL} + 0.1, 6) AS cy FROM nation
""")
def q_centroids(spark, sf):
    # area-weighted centroid of polygons
    from relata.operators import geo

    a = _nation_areas(spark, sf)
    c = geo.centroid(F.col("geom"))
    return a.select("aid", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@register("refresh_links", f"""
WITH pts AS (
  SELECT c_custkey AS pid,
         CASE WHEN c_custkey % 7 = 0 THEN {_CX} + CAST(0.2 AS DOUBLE) ELSE {_CX} END AS x, {_CY} AS y FROM customer)
SELECT p.pid, n.n_nationkey AS aid FROM pts p, nation n
WHERE p.x > {_BOX_SQL} AND p.x < {_BOX_SQL} + 0.2 AND p.y > {_BOY_SQL} AND p.y < {_BOY_SQL} + 0.2
""")
def q_refresh_links(spark, sf):
    # full link rebuild, then an incremental refresh for objects whose geometry moved
    from relata.operators import geo

    pts = _customer_points(spark, sf)
    areas = _nation_areas(spark, sf)
    links = geo.points_in_polygons(pts, areas, 0.1)
    moved = pts.filter(F.col("pid") % 7 == 0).withColumn("x", F.col("x") + F.lit(0.2))
    new = geo.points_in_polygons(moved, areas, 0.1)
    return geo.refresh_links(links, moved.select("pid"), new)


@register("fix_srid", f"""
SELECT c_custkey, ROUND({_CX}, 6) AS x, ROUND({_CY}, 6) AS y FROM customer
""")
def q_fix_srid(spark, sf):
    # a third of the geometries stored in Lambert-93 are rewritten to lon/lat; the rest untouched
    from relata.operators import geo

    pts = _customer_points(spark, sf)
    g = geo.make_point(F.col("x"), F.col("y"), 4326)
    stored = pts.select("pid", F.when(F.col("pid") % 3 == 0, geo.reproject(g, 4326, 2154)).otherwise(g).alias("geom"))
    fixed = geo.fix_srid(stored, "geom", 4326)
    p = geo.point_xy(F.col("geom"))
    return fixed.select(F.col("pid").alias("c_custkey"), F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@register("explode_parts", """
SELECT c_nationkey AS nation, 'POINT' AS kind, COUNT(*) AS n FROM customer GROUP BY c_nationkey
""")
def q_explode_parts(spark, sf):
    # points collected per nation, the collection in long form: single parts
    from relata.operators import geo
    from relata.sources.tables import load_table

    c = load_table(spark, sf, "customer")
    c = c.withColumn("geom", _cat(spark, sf).schema("customer").computed["geom"](c))
    parts = geo.collect_parts(c, ["c_nationkey"], "geom")
    return parts.groupBy(F.col("c_nationkey").alias("nation"), F.col("part")["kind"].alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("display_functions", """
SELECT o.o_orderkey, strftime(o.o_orderdate, '%d/%m/%Y') AS shown_date,
       upper(substr(lower(c.c_mktsegment), 1, 1)) || substr(lower(c.c_mktsegment), 2) AS segment
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
""")
def q_display_functions(spark, sf):
    from relata.functions.text import capitalise, show_date
    from relata.sources.tables import load_table

    o, c = load_table(spark, sf, "orders"), load_table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select("o_orderkey", show_date(F.col("o_orderdate")).alias("shown_date"), capitalise(F.lower("c_mktsegment")).alias("segment"))


@register("one_to_one_path", """
SELECT d.doc_id, d.lang, l.quality AS labels__quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.toxic = 0 AND d.lang IN ('fr', 'de')
""")
def q_one_to_one_path(spark, sf):
    # a 1-1 relation used in a field and in a filter
    return _list(spark, sf, "document", fields=["doc_id", "lang", "labels.quality"], filters="labels.toxic = 0,lang in fr;de")


from relata import import_queries, more_queries  # noqa: E402,F401 - register their queries beside these
