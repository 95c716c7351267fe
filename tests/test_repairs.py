import math

import pytest
from pyspark.sql import functions as F

from relata.functions.text import natural_keys
from relata.operators import geo
from relata.plans.ingest import MappingError, check_expression, key_text
from relata.plans.list_query import ListQuery


def test_mapping_expressions_allow_known_functions_only():
    for good in ("split_part(c, ';', 1)", "concat(upper(a), ' from ', `select`)", "case when a in ('x') then cast(b as decimal(10,2)) end"):
        check_expression(good)
    for bad in ("java_method('java.lang.System', 'getProperty', 'user.name')", "(SELECT max(a) FROM t)", "reflect('a', 'b')", "a; b", "upper(a) -- b",
                "input_file_name()", "default.f(a)", "upper('a"):
        with pytest.raises(MappingError):
            check_expression(bad)


def test_composite_keys_do_not_collide(spark):
    rows = [("a", None, "b"), ("a", "b", None), ("a|b", "c", "d"), ("a", "b|c", "d"), ("a", "\\N", "b"), ("a", "b", "c")]
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string, z string").select(key_text(["x", "y", "z"])).collect()]
    assert len(set(got)) == len(rows) and got[-1] == "a|b|c"


def test_long_distances(spark):
    def dist(x1, y1, x2, y2):
        return spark.range(1).select(geo.dist_m(*(F.lit(float(v)) for v in (x1, y1, x2, y2)))).first()[0]

    assert abs(dist(0, 0, 90, 0) - 6378137 * math.pi / 2) < 1
    assert abs(dist(0, 0, 0, 90) - 10001965.7) < 100
    assert abs(dist(179.9, 0, -179.9, 0) - 6378137 * math.radians(0.2)) < 1


def test_natural_sort_of_long_numbers(spark):
    vals = ["A" + "9" * 45, "A1" + "0" * 45, "A007", "A8", "A"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.v for r in df.orderBy(*[k.asc_nulls_last() for k in natural_keys(F.col("v"))]).collect()]
    assert got == ["A007", "A8", "A" + "9" * 45, "A1" + "0" * 45, "A"]


def test_no_job_while_a_page_is_planned(spark, cat):
    sc = spark.sparkContext

    def build():
        return ListQuery(cat, "customer", fields=["c_custkey", "nation.n_name", "orders.o_orderkey"], filters="orders.o_totalprice > 1000",
                         sort="nation.n_name,c_name*", page=2, page_size=5).build()

    build()  # reads the schemas of the tables
    sc.setJobGroup("planning", "planning")
    try:
        df = build()
        assert list(sc.statusTracker().getJobIdsForGroup("planning")) == []
        assert len(df.collect()) == 5
        assert list(sc.statusTracker().getJobIdsForGroup("planning"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
