import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.functions.types import row_hash
from relata.operators.aggregates import observe_counts
from relata.operators.changes import cascade_delete, is_changed, stamp
from relata.operators.sets import merge_lists
from relata.plans.ingest import ImportResult, map_fields, run_record
from relata.plans.list_query import FieldError, ListQuery, check_fields


def test_is_changed_deep(spark):
    st = T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())]))
    df = spark.createDataFrame([
        ([(1, "a"), (2, "b")], [(2, "b"), (1, "a")]),   # same records, other order: unchanged
        ([(1, "a")], [(1, "z")]),                        # a value changed
        ([(1, "a")], [(1, "a"), (1, "a")]),              # sizes differ
        (None, None),
    ], T.StructType([T.StructField("old", st), T.StructField("new", st)]))
    got = [r.c for r in df.select(is_changed(F.col("old"), F.col("new"), st).alias("c")).collect()]
    assert got == [False, True, True, False]
    s = spark.createDataFrame([(1, "1"), (None, None), (2, None)], "a long, b string")
    assert [r.c for r in s.select(is_changed(F.col("a"), F.col("b"), T.LongType()).alias("c")).collect()] == [False, False, True]


def test_cascade_stamp_hash_merge(spark):
    kids = spark.createDataFrame([(1, 10), (2, 20), (3, 10)], "id long, parent long")
    parents = spark.createDataFrame([(10,)], "pk long")
    assert sorted(r.id for r in cascade_delete(kids, "parent", parents, "pk").collect()) == [1, 3]
    df = spark.createDataFrame([(1, None)], "id long, created timestamp_ntz")
    r = stamp(df, "created", "updated", "2024-05-01 10:00:00").first()
    assert str(r.created) == str(r.updated) == "2024-05-01 10:00:00"
    h = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "x long, y string").select(row_hash(F.col("x"), F.col("y")).alias("h")).collect()
    assert h[0].h == h[1].h != h[2].h
    m = spark.createDataFrame([([1, 2], [2, 3])], "a array<int>, b array<int>").select(merge_lists(F.col("a"), F.col("b")).alias("m")).first().m
    assert m == [1, 2, 3]


def test_observe_counts_and_run_record(spark):
    df, obs = observe_counts(spark.range(10), "stage")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 10
    r = ImportResult(status="DONE", res={"nb_data": 3}, steps={"init": 0.1}, last_step="relations_data")
    row = run_record(spark, r, "run-1", "a.csv").first()
    assert (row.status, row.last_step) == ("DONE", "relations_data") and '"nb_data": 3' in row.res


def test_mapping_where_and_field_checks(spark, cat):
    df = spark.createDataFrame([(1, "keep"), (2, "drop")], "id_import long, kind string")
    assert [r.kind for r in map_fields(df, {}, None, "kind != 'drop'").collect()] == ["keep"]
    check_fields(cat, "customer", ["c_name", "nation.n_name", "orders.o_orderkey", "scope"])
    with pytest.raises(FieldError):
        check_fields(cat, "customer", ["no_such"])
    with pytest.raises(FieldError):
        check_fields(cat, "customer", ["c_name", "c_acctbal"], allowed=["c_name"])


def test_load_only_never_emitted(spark, cat):
    sd = cat.schema("supplier")
    sd.load_only.append("s_acctbal")
    try:
        out = ListQuery(cat, "supplier", fields=["s_suppkey", "s_acctbal"], page_size=3).build()
        assert out.columns == ["s_suppkey"]
    finally:
        sd.load_only.remove("s_acctbal")
