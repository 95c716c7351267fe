from pyspark.sql import Window
from pyspark.sql import functions as F

from relata.functions.text import natural_keys
from relata.operators.ordering import page, with_row_number


def test_row_number_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v"), F.col("id"))
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = with_row_number(df, order, "rn", partitions=7)
    exp = df.withColumn("rn2", F.row_number().over(Window.orderBy(*order)))
    bad = got.join(exp, ["v", "id"]).filter(F.col("rn") != F.col("rn2")).count()
    assert bad == 0 and got.count() == 5000


def test_deep_page_equals_offset(spark):
    import relata.operators.ordering as o

    df = spark.range(0, 3000).select(((F.col("id") * 31) % 997).alias("v"), "id")
    order = [F.col("v").asc(), F.col("id").asc()]
    old = o.DEEP_PAGE_ROWS
    try:
        o.DEEP_PAGE_ROWS = 100
        deep = [tuple(r) for r in page(df, order, 40, 25).collect()]
    finally:
        o.DEEP_PAGE_ROWS = old
    shallow = [tuple(r) for r in page(df, order, 40, 25).collect()]
    assert deep == shallow and len(deep) == 25


def test_natural_sort(spark):
    vals = ["A10", "A7", "A1", "B2", None, "10", "N10", "N9"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    keys = natural_keys(F.col("v"), True)
    got = [r.v for r in df.orderBy(*[k.asc_nulls_last() for k in keys]).collect()]
    assert got == ["A1", "A7", "A10", "B2", "N9", "N10", "10", None]
