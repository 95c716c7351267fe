import json
import os

import pytest
from pyspark.sql import functions as F

from relata.operators import geo
from relata.plans.list_query import FieldError, ListQuery
from relata.sources.sinks import export_csv, feature_collection, write_geojson, write_nested_json


def test_csv_geojson_json_roundtrip(spark, cat, tmp_path):
    page = ListQuery(cat, "customer", fields=["c_custkey", "nation.n_name", "orders.o_orderkey"], sort="c_custkey", page_size=5).build()
    p = str(tmp_path / "csv")
    export_csv(page, p, sep=";", single_file=True)
    back = spark.read.option("header", True).option("sep", ";").csv(p)
    assert back.columns == ["c_custkey", "nation.n_name", "orders"] and back.count() == 5
    first = back.orderBy(F.col("c_custkey").cast("long")).first()
    assert "," in first["orders"] or first["orders"].isdigit()
    pts = cat.frame("customer").select("c_custkey", cat.schema("customer").computed["geom"](cat.frame("customer")).alias("geom")).limit(3)
    gp = str(tmp_path / "geo")
    write_geojson(pts, "geom", gp)
    lines = [json.loads(l) for f in os.listdir(gp) if f.endswith(".txt") for l in open(os.path.join(gp, f))]
    assert len(lines) == 3 and all(x["geometry"]["type"] == "Point" and "c_custkey" in x["properties"] for x in lines)
    fc = json.loads(feature_collection(pts, "geom").first().geojson)
    assert fc["type"] == "FeatureCollection" and len(fc["features"]) == 3
    jp = str(tmp_path / "json")
    write_nested_json(page, jp)
    rows = spark.read.json(jp).collect()
    assert len(rows) == 5 and rows[0]["orders"] is not None


def test_geojson_back_to_geometry(spark):
    df = spark.createDataFrame([("POLYGON((0 0,1 0,1 1,0 0))",), ("MULTILINESTRING((0 0,1 1),(2 2,3 3))",)], "w string")
    # each step bound to a column: geometry functions read their input several times
    d = df.withColumn("g", geo.parse_wkt(F.col("w")))
    d = d.withColumn("j", geo.to_geojson_geometry(F.col("g"))).withColumn("g2", geo.from_geojson(F.col("j")))
    back = d.select(geo.to_wkt(F.col("g2")).alias("t"), geo.to_wkt(F.col("g")).alias("w2")).collect()
    assert all(r.t == r.w2 for r in back)


def test_strict_fields(cat):
    with pytest.raises(FieldError):
        ListQuery(cat, "customer", fields=["c_name", "nope"], strict=True)
