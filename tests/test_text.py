from pyspark.sql import functions as F

from relata.functions.text import before_first, json_of, like_value, unaccent, unaccent_py
from relata.functions.types import content_uuid, fits_type


def test_unaccent(spark):
    s = "Éléphant Straße œuvre Ærø ñandú"
    assert unaccent_py(s) == "Elephant Strasse oeuvre AEro nandu"
    got = spark.createDataFrame([(s,)], "t string").select(unaccent(F.col("t")).alias("u")).first().u
    assert got == unaccent_py(s)


def test_like_value():
    assert like_value("a_b") == "%a\\_b%"
    assert like_value("ab%") == "ab%"


def test_fits_type(spark):
    rows = [("12", "integer", True), ("12.5", "integer", False), (" 671 ", "integer", True), ("x", "number", False),
            ("2024-02-30", "date", False), ("t", "boolean", True), ("maybe", "boolean", False),
            ("0a1b2c3d-0000-4000-8000-000000000001", "uuid", True), ("nope", "uuid", False),
            ('{"a": 1}', "json", True), ("{a", "json", False), ("POINT(1 2)", "geometry", True),
            ("Pointage (1 2)", "geometry", False), (None, "integer", True), ("1", "unknown", False)]
    for v, t, ok in rows:
        got = spark.createDataFrame([(v,)], "v string").select(fits_type(F.col("v"), t).alias("ok")).first().ok
        assert got is ok, (v, t)


def test_before_first_and_json(spark):
    df = spark.createDataFrame([("a.b.c", None), ("abc", "x")], "s string, t string")
    out = df.select(before_first(F.col("s"), ".").alias("p"), json_of(["s", "t"]).alias("j")).collect()
    assert [r.p for r in out] == ["a", ""]
    assert out[0].j == '{"s":"a.b.c","t":""}'


def test_content_uuid_deterministic(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    u1 = df.select(content_uuid("r1", F.col("x"), F.col("y")).alias("u")).first().u
    u2 = df.select(content_uuid("r1", F.col("x"), F.col("y")).alias("u")).first().u
    assert u1 == u2 and len(u1) == 36
