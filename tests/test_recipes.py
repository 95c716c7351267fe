from pyspark.sql import functions as F

from relata.operators import geo
from relata.plans import recipes


def _line(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_roads(spark):
    seg = spark.createDataFrame([
        (1, "TRONROUT0000001", "a/b", "Nationale", 7.0, None), (2, "TRONROUT0000001", "a/b", "Nationale", 7.0, None),
        (3, "TRONROUT0000002", "c", "Départementale", 5.0, None)],
        "gid long, id string, id_rn string, cl_admin string, largeur double, geom string")
    names = spark.createDataFrame([
        (1, "a", "N7", "Nationale", "State"), (2, "b", "N8", "Nationale", "State"), (3, "c", "D12", "Départementale", "Savoie")],
        "gid long, id string, numero string, type_route string, gestion string")
    areas = spark.createDataFrame([("Savoie", "73")], "area_name string, area_code string")
    groups, linear = recipes.roads(seg, names, areas)
    g = {(r.code, r.name) for r in groups.collect()}
    assert g == {("N7", "Nationale N7"), ("N8", "Nationale N8"), ("D12 (73)", "Départementale D12 (73)")}
    lin = {r.linear_code: r for r in linear.collect()}
    assert lin["TRONROUT0000001"].groups == "N7,N8" and lin["TRONROUT0000001"].id_type == "RT_NAT"
    assert lin["TRONROUT0000002"].linear_name == "D12 (73) TR 2"


def test_lines_within_and_railways(spark):
    status = spark.createDataFrame([("L1", "Line one", [{"x": 0.0, "y": 0.0}, {"x": 100.0, "y": 0.0}])],
                                   "code_ligne string, lib_ligne string, line array<struct<x:double,y:double>>")
    kinds = spark.createDataFrame([("L1", "Ligne à grande vitesse"), ("L1", "Autre")], "code_ligne string, catlig string")
    segs = spark.createDataFrame([
        (1, "s1", "LGV", [{"x": 10.0, "y": 5.0}, {"x": 20.0, "y": 5.0}]),
        (2, "s2", "LGV", [{"x": 10.0, "y": 50.0}, {"x": 20.0, "y": 50.0}]),
        (3, "s3", "Voie de service", [{"x": 50.0, "y": -30.0}, {"x": 50.0, "y": 30.0}])],
        "gid long, id string, nature string, line array<struct<x:double,y:double>>")
    groups, out = recipes.railways(status, kinds, segs, r=10.0)
    assert groups.first().name == "LGV_L1 Line one"
    got = {r.linear_code: r.id_type for r in out.collect()}
    assert got == {"s1": "VF_LGV", "s3": "VF_P"}  # s3 crosses the line: distance 0


def test_waterways_markers_observations(spark):
    seg = spark.createDataFrame([(1, "r1/r2", None), (2, "r9", "Canal")], "id long, id_ce string, nom string")
    riv = spark.createDataFrame([("r1", "Isère"), ("r2", "Arc")], "id string, toponyme string")
    assert {r.id: r.name for r in recipes.waterways(seg, riv).collect()} == {1: "Arc, Isère", 2: "Canal"}
    pts = spark.createDataFrame([(1, "p", "A43", "12", "D", "PR", "Savoie", "MULTIPOINT((1 1),(2 2))"),
                                 (2, "p", "A43", "12", "D", "PR", "Savoie", "MULTIPOINT((1 1),(2 2))")],
                                "gid long, id string, route string, numero string, cote string, type string, dept_name string, w string")
    pts = pts.withColumn("geom", geo.parse_wkt(F.col("w"))).drop("w")
    areas = spark.createDataFrame([("Savoie", "73")], "area_name string, area_code string")
    m = recipes.markers(pts, areas, ["PR"]).collect()
    assert len(m) == 2 and {r.dept for r in m} == {"73"} and m[0].additional_data == '{"numero":"12","cote":"D"}'
    g = spark.createDataFrame([("o1", "POINT", "exact")], "id_obs string, geom string, precision string")
    d = spark.createDataFrame([("o1.1", 42, False, 10.5), ("o1.2", 43, True, 1.0)], "id_obs string, cd_nom long, sensitive boolean, altitude double")
    obs = recipes.observations(g, g.limit(0), g.limit(0), d).collect()
    assert [(r.cd_nom, float(r.altitude)) for r in obs] == [(42, 11.0)]


def test_merge_routes_and_profile(spark):
    a = spark.createDataFrame([("A 43", "POINT(1 1)"), ("N 7", "POINT(2 2)")], "numero string, w string").select("numero", geo.parse_wkt(F.col("w")).alias("geom"))
    b = spark.createDataFrame([("A 43", "POINT(3 3)")], "numero string, w string").select("numero", geo.parse_wkt(F.col("w")).alias("geom"))
    m = {r.code: (r.id_type, len(r.geom.parts)) for r in recipes.merge_routes(a, b).collect()}
    assert m == {"A43": ("RT_AUT", 2), "N7": ("RT_NAT", 1)}
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k long, v string")
    p = recipes.profile(df, ["v"], "k", spark.createDataFrame([(2,)], "k long"))
    assert [tuple(r) for r in p["frequencies"].collect()] == [("x", 2), ("y", 1)]
    assert [r.k for r in p["duplicated_keys"].collect()] == [1]
    assert sorted(r.k for r in p["unmatched"].collect()) == [1, 1]


def test_lines_within_brute_force(spark):
    import math
    import random

    rnd = random.Random(2)
    A = [(i, [(rnd.uniform(0, 20), rnd.uniform(0, 20)) for _ in range(rnd.randint(2, 4))]) for i in range(40)]
    B = [(j, [(rnd.uniform(0, 20), rnd.uniform(0, 20)) for _ in range(rnd.randint(2, 4))]) for j in range(40)]
    r = 0.7

    def sd(p, a, b):
        vx, vy = b[0] - a[0], b[1] - a[1]
        l2 = vx * vx + vy * vy
        t = 0.0 if l2 == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * vx + (p[1] - a[1]) * vy) / l2))
        return math.hypot(p[0] - (a[0] + t * vx), p[1] - (a[1] + t * vy))

    def cross(a, b, c, d):
        o = lambda p, q, s: (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])
        return o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0

    exp = set()
    for i, la in A:
        for j, lb in B:
            best = min(0.0 if cross(a, b, c, d) else min(sd(a, c, d), sd(b, c, d), sd(c, a, b), sd(d, a, b))
                       for a, b in zip(la, la[1:]) for c, d in zip(lb, lb[1:]))
            if best <= r:
                exp.add((i, j))
    to_df = lambda rows, k: spark.createDataFrame([(x, [{"x": p[0], "y": p[1]} for p in v]) for x, v in rows], f"{k} long, line array<struct<x:double,y:double>>")
    got = {(x.aid, x.bid) for x in recipes.lines_within(to_df(A, "aid"), to_df(B, "bid"), r).collect()}
    assert got == exp and len(exp) > 20


def test_cell_join_shuffles_a_side_once(spark):
    """Crowded keys are broadcast: neither side of the join is shuffled for their sake."""
    a = spark.range(4000).select((F.col("id") % 7).alias("cx"), F.lit(0).cast("long").alias("cy"), F.col("id").alias("a"))
    b = spark.range(40).select((F.col("id") % 7).alias("cx"), F.lit(0).cast("long").alias("cy"), F.col("id").alias("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (100, 100_000):
            j = geo.meet(a, b, ["cx", "cy"], rows, 2)
            assert j._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(cx") == 2
            assert {(r.a, r.b) for r in j.collect()} == {(x, y) for x in range(4000) for y in range(40) if x % 7 == y % 7}
            assert j.count() == sum(1 for x in range(4000) for y in range(40) if x % 7 == y % 7)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_short_segments_go_to_few_cells(spark):
    segs = spark.createDataFrame([(25.0, 5.0, 25.0, 10.0), (3.0, 1.0, 8.0, 17.0)], "ax double, ay double, bx double, by double")
    cells = [(r.cx, r.cy) for r in geo.segment_cell_rows(segs, 20.0, reach=10.0).filter("ax = 25").collect()]
    assert len(cells) == len(set(cells)) and set(cells) == {(0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)}
