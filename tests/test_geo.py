import math
import random

from pyspark.sql import functions as F

from relata.operators import geo


def _first(spark, expr, schema="s string", row=("x",)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


def test_parse_wkt_kinds(spark):
    cases = {
        "POINT(1 2)": ("POINT", 1),
        "SRID=2154;POINT Z (1 2 3)": ("POINT", 1),
        "LINESTRING (0 0, 1 1, 2 0)": ("LINESTRING", 3),
        "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 1))": ("POLYGON", 9),
        "MULTIPOINT((0 0),(1 1))": ("MULTIPOINT", 2),
        "MULTIPOINT(0 0, 1 1)": ("MULTIPOINT", 2),
        "MULTILINESTRING((0 0,1 1),(2 2,3 3))": ("MULTILINESTRING", 4),
        "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))": ("MULTIPOLYGON", 8),
    }
    df = spark.createDataFrame([(k,) for k in cases], "w string")
    rows = df.select("w", geo.parse_wkt(F.col("w")).alias("g")).collect()
    for r in rows:
        kind, n = cases[r.w]
        assert r.g.kind == kind and sum(len(ring) for part in r.g.parts for ring in part) == n, r.w
    bad = spark.createDataFrame([("Pointage (1 2)",), ("POINT(1)",), ("POLYGON((0 0, 1 1)",)], "w string")
    assert all(r.g is None for r in bad.select(geo.parse_wkt(F.col("w")).alias("g")).collect())


def test_wkt_roundtrip(spark):
    w = "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5),(5.2 5.1,5.3 5.1,5.3 5.2,5.2 5.1)))"
    df = spark.createDataFrame([(w,)], "w string")
    out = df.select(geo.to_wkt(geo.parse_wkt(F.col("w"))).alias("t")).first().t
    assert out.replace(" ", "") == w.replace(" ", "")


def test_reprojection_roundtrip(spark):
    df = spark.createDataFrame([(3.0, 46.5), (5.9, 45.56), (-1.5, 43.4)], "x double, y double")
    g = geo.make_point(F.col("x"), F.col("y"))
    back = geo.reproject(geo.reproject(g, 4326, 2154), 2154, 4326)
    l93 = geo.reproject(g, 4326, 2154)
    rows = df.select("x", "y", back.alias("b"), l93.alias("l")).collect()
    for r in rows:
        p = r.b.parts[0][0][0]
        assert abs(p.x - r.x) < 1e-9 and abs(p.y - r.y) < 1e-9
    # the projection origin maps to the false easting / northing
    o = rows[0].l.parts[0][0][0]
    assert abs(o.x - 700000) < 1e-6 and abs(o.y - 6600000) < 1e-6


def test_distance(spark):
    d = _first(spark, geo.dist_m(F.lit(5.0), F.lit(45.0), F.lit(5.0), F.lit(45.01)))
    assert abs(d - 1111.4) < 2.0  # one hundredth of a degree of latitude at 45N


def test_grid_join_equals_brute_force(spark):
    rnd = random.Random(7)
    pts = [(i, rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(400)]
    lines = []
    for j in range(40):
        x, y = rnd.uniform(0, 10), rnd.uniform(0, 10)
        verts = [(x, y)]
        for _ in range(rnd.randint(0, 4)):
            x, y = x + rnd.uniform(-3, 3), y + rnd.uniform(-3, 3)
            verts.append((x, y))
        lines.append((j, verts))
    r = 0.4
    P = spark.createDataFrame(pts, "pid long, x double, y double")
    L = spark.createDataFrame([(j, [{"x": a, "y": b} for a, b in v]) for j, v in lines], "lid long, line array<struct<x:double,y:double>>")
    got = {(x.pid, x.lid) for x in geo.join_within(P, L, r).collect()}

    def seg(px, py, a, b):
        vx, vy = b[0] - a[0], b[1] - a[1]
        l2 = vx * vx + vy * vy
        t = 0.0 if l2 == 0 else max(0.0, min(1.0, ((px - a[0]) * vx + (py - a[1]) * vy) / l2))
        return math.hypot(px - (a[0] + t * vx), py - (a[1] + t * vy))

    exp = set()
    for pid, x, y in pts:
        for j, v in lines:
            d = min(seg(x, y, v[k], v[k + 1]) for k in range(len(v) - 1)) if len(v) > 1 else math.hypot(x - v[0][0], y - v[0][1])
            if d <= r:
                exp.add((pid, j))
    assert got == exp and len(exp) > 20


def test_points_in_polygons_with_hole(spark):
    area = "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"
    A = spark.createDataFrame([(1, area)], "aid long, w string").select("aid", geo.parse_wkt(F.col("w")).alias("geom"))
    P = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 5.0), (4, 9.5, 9.5)], "pid long, x double, y double")
    got = {r.pid for r in geo.points_in_polygons(P, A, 1.0).collect()}
    assert got == {1, 4}


def test_nearest_per_type(spark):
    pairs = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.2), (1, 12, 0.1), (2, 10, 0.3)], "pid long, lid long, dist double")
    lines = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b")], "lid long, type string")
    got = {(r.pid, r.type, r.lid) for r in geo.nearest_per_type(pairs, lines).collect()}
    assert got == {(1, "a", 11), (1, "b", 12), (2, "a", 10)}


def test_points_in_large_polygon_relational(spark):
    # a 400-vertex star-shaped polygon takes the relational path; compare with a direct parity test
    n = 400
    ring = []
    for i in range(n):
        ang = 2 * math.pi * i / n
        rad = 5 + (2 if i % 2 else 0)
        ring.append((10 + rad * math.cos(ang), 10 + rad * math.sin(ang)))
    ring.append(ring[0])
    w = "POLYGON((" + ",".join(f"{x} {y}" for x, y in ring) + "))"
    A = spark.createDataFrame([(1, w)], "aid long, w string").select("aid", geo.parse_wkt(F.col("w")).alias("geom"))
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(2, 18), rnd.uniform(2, 18)) for i in range(500)]
    P = spark.createDataFrame(pts, "pid long, x double, y double")
    got = {r.pid for r in geo.points_in_polygons(P, A, 1.0, relational=True).collect()}
    got_inline = {r.pid for r in geo.points_in_polygons(P, A, 1.0).collect()}

    def inside(x, y):
        c = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                c = not c
        return c

    exp = {i for i, x, y in pts if inside(x, y)}
    assert got == exp == got_inline and 50 < len(exp) < 450


def test_grid_join_salted_hot_cell(spark):
    # a third of the points sit in one cell: salting that cell must not change the result
    rnd = random.Random(11)
    pts = [(i, rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(300)]
    pts += [(1000 + i, 5.05 + rnd.uniform(0, 0.05), 5.05 + rnd.uniform(0, 0.05)) for i in range(150)]
    lines = [(j, [{"x": rnd.uniform(0, 10), "y": rnd.uniform(0, 10)} for _ in range(3)]) for j in range(30)]
    lines.append((99, [{"x": 5.0, "y": 5.0}, {"x": 5.2, "y": 5.2}]))
    P = spark.createDataFrame(pts, "pid long, x double, y double")
    L = spark.createDataFrame(lines, "lid long, line array<struct<x:double,y:double>>")
    plain = {(r.pid, r.lid, round(r.dist, 12)) for r in geo.join_within(P, L, 0.3).collect()}
    salted = {(r.pid, r.lid, round(r.dist, 12)) for r in geo.join_within(P, L, 0.3, hot_cell_rows=50, salt=8).collect()}
    assert plain == salted and sum(1 for p, l, _ in plain if l == 99) >= 150


def test_collection_in_long_form(spark):
    """Summary and parts agree with the value that ``collect`` builds, mixed kinds and missing geometries included."""
    w = [("a", "POINT(1 2)"), ("a", "MULTIPOINT((3 4),(-1 0))"), ("a", "POINT(1 2)"), ("b", "POINT(0 0)"), ("b", "LINESTRING(0 0, 5 6)"), ("c", None),
         ("c", "POLYGON((0 0,4 0,4 4,0 0))"), ("d", None), (None, "POINT(7 7)")]
    df = spark.createDataFrame(w, "k string, w string").select("k", geo.parse_wkt(F.col("w")).alias("geom"))
    values = {r.k: r.geom for r in geo.collect(df, ["k"], "geom").collect()}
    summary = {r.k: r for r in geo.collect_summary(df, ["k"], "geom").collect()}
    parts = geo.collect_parts(df, ["k"], "geom").collect()
    assert values.keys() == summary.keys() == {"a", "b", "c", "d", None}
    for k, g in values.items():
        mine = [r.part for r in parts if r.k == k]
        assert (summary[k].kind, summary[k].srid, summary[k].n_parts) == (g.kind, g.srid, len(g.parts)) and len(mine) == len(g.parts)
        assert sorted(str(p.parts[0]) for p in mine) == sorted(map(str, g.parts)) and all(len(p.parts) == 1 for p in mine)
        if g.parts:
            assert summary[k].bbox == g.bbox
    assert [r.part.kind for r in parts if r.k == "a"] == ["POINT"] * 4


def test_no_query_gathers_a_group_of_geometries(spark):
    from relata.queries import QUERIES

    for name in ("collect_geom", "explode_parts", "recipe_routes"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan, name


def test_nearest_search_on_halved_cells(spark, monkeypatch):
    """Halving the cells changes the work and not the answer: copies of a line, ties, crowded spots and points far away."""
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(0, 4), rnd.uniform(0, 4)) for i in range(500)] + [(500 + i, 1.5, 1.5) for i in range(100)] + [(700, 50.0, 50.0), (701, -1.0, -0.2)]
    lines = [(j, j % 3, [{"x": rnd.uniform(-1, 4), "y": rnd.uniform(-1, 4)} for _ in range(rnd.randint(1, 3))]) for j in range(60)]
    lines += [(100 + j, k, line) for j, k, line in lines[:20]]
    P = spark.createDataFrame(pts, "pid long, x double, y double")
    L = spark.createDataFrame(lines, "lid long, type long, line array<struct<x:double,y:double>>")
    pairs = geo.join_within(P, L, 0.5)
    exp = {(r.pid, r.type, r.lid, r.dist) for r in geo.nearest_per_type(pairs, L).collect()}
    monkeypatch.setattr(geo, "NEAREST_CELL_POINTS", 0.05)
    cells = P.select(geo._cell(F.col("x"), 0.5).alias("cx"), geo._cell(F.col("y"), 0.5).alias("cy"))
    assert geo._halvings(cells) >= 3
    got = geo.nearest_within(P, L, 0.5).collect()
    assert {(r.pid, r.type, r.lid, r.dist) for r in got} == exp and len(got) == len(exp) > 1000


def test_pairs_within_come_out_of_the_join_once(spark):
    """Points with several positions, ids that repeat or are missing and lines with many short segments, all against brute force."""
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(0, 2), rnd.uniform(0, 2)) for i in range(150)]
    pts += [(i, rnd.uniform(0, 2), rnd.uniform(0, 2)) for i in range(0, 30)] + pts[40:50]  # elsewhere too, or twice
    pts += [(None, 0.5, 0.5), (None, 1.5, 1.2), (900, None, 1.0), (3, None, None), (901, float("nan"), 1.0)]
    walk = [(j, [(1 + j / 9 + k * 0.011, 1 + 0.03 * (k % 3)) for k in range(40)]) for j in range(5)]  # many segments in a cell
    lines = walk + [(10 + j, [(rnd.uniform(0, 2), rnd.uniform(0, 2)) for _ in range(rnd.randint(1, 4))]) for j in range(30)]
    lines += [(10, [(0.1, 0.1), (0.3, 0.2)]), lines[7], (None, [(0.4, 0.4), (0.9, 0.5)]), (None, [(1.4, 1.4)])]
    P = spark.createDataFrame(pts, "pid long, x double, y double")
    L = spark.createDataFrame([(j, [{"x": a, "y": b} for a, b in v]) for j, v in lines], "lid long, line array<struct<x:double,y:double>>")
    segs = geo.line_segments(L)
    d = geo.seg_dist(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    every = P.crossJoin(segs).select("pid", "lid", d.alias("d")).groupBy("pid", "lid").agg(F.min("d").alias("d")).filter("d <= 0.3")
    exp = {tuple(r) for r in every.collect()}
    for rows in (4096, 20):
        got = [tuple(r) for r in geo.join_within(P, L, 0.3, hot_cell_rows=rows).collect()]
        assert set(got) == exp and len(got) == len(exp) > 1000


def test_pairs_within_are_not_aggregated(spark):
    """The pairs of ordinary points and lines, the bulk of the result, are neither grouped nor shuffled after the join."""
    P = spark.range(100).select(F.col("id").alias("pid"), (F.col("id") / 100).alias("x"), F.lit(0.0).alias("y"))
    L = spark.sql("SELECT 1L AS lid, array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 1.0D, 'y', 0.0D)) AS line")
    plan = geo.join_within(P, L, 0.1)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    above_join = plan.children().apply(0).toString().split("Join Inner")[0]
    assert "Aggregate" not in above_join


def test_round9_is_round(spark):
    rnd = random.Random(8)
    vals = [rnd.uniform(-1, 1) * 10 ** rnd.randint(-10, 8) for _ in range(20000)] + [(rnd.randint(-10**6, 10**6) + 0.5) / 1e9 for _ in range(5000)]
    vals += [0.0, -0.0, -1e-12, 1e-10, 5e-10, -5e-10, 999.9999999995, 1e3, 1e300, float("nan"), float("inf"), -float("inf"), None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert df.filter(~geo.round9(F.col("v")).eqNullSafe(F.round("v", 9))).collect() == []
