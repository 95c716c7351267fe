from pyspark.sql import functions as F

from relata.operators import geo


def _shapes(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, w string").select(key, geo.parse_wkt(F.col("w")).alias("geom"))


AREAS = [
    (1, "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"),
    (2, "POLYGON((10 0,20 0,20 10,10 10,10 0))"),
    (3, "POLYGON((30 0,34 4,30 8,26 4,30 0))"),
]


def _links(spark, rows, cell=2.0):
    got = geo.intersecting_areas(_shapes(spark, rows, "pid"), _shapes(spark, AREAS, "aid"), cell).collect()
    pairs = {(r.pid, r.aid) for r in got}
    assert len(pairs) == len(got)
    return pairs


def test_lines_meet_areas(spark):
    assert _links(spark, [
        (1, "LINESTRING(1 1,2 2)"),  # inside
        (2, "LINESTRING(-5 5,25 5)"),  # through two areas and a hole
        (3, "LINESTRING(4.5 4.5,5.5 5.5)"),  # in the hole
        (4, "LINESTRING(0 0,10 10)"),  # corner to corner, no crossing inside an edge
        (5, "LINESTRING(10 -5,10 15)"),  # along the common border
        (6, "LINESTRING(-5 -5,0 0)"),  # touches a corner
        (7, "LINESTRING(26 4,34 4)"),  # corner to corner of the slanted square
        (8, "LINESTRING(30 0,34 4)"),  # along a slanted edge
        (9, "MULTILINESTRING((40 0,41 0),(15 5,16 5))"),
        (10, "LINESTRING(40 40,50 50)"),
    ]) == {(1, 1), (2, 1), (2, 2), (4, 1), (7, 3), (9, 2)}


def test_polygons_meet_areas(spark):
    assert _links(spark, [
        (1, "POLYGON((1 1,2 1,2 2,1 2,1 1))"),  # inside
        (2, "POLYGON((-5 -5,50 -5,50 50,-5 50,-5 -5))"),  # holds all
        (3, "POLYGON((4 4,6 4,6 6,4 6,4 4))"),  # fills the hole
        (4, "POLYGON((10 0,10 10,20 10,20 0,10 0))"),  # equal to area 2, the other way round
        (5, "POLYGON((20 0,25 0,25 5,20 5,20 0))"),  # touches area 2 along a border
        (6, "POLYGON((8 8,12 8,12 9,8 9,8 8))"),  # over the common border
        (7, "POLYGON((3 3,7 3,7 7,3 7,3 3))"),  # around the hole
        (8, "MULTIPOLYGON(((40 0,41 0,41 1,40 0)),((30 3,31 4,30 5,30 3)))"),
    ]) == {(1, 1), (2, 1), (2, 2), (2, 3), (4, 2), (6, 1), (6, 2), (7, 1), (8, 3)}


def test_points_meet_areas_and_nulls(spark):
    assert _links(spark, [(1, "POINT(1 1)"), (2, "POINT(5 5)"), (3, "MULTIPOINT((5 5),(15 5))"), (4, None)]) == {(1, 1), (3, 2)}


def test_box_and_distance_of_shapes(spark):
    df = _shapes(spark, [
        (1, "LINESTRING(-5 5,15 5)"),  # through the box, no vertex in it
        (2, "LINESTRING(-5 5,5 15.1)"),  # envelope only
        (3, "POLYGON((-5 -5,50 -5,50 50,-5 50,-5 -5))"),  # holds the box
        (4, "POLYGON((-5 -5,50 -5,50 50,-5 50,-5 -5),(-1 -1,11 -1,11 11,-1 11,-1 -1))"),  # the box lies in the hole
        (5, "MULTIPOINT((-1 -1),(11 11))"), (6, "MULTIPOINT((-1 -1),(10 10))"), (7, "POINT(0 5)"), (8, "POINT(0 11)"),
    ], "pid")
    assert {r.pid for r in df.filter(geo.filter_atom(F.col("geom"), "bbox", "0;0;10;10", None)).collect()} == {1, 3, 6, 7}
    near = _shapes(spark, [
        (1, "LINESTRING(4 45.01,6 45.01)"),  # about 1.1 km north, its vertices far away
        (2, "LINESTRING(4 45.1,6 45.1)"), (3, "POLYGON((4 44,6 44,6 46,4 46,4 44))"), (4, "POINT(5 45.001)"),
        (5, "POLYGON((4 44,6 44,6 46,4 46,4 44),(4.5 44.5,5.5 44.5,5.5 45.5,4.5 45.5,4.5 44.5))"), (6, "MULTIPOINT((9 9),(5 45))"),
    ], "pid")
    assert {r.pid for r in near.filter(geo.filter_atom(F.col("geom"), "dwithin", "5;45;2000", None)).collect()} == {1, 3, 4, 6}


def test_crowded_key_is_split(spark):
    left = spark.range(1000).select((F.col("id") % 2 * 0 + F.when(F.col("id") < 900, 1).otherwise(2)).alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    split, plain = geo.meet(left, right, ["k"], rows=50), left.join(right, ["k"])
    assert sorted(map(tuple, split.select("k", "id", "v").collect())) == sorted(map(tuple, plain.select("k", "id", "v").collect()))


def test_one_point_tells_whether_a_part_is_held(spark):
    """Each part of an area has one point inside it; a polygon around parts is found by these, whatever else crosses the area."""
    wide = [(4, "MULTIPOLYGON(((40 0,42 0,42 2,40 2,40 0)),((50 0,50 2,52 2,52 0,50 0),(50.5 0.5,51.5 0.5,51.5 1.5,50.5 1.5,50.5 0.5)))")]
    areas = _shapes(spark, AREAS + wide, "aid")
    inside = geo._inside_points(areas)
    assert inside.groupBy("pid").count().collect() and {r.pid: r["count"] for r in inside.groupBy("pid").count().collect()} == {1: 1, 2: 1, 3: 1, 4: 2}
    assert {(r.pid, r.aid) for r in geo.points_in_polygons(inside, areas, 2.0).collect()} == {(i, i) for i in (1, 2, 3, 4)}
    shapes = _shapes(spark, [
        (1, "POLYGON((39 -1,43 -1,43 3,39 3,39 -1))"),  # around the first part
        (2, "POLYGON((49 -1,53 -1,53 3,49 3,49 -1))"),  # around the part with a hole
        (3, "POLYGON((50.6 0.6,51.4 0.6,51.4 1.4,50.6 1.4,50.6 0.6))"),  # in the hole
        (4, "POLYGON((50.5 0.5,51.5 0.5,51.5 1.5,50.5 1.5,50.5 0.5))"),  # the hole itself
        (5, "POLYGON((-5 -5,60 -5,60 60,-5 60,-5 -5))"),  # around all
        (6, "POLYGON((44 0,48 0,48 2,44 2,44 0))"),  # between the parts
        (7, "POLYGON((40 0,42 0,42 2,40 2,40 0))"),  # the same as a part
    ], "pid")
    got = [(r.pid, r.aid) for r in geo.intersecting_areas(shapes, areas, 2.0).collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, 4), (2, 4), (5, 1), (5, 2), (5, 3), (5, 4), (7, 4)}
