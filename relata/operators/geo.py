"""Geometry as native Spark expressions.

A geometry value is a struct::

    kind  string   POINT | LINESTRING | POLYGON | MULTIPOINT | MULTILINESTRING | MULTIPOLYGON
    srid  int
    parts array<array<array<struct<x double, y double>>>>   part -> ring/line -> vertex
    bbox  struct<xmin, ymin, xmax, ymax double>

Everything is built from ``regexp``/``split``/``transform``/``aggregate``,
so it stays inside whole-stage codegen; no Python runs per row.

Spatial joins use a grid: each side is exploded to the cells it may touch
(a bounded, data-independent fan-out per row), rows meet on an equi join of
the cell id, then an exact test runs on the candidates.  Duplicated
candidates (two shared cells) are merged by an aggregate that combines
map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GEOM_DDL = (
    "struct<kind:string,srid:int,parts:array<array<array<struct<x:double,y:double>>>>,"
    "bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
)

KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")

# WGS84 / GRS80 ellipsoid and the Lambert-93 (EPSG:2154) projection parameters.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
GRS80_E = 0.0818191910428158
L93_LAT1, L93_LAT2, L93_LAT0, L93_LON0 = 49.0, 44.0, 46.5, 3.0
L93_X0, L93_Y0 = 700000.0, 6600000.0


# ---------------------------------------------------------------- constructors
def _pt(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _bbox_of_parts(parts: Column) -> Column:
    pts = F.flatten(F.flatten(parts))
    xs = F.transform(pts, lambda p: p["x"])
    ys = F.transform(pts, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def make_geom(kind: Column, srid: Column, parts: Column) -> Column:
    """Geometry struct; ``parts`` is evaluated once (it is read for the bbox too)."""
    return bind(parts, lambda p: F.struct(kind.alias("kind"), srid.cast("int").alias("srid"), p.alias("parts"),
                                          _bbox_of_parts(p).alias("bbox")))


def make_point(x: Column, y: Column, srid: int = 4326) -> Column:
    """Point from x, y."""
    p = _pt(x, y)
    geom = F.struct(
        F.lit("POINT").alias("kind"),
        F.lit(srid).cast("int").alias("srid"),
        F.array(F.array(F.array(p))).alias("parts"),
        F.struct(x.cast("double").alias("xmin"), y.cast("double").alias("ymin"),
                 x.cast("double").alias("xmax"), y.cast("double").alias("ymax")).alias("bbox"),
    )
    return F.when(x.isNotNull() & y.isNotNull(), geom)


_NUM = r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def _xy(a: Column) -> Column:
    return F.struct(F.get(a, 0).alias("x"), F.get(a, 1).alias("y"))


def parse_wkt(text: Column, srid: int = 4326) -> Column:
    """WKT (optionally ``SRID=n;`` prefixed) -> geometry struct (G1); NULL when invalid.

    The coordinate list is rewritten to JSON arrays by one regex (``x y [z [m]]``
    -> ``[x,y]``: forced 2D; parentheses -> brackets) and read with
    ``from_json`` at the nesting depth the geometry kind implies; malformed
    text gives NULL.  Small expression, native functions.
    """
    t = F.trim(text)
    has_srid = F.upper(t).startswith("SRID=")
    srid_val = F.when(has_srid, F.regexp_extract(t, r"^(?i)SRID=(\d+);", 1).try_cast("int")).otherwise(F.lit(srid))
    body0 = F.when(has_srid, F.regexp_replace(t, r"^(?i)SRID=\d+;", "")).otherwise(t)
    kind = F.upper(F.regexp_extract(body0, r"^\s*([A-Za-z]+)", 1))
    rest = F.regexp_replace(body0, r"^\s*[A-Za-z]+\s*(?:[ZzMm]{1,2}\s*)?", "")
    js = F.regexp_replace(rest, rf"({_NUM})\s+({_NUM})(?:\s+{_NUM}){{0,2}}", "[$1,$2]")
    js = F.translate(F.regexp_replace(js, r"\s+", ""), "()", "[]")
    d2 = F.from_json(js, "array<array<double>>")
    d3 = F.from_json(js, "array<array<array<double>>>")
    d4 = F.from_json(js, "array<array<array<array<double>>>>")
    parts = (
        F.when((kind == "POINT") & (F.size(d2) == 1), F.array(F.array(F.transform(d2, _xy))))
        .when(kind == "LINESTRING", F.array(F.array(F.transform(d2, _xy))))
        .when(kind == "POLYGON", F.array(F.transform(d3, lambda r: F.transform(r, _xy))))
        .when(kind == "MULTIPOINT", F.coalesce(F.transform(d3, lambda p: F.array(F.transform(p, _xy))),
                                               F.transform(d2, lambda p: F.array(F.array(_xy(p))))))
        .when(kind == "MULTILINESTRING", F.transform(d3, lambda ln: F.array(F.transform(ln, _xy))))
        .when(kind == "MULTIPOLYGON", F.transform(d4, lambda pg: F.transform(pg, lambda r: F.transform(r, _xy))))
    )
    def build(p: Column) -> Column:
        pts = F.flatten(F.flatten(p))
        ok = (F.size(pts) > 0) & F.forall(pts, lambda q: q["x"].isNotNull() & q["y"].isNotNull())
        return F.when(p.isNotNull() & ok & rest.startswith("(") & srid_val.isNotNull(), make_geom(kind, srid_val, p))

    return bind(parts, build)


def bind(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` (a one-element ``transform``): keeps expressions
    that read a large input several times from copying that input into each reference."""
    return F.get(F.transform(F.array(expr), fn), 0)


def is_valid_wkt(text: Column) -> Column:
    return parse_wkt(text).isNotNull()


def _fmt(v: Column) -> Column:
    # shortest round-trip text of the double; integers without ".0"
    s = v.cast("string")
    return F.regexp_replace(s, r"\.0$", "")


def to_wkt(g: Column) -> Column:
    """Geometry -> WKT text."""
    def ring(r):
        return F.array_join(F.transform(r, lambda p: F.concat(_fmt(p["x"]), F.lit(" "), _fmt(p["y"]))), ",")

    def rings(part):
        return F.array_join(F.transform(part, lambda r: F.concat(F.lit("("), ring(r), F.lit(")"))), ",")

    parts = g["parts"]
    k = g["kind"]
    first = F.get(parts, 0)
    body = (
        F.when(k == "POINT", F.concat(F.lit("("), ring(F.get(first, 0)), F.lit(")")))
        .when(k == "LINESTRING", F.concat(F.lit("("), ring(F.get(first, 0)), F.lit(")")))
        .when(k == "POLYGON", F.concat(F.lit("("), rings(first), F.lit(")")))
        .when(k == "MULTIPOINT", F.concat(F.lit("("), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), ring(F.get(p, 0)), F.lit(")"))), ","), F.lit(")")))
        .when(k == "MULTILINESTRING", F.concat(F.lit("("), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), ring(F.get(p, 0)), F.lit(")"))), ","), F.lit(")")))
        .otherwise(F.concat(F.lit("("), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), rings(p), F.lit(")"))), ","), F.lit(")")))
    )
    return F.when(g.isNotNull(), F.concat(k, F.lit(" "), body))


def multi(g: Column) -> Column:
    """Wrap a single geometry as its multi form (G1 option, G10)."""
    k = g["kind"]
    nk = F.when(k.startswith("MULTI"), k).otherwise(F.concat(F.lit("MULTI"), k))
    return F.when(g.isNotNull(), make_geom(nk, g["srid"], g["parts"]))


def explode_parts(df: DataFrame, geom: str, out: str = "part") -> DataFrame:
    """Dump a multi-geometry to single parts."""
    single = F.regexp_replace(F.col(geom)["kind"], "^MULTI", "")
    return df.select(
        "*",
        F.posexplode(F.col(geom)["parts"]).alias("__pi", "__part"),
    ).withColumn(out, make_geom(single, F.col(geom)["srid"], F.array(F.col("__part")))).drop("__pi", "__part")


def collect_parts(df: DataFrame, by: list[str], geom: str, out: str = "part") -> DataFrame:
    """Union/collect per group (G10, A14) in long form: the group key and one single part a row.

    Nothing is gathered: a group may have any number of parts.
    """
    return explode_parts(df.select(*by, geom), geom, out).select(*by, out)


def _common_kind(geom: str) -> tuple[Column, Column]:
    """Aggregates: the collection's kind from the smallest and largest single kind, and its srid."""
    single = F.regexp_replace(F.col(geom)["kind"], "^MULTI", "")
    low, high = F.min(single), F.max(single)
    kind = F.when(low == high, F.concat(F.lit("MULTI"), low)).otherwise(F.lit("GEOMETRYCOLLECTION"))
    return kind, F.min(F.col(geom)["srid"])


def collect_summary(df: DataFrame, by: list[str], geom: str) -> DataFrame:
    """Per group ``kind, srid, n_parts, bbox`` of what ``collect`` would build, from map-side combined aggregates."""
    kind, srid = _common_kind(geom)
    box = F.col(geom)["bbox"]
    return df.groupBy(*by).agg(
        kind.alias("kind"), srid.alias("srid"), F.coalesce(F.sum(F.size(F.col(geom)["parts"])), F.lit(0)).cast("long").alias("n_parts"),
        F.struct(F.min(box["xmin"]).alias("xmin"), F.min(box["ymin"]).alias("ymin"),
                 F.max(box["xmax"]).alias("xmax"), F.max(box["ymax"]).alias("ymax")).alias("bbox"))


def collect(df: DataFrame, by: list[str], geom: str, out: str = "geom") -> DataFrame:
    """Union/collect per group (G10, A14) as one multi-geometry value, for the groups of a page.

    A value holds all parts of its group, so filter ``df`` to the page's groups
    first; ``collect_parts`` and ``collect_summary`` take any number of rows.
    Boundaries are not dissolved (collect only).  The kind is the common
    single kind, or a mixed collection flag when parts differ.
    """
    kind, srid = _common_kind(geom)
    agg = df.groupBy(*by).agg(F.flatten(F.collect_list(F.col(geom)["parts"])).alias("__parts"), kind.alias("__kind"), srid.alias("__srid"))
    return agg.select(*by, make_geom(F.col("__kind"), F.col("__srid"), F.col("__parts")).alias(out))


# ---------------------------------------------------------------- measures
def centroid(g: Column) -> Column:
    """Centroid (G4): area-weighted for polygons (holes subtract), length-weighted for lines, mean for points."""
    rings = F.flatten(g["parts"])
    pts = F.flatten(rings)
    edges = F.flatten(F.transform(rings, lambda r: F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r)).alias("b"))))

    def sum_over(f):
        return F.aggregate(F.transform(edges, f), F.lit(0.0), lambda acc, v: acc + v)

    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    # polygon: signed areas; rings of a part in opposite orientation subtract
    area2 = sum_over(cross)
    cx_p = sum_over(lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e)) / (3 * area2)
    cy_p = sum_over(lambda e: (e["a"]["y"] + e["b"]["y"]) * cross(e)) / (3 * area2)
    seg_len = lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2))
    total = sum_over(seg_len)
    cx_l = sum_over(lambda e: seg_len(e) * (e["a"]["x"] + e["b"]["x"]) / 2) / total
    cy_l = sum_over(lambda e: seg_len(e) * (e["a"]["y"] + e["b"]["y"]) / 2) / total
    n = F.size(pts)
    cx_m = F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p["x"]) / n
    cy_m = F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p["y"]) / n
    is_poly = g["kind"].endswith("POLYGON") & (area2 != 0)
    is_line = g["kind"].endswith("LINESTRING") & (total > 0)
    x = F.when(is_poly, cx_p).when(is_line, cx_l).otherwise(cx_m)
    y = F.when(is_poly, cy_p).when(is_line, cy_l).otherwise(cy_m)
    return F.struct(x.alias("x"), y.alias("y"))


def point_xy(g: Column) -> Column:
    """First vertex of a geometry (the point itself for points): cheap, codegen-friendly."""
    return F.get(F.get(F.get(g["parts"], 0), 0), 0)


#: Beyond this distance (m) the local formula of ``dist_m`` gives way to the one for long lines.
LOCAL_M = 50_000


def dist_m(x1: Column, y1: Column, x2: Column, y2: Column, reach: float | None = None) -> Column:
    """Distance in metres between lon/lat points.

    Below 50 km a local ellipsoidal approximation (radii of curvature at the
    mean latitude on WGS84, within 0.1 % of the geodesic), beyond it
    Lambert's formula for long lines (some ten metres on thousands of
    kilometres).  Longitudes go the short way round the antimeridian.
    ``reach`` says that distances are only compared with that many metres;
    within 50 km the cheap local formula then serves all rows.
    """
    turn = F.when(F.abs(x2 - x1) > 180, x2 - x1 - F.signum(x2 - x1) * 360).otherwise(x2 - x1)
    e2 = WGS84_F * (2 - WGS84_F)
    phi = F.radians((y1 + y2) / 2)
    s2 = F.pow(F.sin(phi), 2)
    w = F.sqrt(1 - e2 * s2)
    m_rad = WGS84_A * (1 - e2) / (w * w * w)
    n_rad = WGS84_A / w
    dx = F.radians(turn) * n_rad * F.cos(phi)
    dy = F.radians(y2 - y1) * m_rad
    near = F.sqrt(dx * dx + dy * dy)
    if reach is not None and reach < LOCAL_M:
        return near
    b1, b2 = (F.atan((1 - WGS84_F) * F.tan(F.radians(y))) for y in (y1, y2))
    mean, half = (b1 + b2) / 2, (b2 - b1) / 2
    hav = F.pow(F.sin(half), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(turn) / 2), 2)

    def measure(arc):
        flat = (arc - F.sin(arc)) * F.pow(F.sin(mean) * F.cos(half) / F.cos(arc / 2), 2) + (
            arc + F.sin(arc)) * F.pow(F.cos(mean) * F.sin(half) / F.sin(arc / 2), 2)
        return F.when(arc * WGS84_A < LOCAL_M, near).otherwise(WGS84_A * (arc - WGS84_F / 2 * flat))

    return bind(2 * F.asin(F.sqrt(F.least(hav, F.lit(1.0)))), measure)


def seg_dist(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance from point P to segment AB."""
    vx, vy = bx - ax, by - ay
    wx, wy = px - ax, py - ay
    len2 = vx * vx + vy * vy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wx * vx + wy * vy) / len2))).otherwise(F.lit(0.0))
    dx = px - (ax + t * vx)
    dy = py - (ay + t * vy)
    return F.sqrt(dx * dx + dy * dy)


def round9(v: Column) -> Column:
    """``round(v, 9)``; its way by decimal text is taken only where the tenth place is near a half, or for large values."""
    scaled = v * 1e9
    nearest = F.floor(scaled + 0.5)
    plain = (F.abs(v) < 1e3) & (F.abs(F.abs(scaled - nearest) - 0.5) > 1e-3)
    return F.when(plain, nearest / F.lit(1e9)).otherwise(F.round(v, 9))


def point_line_dist(px: Column, py: Column, line: Column) -> Column:
    """Planar distance from a point to a vertex list (a line)."""
    segs = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("a"), F.slice(line, 2, F.size(line)).alias("b"))
    d = F.transform(segs, lambda s: seg_dist(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))
    single = F.sqrt(F.pow(px - F.get(line, 0)["x"], 2) + F.pow(py - F.get(line, 0)["y"], 2))
    return F.when(F.size(line) > 1, F.array_min(d)).otherwise(single)


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray-casting parity test against one closed ring."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring)).alias("b"))

    def cross(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        straddle = (ay > py) != (by > py)
        xint = ax + (py - ay) * (bx - ax) / (by - ay)
        return F.when(straddle & (px < xint), F.lit(1)).otherwise(F.lit(0))

    n = F.aggregate(F.transform(edges, cross), F.lit(0), lambda acc, v: acc + v)
    return (n % 2) == 1


def point_in_polygon(px: Column, py: Column, g: Column) -> Column:
    """Point inside (multi)polygon: odd total crossings over the rings of some part (holes subtract)."""
    return F.exists(
        g["parts"],
        lambda part: (F.aggregate(F.transform(part, lambda r: F.when(point_in_ring(px, py, r), 1).otherwise(0)), F.lit(0), lambda a, v: a + v) % 2) == 1,
    )


def in_bbox(g: Column, xmin, ymin, xmax, ymax) -> Column:
    """Envelope intersection with a box."""
    b = g["bbox"]
    return (b["xmax"] >= xmin) & (b["xmin"] <= xmax) & (b["ymax"] >= ymin) & (b["ymin"] <= ymax)


def _edges(ring: Column) -> Column:
    """Consecutive vertex pairs ``(a, b)`` of a ring or line; none for a single vertex."""
    return F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, 2, F.size(ring)).alias("b"))


def meets_box(g: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Whether a geometry has a point in a box, the box's border included.

    A segment meets the box if their envelopes do and the box's corners do not
    all lie on one side of it; a polygon also if it holds the box.  The
    envelope test comes first and decides alone for points.
    """
    x0, y0, x1, y1 = (F.lit(float(v)) for v in (xmin, ymin, xmax, ymax))
    rings = F.flatten(g["parts"])

    def vertex(p):
        return p["x"].between(x0, x1) & p["y"].between(y0, y1)

    def edge(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        over = (F.greatest(ax, bx) >= x0) & (F.least(ax, bx) <= x1) & (F.greatest(ay, by) >= y0) & (F.least(ay, by) <= y1)
        sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
        return over & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    inside = F.when(g["kind"] == "POINT", F.lit(True)).otherwise(
        F.exists(F.flatten(rings), vertex) | F.exists(rings, lambda r: F.exists(_edges(r), edge))
        | (g["kind"].endswith("POLYGON") & point_in_polygon(x0, y0, g)))
    return in_bbox(g, x0, y0, x1, y1) & inside


def within_m(g: Column, x: Column, y: Column, radius: float) -> Column:
    """Whether a lon/lat geometry comes within ``radius`` metres of a point (F12): its vertices, its edges, its inside.

    The nearest point of an edge is found with longitudes scaled at the
    point's latitude; its distance is ``dist_m``.
    """
    near = F.lit(float(radius))

    def vertex(p):
        return dist_m(p["x"], p["y"], x, y, radius) <= near

    def edge(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        k = F.cos(F.radians(y))
        vx, vy = (bx - ax) * k, by - ay
        along = F.coalesce(((x - ax) * k * vx + (y - ay) * vy) / F.nullif(vx * vx + vy * vy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return dist_m(ax + t * (bx - ax), ay + t * (by - ay), x, y, radius) <= near

    rings = F.flatten(g["parts"])
    whole = (F.exists(F.flatten(rings), vertex) | F.exists(rings, lambda r: F.exists(_edges(r), edge))
             | (g["kind"].endswith("POLYGON") & point_in_polygon(x, y, g)))
    return F.when(g["kind"] == "POINT", bind(point_xy(g), vertex)).otherwise(whole)


def bbox_overlap(a: Column, b: Column) -> Column:
    return (a["xmax"] >= b["xmin"]) & (a["xmin"] <= b["xmax"]) & (a["ymax"] >= b["ymin"]) & (a["ymin"] <= b["ymax"])


# ---------------------------------------------------------------- reprojection
def _lcc_consts():
    e = GRS80_E
    a = WGS84_A

    def m(phi):
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t(phi):
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)

    p1, p2, p0 = (math.radians(v) for v in (L93_LAT1, L93_LAT2, L93_LAT0))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    rho0 = a * f * t(p0) ** n
    return e, a, n, f, rho0


def lonlat_to_l93(lon: Column, lat: Column) -> tuple[Column, Column]:
    e, a, n, f, rho0 = _lcc_consts()
    phi = F.radians(lat)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow(F.lit(2.0) / (F.lit(1.0) + F.lit(e) * F.sin(phi)) - F.lit(1.0), F.lit(e / 2))
    rho = F.lit(a * f) * F.pow(t, F.lit(n))
    theta = F.lit(n) * F.radians(lon - F.lit(L93_LON0))
    return F.lit(L93_X0) + rho * F.sin(theta), F.lit(L93_Y0 + rho0) - rho * F.cos(theta)


def l93_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    e, a, n, f, rho0 = _lcc_consts()
    dx = x - F.lit(L93_X0)
    dy = F.lit(rho0) - (y - F.lit(L93_Y0))
    rho = F.sqrt(dx * dx + dy * dy) * (1 if n > 0 else -1)
    theta = F.atan2(dx, dy)
    t = F.pow(rho / F.lit(a * f), F.lit(1 / n))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(8):  # fixed-point iteration, converges to < 1e-12 rad
        # (1 - es) / (1 + es) written as 2 / (1 + es) - 1: phi appears once per step, so the
        # expression grows linearly with the number of steps instead of doubling
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow(F.lit(2.0) / (F.lit(1.0) + F.lit(e) * F.sin(phi)) - F.lit(1.0), F.lit(e / 2)))
    lon = F.degrees(theta / F.lit(n)) + F.lit(L93_LON0)
    return lon, F.degrees(phi)


def lonlat_to_3857(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = F.radians(lon) * F.lit(WGS84_A)
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(WGS84_A)
    return x, y


def m3857_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    lon = F.degrees(x / F.lit(WGS84_A))
    lat = F.degrees(2 * F.atan(F.exp(y / F.lit(WGS84_A))) - F.lit(math.pi / 2))
    return lon, lat


_TO_LL = {4326: None, 2154: l93_to_lonlat, 3857: m3857_to_lonlat}
_FROM_LL = {4326: None, 2154: lonlat_to_l93, 3857: lonlat_to_3857}


def reproject_xy(x: Column, y: Column, src: int, dst: int) -> tuple[Column, Column]:
    if src == dst:
        return x, y
    if src not in _TO_LL or dst not in _FROM_LL:
        raise ValueError(f"unsupported SRID pair {src} -> {dst} (supported: 4326, 2154, 3857)")
    if _TO_LL[src]:
        x, y = _TO_LL[src](x, y)
    if _FROM_LL[dst]:
        x, y = _FROM_LL[dst](x, y)
    return x, y


def reproject(g: Column, src: int, dst: int) -> Column:
    """Reproject every vertex from ``src`` to ``dst``."""
    if src == dst:
        return g

    def pt(p):
        x, y = reproject_xy(p["x"], p["y"], src, dst)
        return F.struct(x.alias("x"), y.alias("y"))

    parts = F.transform(g["parts"], lambda part: F.transform(part, lambda r: F.transform(r, pt)))
    return F.when(g.isNotNull(), make_geom(g["kind"], F.lit(dst), parts))


def fix_srid(df: DataFrame, col: str, to: int) -> DataFrame:
    """Rewrite geometries stored in another SRID, leave the rest (G14); idempotent."""
    g = F.col(col)
    out = g
    for src in (2154, 3857, 4326):
        if src != to:
            out = F.when(g["srid"] == src, reproject(g, src, to)).otherwise(out)
    return df.withColumn(col, out)


# ---------------------------------------------------------------- GeoJSON
def to_geojson_geometry(g: Column) -> Column:
    k = g["kind"]
    xy = lambda p: F.array(p["x"], p["y"])
    first = F.get(g["parts"], 0)
    point = F.to_json(F.struct(F.lit("Point").alias("type"), xy(F.get(F.get(first, 0), 0)).alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(F.get(first, 0), xy).alias("coordinates")))
    poly = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(first, lambda r: F.transform(r, xy)).alias("coordinates")))
    mpoint = F.to_json(F.struct(F.lit("MultiPoint").alias("type"), F.transform(g["parts"], lambda p: xy(F.get(F.get(p, 0), 0))).alias("coordinates")))
    mline = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform(g["parts"], lambda p: F.transform(F.get(p, 0), xy)).alias("coordinates")))
    mpoly = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, xy))).alias("coordinates")))
    return (
        F.when(k == "POINT", point).when(k == "LINESTRING", line).when(k == "POLYGON", poly)
        .when(k == "MULTIPOINT", mpoint).when(k == "MULTILINESTRING", mline).when(k == "MULTIPOLYGON", mpoly)
    )


def from_geojson(text: Column, srid: int = 4326) -> Column:
    """GeoJSON geometry text -> geometry struct."""
    t = F.get_json_object(text, "$.type")
    c = F.get_json_object(text, "$.coordinates")
    pt = lambda a: _pt(F.get(a, 0), F.get(a, 1))
    d1 = F.from_json(c, "array<double>")
    d2 = F.from_json(c, "array<array<double>>")
    d3 = F.from_json(c, "array<array<array<double>>>")
    d4 = F.from_json(c, "array<array<array<array<double>>>>")
    parts = (
        F.when(t == "Point", F.array(F.array(F.array(pt(d1)))))
        .when(t == "LineString", F.array(F.array(F.transform(d2, pt))))
        .when(t == "Polygon", F.array(F.transform(d3, lambda r: F.transform(r, pt))))
        .when(t == "MultiPoint", F.transform(d2, lambda p: F.array(F.array(pt(p)))))
        .when(t == "MultiLineString", F.transform(d3, lambda l: F.array(F.transform(l, pt))))
        .when(t == "MultiPolygon", F.transform(d4, lambda pg: F.transform(pg, lambda r: F.transform(r, pt))))
    )
    kind = F.upper(F.regexp_replace(t, "(?<=[a-z])(?=[A-Z])", ""))
    return F.when(parts.isNotNull(), make_geom(kind, F.lit(srid), parts))


# ---------------------------------------------------------------- grid joins
def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def line_segments(lines: DataFrame, lid: str = "lid", line: str = "line") -> DataFrame:
    """One row per segment: lid, ax, ay, bx, by (a one-vertex line gives a zero-length segment)."""
    v = F.col(line)
    segs = F.when(F.size(v) > 1, F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("a"), F.slice(v, 2, F.size(v)).alias("b"))).otherwise(
        F.arrays_zip(v.alias("a"), v.alias("b")))
    return lines.select(F.col(lid).alias("lid"), F.explode(segs).alias("s")).select(
        "lid", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def segment_cell_rows(segs: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """Every grid cell a segment passes through (exact cover, with a hair of slack at cell borders), once each.

    ``reach`` adds the cells up to that distance away along x and y.

    Column by column along x: the segment's y-range inside the column gives
    the cells of that column.  Fan-out per segment = cells crossed, so it
    depends on the segment's length, not on the data volume.
    """
    eps = size * 1e-9 + reach
    x_lo, x_hi = F.least("ax", "bx"), F.greatest("ax", "bx")
    cols = segs.select("*", F.explode(F.sequence(_cell(x_lo - eps, size), _cell(x_hi + eps, size))).alias("cx"))
    x0 = F.least(F.greatest(F.col("cx") * F.lit(size) - eps, x_lo), x_hi)
    x1 = F.greatest(F.least((F.col("cx") + 1) * F.lit(size) + eps, x_hi), x_lo)
    slope = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    ya = F.when(F.col("bx") == F.col("ax"), F.col("ay")).otherwise(F.col("ay") + (x0 - F.col("ax")) * slope)
    yb = F.when(F.col("bx") == F.col("ax"), F.col("by")).otherwise(F.col("ay") + (x1 - F.col("ax")) * slope)
    y_lo, y_hi = F.least(ya, yb) - eps, F.greatest(ya, yb) + eps
    return cols.select("*", F.explode(F.sequence(_cell(y_lo, size), _cell(y_hi, size))).alias("cy"))


# points per bucket of a cell: a cell with more is split into as many buckets as that takes;
# None switches the detection pass off
HOT_CELL_ROWS = 1_000_000
# keys are counted by this many hash groups
KEY_GROUPS = 16_384


def meet(left: DataFrame, right: DataFrame, keys: list[str], rows: int | None = HOT_CELL_ROWS, least: int = 1) -> DataFrame:
    """Equi join on ``keys`` in which no task gets more than about ``rows`` left rows of one key.

    Left rows are counted by a hash group of their keys.  A group with more
    than ``rows`` is split into as many buckets as they fill (at least
    ``least``); its right rows are copied to each bucket.  There is at most
    one such group for each ``rows`` left rows, so the groups are broadcast
    and either side is shuffled once.
    """
    if not rows:
        return left.join(right, keys)
    # equal keys of two types have one hash only as values of their common type
    common = left.select(*keys).union(right.select(*keys)).schema
    group = F.pmod(F.xxhash64(*[F.col(k).cast(common[k].dataType) for k in keys]), F.lit(KEY_GROUPS)).alias("__group")
    crowd = F.broadcast(left.groupBy(group).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > rows).select(
        "__group", F.greatest(F.ceil(F.col("__rows") / rows), F.lit(least)).cast("long").alias("__buckets")))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    bucket = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__buckets")), zero)
    dealt = left.select("*", group).join(crowd, "__group", "left").withColumn("__bucket", bucket).drop("__group", "__buckets")
    copied = right.select("*", group).join(crowd, "__group", "left").withColumn(
        "__bucket", F.explode(F.sequence(zero, F.coalesce(F.col("__buckets"), one) - 1))).drop("__group", "__buckets")
    return dealt.join(copied, [*keys, "__bucket"]).drop("__bucket")


# segments of a line that one row of a cell holds beside each other
LINE_SLOTS = 4
# points per bucket of a cell whose points meet all lines of the cell
PAIR_CELL_ROWS = 4_096


def _line_cells(segs: DataFrame, size: float, reach: float) -> DataFrame:
    """``segment_cell_rows`` with up to ``LINE_SLOTS`` segments of a line in a row, ``s0``, ``s1`` ...; ``split`` tells that
    the line has more rows in the cell."""
    line = Window.partitionBy("cx", "cy", "lid").orderBy("ax", "ay", "bx", "by")
    seg = F.struct("ax", "ay", "bx", "by")
    slots = [F.lead(seg, i).over(line).alias(f"s{i}") for i in range(LINE_SLOTS)]
    nr, more = F.row_number().over(line) - 1, F.lead(F.lit(True), LINE_SLOTS).over(line).isNotNull()
    rows = segment_cell_rows(segs, size, reach).select("cx", "cy", "lid", *slots, nr.alias("nr"), more.alias("more"))
    return rows.filter(F.col("nr") % LINE_SLOTS == 0).withColumn("split", F.col("more") | (F.col("nr") > 0)).drop("nr", "more")


def _within(points: DataFrame, cells: DataFrame, r: float, size: float, hot_cell_rows: int | None, salt: int) -> DataFrame:
    pts = points.select("*", _cell(F.col("px"), size).alias("cx"), _cell(F.col("py"), size).alias("cy"))
    # (edge vectors and their lengths belong to the segment; they are not worked out again for every pair)
    flat = [F.col(f"s{i}.{c}").alias(f"{c}{i}") for i in range(LINE_SLOTS) for c in ("ax", "ay", "bx", "by")]
    vx, vy = [F.col(f"bx{i}") - F.col(f"ax{i}") for i in range(LINE_SLOTS)], [F.col(f"by{i}") - F.col(f"ay{i}") for i in range(LINE_SLOTS)]
    named = [c.alias(f"{n}{i}") for i in range(LINE_SLOTS) for n, c in (
        ("ax", F.col(f"ax{i}")), ("ay", F.col(f"ay{i}")), ("vx", vx[i]), ("vy", vy[i]), ("l2", vx[i] * vx[i] + vy[i] * vy[i]))]
    cand = meet(pts, cells.select("cx", "cy", "lid", *flat).select("cx", "cy", "lid", *named), ["cx", "cy"], hot_cell_rows, salt)
    # ``seg_dist`` in steps, each value worked out once
    zero, one = F.lit(0.0), F.lit(1.0)
    px, py, slots = F.col("px"), F.col("py"), range(LINE_SLOTS)
    c = lambda n, i: F.col(f"{n}{i}")
    t = [F.when(c("l2", i) > 0, F.greatest(zero, F.least(one, ((px - c("ax", i)) * c("vx", i) + (py - c("ay", i)) * c("vy", i)) / c("l2", i)))).otherwise(zero)
         for i in slots]
    cand = cand.select("*", *[t[i].alias(f"t{i}") for i in slots])
    cand = cand.select("pid", "lid", *[(px - (c("ax", i) + c("t", i) * c("vx", i))).alias(f"dx{i}") for i in slots],
                       *[(py - (c("ay", i) + c("t", i) * c("vy", i))).alias(f"dy{i}") for i in slots])
    d = F.least(*[F.sqrt(c("dx", i) * c("dx", i) + c("dy", i) * c("dy", i)) for i in slots])
    # exploded, so that the planner does not move the whole formula into the join's condition and work it out twice
    return cand.select("pid", "lid", F.explode(F.array(d)).alias("dist")).filter(F.col("dist") <= F.lit(r))


def join_within(
    points: DataFrame, lines: DataFrame, r: float, pid: str = "pid", px: str = "x", py: str = "y",
    lid: str = "lid", line: str = "line", hot_cell_rows: int | None = PAIR_CELL_ROWS, salt: int = 1,
) -> DataFrame:
    """Point-line pairs within planar distance ``r`` (J16/G7), with the distance.

    Lines are cut into segments; each segment goes to the cells it crosses
    and those within ``r``, each point to its cell, so any point within r of
    a segment meets it there, once.  The distance is plain arithmetic
    (whole-stage codegen).  A point has one cell, and a line's segments in it
    stand in one row, so that nearly every pair comes out of the join once
    and is not shuffled; only pairs of points with several positions and of
    lines with more than ``LINE_SLOTS`` segments in a cell are put together
    by a ``min``.  Output: pid, lid, dist (one row per pair).
    """
    pts = points.select(F.col(pid).alias("pid"), F.col(px).alias("px"), F.col(py).alias("py")).filter("px IS NOT NULL AND py IS NOT NULL")
    at = F.struct("px", "py")
    places = pts.groupBy("pid").agg(F.min(at).alias("at"), F.max(at).alias("to"))
    alone = places.filter("at = to").select("pid", "at.*")
    moved = places.filter("at <> to").select(F.col("pid").alias("__pid"))
    several = pts.join(moved, F.col("pid").eqNullSafe(F.col("__pid")), "left_semi")
    size = r / 2
    cells = _line_cells(line_segments(lines, lid, line), size, r)
    once = _within(alone, cells.filter("NOT split"), r, size, hot_cell_rows, salt)
    again = _within(alone, cells.filter("split"), r, size, hot_cell_rows, salt).union(_within(several, cells, r, size, hot_cell_rows, salt))
    return once.union(again.groupBy("pid", "lid").agg(F.min("dist").alias("dist")))


def nearest_per_type(pairs: DataFrame, lines: DataFrame, r: float | None = None, type_col: str = "type") -> DataFrame:
    """Nearest line per (point, type) (J17/W2): ``min(struct(dist, lid))`` combines map-side; ties go to the smaller id."""
    j = pairs.join(lines.select(F.col("lid"), F.col(type_col).alias("type")), "lid")
    if r is not None:
        j = j.filter(F.col("dist") <= r)
    best = j.groupBy("pid", "type").agg(F.min(F.struct("dist", "lid")).alias("b"))
    return best.select("pid", "type", F.col("b.lid").alias("lid"), F.col("b.dist").alias("dist"))


def nearest_within(points: DataFrame, lines: DataFrame, r: float, pid: str = "pid", px: str = "x", py: str = "y",
                   lid: str = "lid", line: str = "line", type_col: str = "type", hot_cell_rows: int | None = HOT_CELL_ROWS,
                   salt: int = 1) -> DataFrame:
    """Nearest line per (point, line type) within ``r``; ties go to the smaller id.

    Cells of size ``r`` are halved until the occupied ones hold a few points
    each.  At every size a cell keeps, per type, the segments that can be
    nearest to one of its points: with the middle of the cell at most
    ``reach`` from its points, those no farther from it than the nearest
    segment plus twice ``reach``.  Each point then meets its own cell's.
    """
    typed = lines.select(F.col(lid).alias("lid"), F.col(line).alias("line"), F.col(type_col).alias("type"))
    segs = line_segments(typed).join(typed.select("lid", "type").distinct(), "lid")
    # of equal segments of a type the one with the smallest id is the answer
    segs = segs.groupBy("type", "ax", "ay", "bx", "by").agg(F.min("lid").alias("lid"))
    pts = points.select(F.col(pid).alias("pid"), F.col(px).alias("px"), F.col(py).alias("py"))

    def cells(size: float) -> list[Column]:
        return [_cell(F.col("px"), size).alias("cx"), _cell(F.col("py"), size).alias("cy")]

    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    cand = segment_cell_rows(segs, r, reach=r).withColumn("least", F.lit(None).cast("double"))
    size = r
    for _ in range(_halvings(pts.select(*cells(r)))):
        size /= 2
        reach = size * 0.7072  # half a diagonal and a hair
        occupied = pts.select(*cells(size)).distinct().select(
            F.col("cx").alias("x"), F.col("cy").alias("y"), F.floor(F.col("cx") / 2).alias("cx"), F.floor(F.col("cy") / 2).alias("cy"))
        far = seg_dist((F.col("x") + 0.5) * F.lit(size), (F.col("y") + 0.5) * F.lit(size), *ends)
        cand = cand.join(occupied, ["cx", "cy"]).withColumn("far", far)
        # the larger cell's nearest segment is at most another ``reach`` farther from this middle
        cand = cand.filter(F.col("far") <= F.least(F.lit(r + reach), F.col("least") + 3 * reach))
        cand = cand.select("type", "lid", *ends, F.col("x").alias("cx"), F.col("y").alias("cy"), "far")
        cand = cand.withColumn("least", F.min("far").over(Window.partitionBy("cx", "cy", "type")))
        cand = cand.filter(F.col("far") <= F.col("least") + 2 * reach).drop("far")
    c = meet(pts.select("*", *cells(size)), cand.drop("least"), ["cx", "cy"], hot_cell_rows, salt)
    c = c.select("pid", "lid", "type", seg_dist(F.col("px"), F.col("py"), *ends).alias("dist")).filter(F.col("dist") <= F.lit(r))
    best = c.groupBy("pid", "type").agg(F.min(F.struct("dist", "lid")).alias("b"))
    return best.select("pid", "type", F.col("b.lid").alias("lid"), F.col("b.dist").alias("dist"))


# points that a cell of the nearest search holds on average
NEAREST_CELL_POINTS = 32


def _halvings(cells: DataFrame) -> int:
    """How often the occupied ``cells`` are to be halved (two values reach the driver); it changes the work, not the result."""
    rows, taken = cells.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("cx", "cy"))).first()
    return min(12, max(0, round(math.log(max(1.0, rows / (max(1, taken) * NEAREST_CELL_POINTS)), 4))))


def polygon_edges(areas: DataFrame, aid: str = "aid", geom: str = "geom") -> DataFrame:
    """One row per polygon edge: aid, part, ax, ay, bx, by (all rings of a part together)."""
    parts = areas.select(F.col(aid).alias("aid"), F.posexplode(F.col(geom)["parts"]).alias("part", "rings"))
    rings = parts.select("aid", "part", F.explode("rings").alias("r"))
    e = rings.select("aid", "part", F.explode(F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("a"), F.slice("r", 2, F.size("r")).alias("b"))).alias("e"))
    return e.select("aid", "part", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def points_in_polygons(
    points: DataFrame, areas: DataFrame, cell: float, pid: str = "pid", px: str = "x", py: str = "y",
    aid: str = "aid", geom: str = "geom", relational: bool = False, hot_cell_rows: int | None = HOT_CELL_ROWS,
) -> DataFrame:
    """Point-in-area links.

    Candidates: areas explode to the cells of their bbox, points to their one
    cell (equi join).  Then the exact parity (ray casting) test, holes
    flipping the parity:

    * default: inline over the candidate area's rings (best for areas with
      up to a few hundred edges);
    * ``relational=True`` for large polygons (thousands of edges): edges are
      bucketed by the grid rows they span, a candidate meets only the edges
      of its own row band, and crossings to the right of the point are
      counted per (point, area, part) in a map-side-combined aggregate.
    """
    pts = points.select(F.col(pid).alias("pid"), F.col(px).alias("px"), F.col(py).alias("py"))
    pts = pts.select("*", _cell(F.col("px"), cell).alias("cx"), _cell(F.col("py"), cell).alias("cy"))
    ar = areas.select(F.col(aid).alias("aid"), F.col(geom).alias("g"))
    b = F.col("g")["bbox"]
    ac = ar.select("*", F.explode(F.sequence(_cell(b["xmin"], cell), _cell(b["xmax"], cell))).alias("cx")).select(
        "*", F.explode(F.sequence(_cell(b["ymin"], cell), _cell(b["ymax"], cell))).alias("cy"))
    if not relational:  # the area comes along with its cells, so an area that holds most points is no hot key
        cand = meet(pts, ac, ["cx", "cy"], hot_cell_rows)
        return cand.filter(point_in_polygon(F.col("px"), F.col("py"), F.col("g"))).select("pid", "aid")
    cand = meet(pts, ac.drop("g"), ["cx", "cy"], hot_cell_rows).select("pid", "px", "py", "cy", "aid")
    edges = polygon_edges(ar, "aid", "g")
    edges = edges.filter(F.col("ay") != F.col("by")).select(
        "*", F.explode(F.sequence(_cell(F.least("ay", "by"), cell), _cell(F.greatest("ay", "by"), cell))).alias("cy"))
    j = meet(cand, edges, ["aid", "cy"], hot_cell_rows)
    straddle = (F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))
    xint = F.col("ax") + (F.col("py") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    crossings = j.filter(straddle & (F.col("px") < xint)).groupBy("pid", "aid", "part").agg(F.count(F.lit(1)).alias("n"))
    return crossings.filter(F.col("n") % 2 == 1).select("pid", "aid").distinct()


def bbox_join(a: DataFrame, b: DataFrame, cell: float, aid="aid", ag="geom", bid="bid", bg="geom") -> DataFrame:
    """Pairs whose bounding boxes overlap (J24): both sides explode to their bbox cells, equi join on the cell."""
    def cells(df, idc, gc, name):
        bb = F.col(gc)["bbox"]
        return df.select(F.col(idc).alias(name), bb.alias(f"{name}_bb")).select(
            name, f"{name}_bb",
            F.explode(F.sequence(_cell(F.col(f"{name}_bb.xmin"), cell), _cell(F.col(f"{name}_bb.xmax"), cell))).alias("cx"),
        ).select(name, f"{name}_bb", "cx",
                 F.explode(F.sequence(_cell(F.col(f"{name}_bb.ymin"), cell), _cell(F.col(f"{name}_bb.ymax"), cell))).alias("cy"))

    ca, cb = cells(a, aid, ag, "aid"), cells(b, bid, bg, "bid")
    j = meet(ca, cb, ["cx", "cy"])
    # reference-point rule: keep the pair only in the cell holding the lower-left corner of the two
    # boxes' intersection (a cell both boxes cover), so each pair comes out once without a distinct
    rx = F.greatest(F.col("aid_bb.xmin"), F.col("bid_bb.xmin"))
    ry = F.greatest(F.col("aid_bb.ymin"), F.col("bid_bb.ymin"))
    once = (F.col("cx") == _cell(rx, cell)) & (F.col("cy") == _cell(ry, cell))
    return j.filter(bbox_overlap(F.col("aid_bb"), F.col("bid_bb")) & once).select("aid", "bid")


# ---------------------------------------------------------------- filter atoms
def filter_atom(c: Column, kind: str, value, ctx) -> Column:
    """``bbox xmin;ymin;xmax;ymax`` and ``dwithin x;y;radius`` (lon/lat, metres).

    The object form of ``dwithin`` (``code;pk;field;radius``) is resolved by
    the list query into a one-row broadcast and passed as ``ctx``.
    """
    parts = str(value).split(";")
    if kind == "bbox":
        xmin, ymin, xmax, ymax = (float(p) for p in parts)
        return meets_box(c, xmin, ymin, xmax, ymax)
    if kind == "dwithin":
        if ctx is not None and "dwithin" in ctx:
            ox, oy, radius = ctx["dwithin"]
        else:
            ox, oy, radius = F.lit(float(parts[0])), F.lit(float(parts[1])), float(parts[2])
        return within_m(c, ox, oy, float(radius))
    raise ValueError(kind)


def _turn(ring: Column) -> Column:
    """1 for a ring that runs counterclockwise, -1 for one that runs clockwise, 0 without an inside."""
    return F.signum(F.aggregate(F.transform(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]),
                                F.lit(0.0), lambda total, v: total + v))


def _sided_edges(df: DataFrame) -> DataFrame:
    """Edges ``pid, side, ax, ay, bx, by`` of ``(pid, geom)``; ``side`` is 1 where a polygon's inside lies left of the edge, -1 right, 0 for lines."""
    rings = df.select("pid", F.col("geom")["kind"].endswith("POLYGON").alias("area"), F.explode(F.col("geom")["parts"]).alias("part")).select(
        "pid", "area", F.posexplode("part").alias("nr", "r"))
    # a hole's inside is outside the area
    side = F.when(F.col("area"), _turn(F.col("r")) * F.when(F.col("nr") == 0, 1.0).otherwise(-1.0)).otherwise(0.0)
    e = rings.select("pid", side.alias("side"), F.explode(_edges(F.col("r"))).alias("e"))
    return e.select("pid", "side", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"),
                    F.col("e.b.y").alias("by")).filter("ax <> bx OR ay <> by")


def _pieces(edges: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """``edges`` cut where ``others`` meet them: the columns of ``edges`` and the piece's part ``t`` to ``t1`` of its edge.

    Edges meet on the grid cells they cross.  Cuts that are not needed do no harm.
    """
    other = segment_cell_rows(others, cell).select("cx", "cy", F.struct("ax", "ay", "bx", "by").alias("o"))
    c = meet(segment_cell_rows(edges, cell), other, ["cx", "cy"])
    vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    wx, wy = F.col("o.bx") - F.col("o.ax"), F.col("o.by") - F.col("o.ay")
    ux, uy = F.col("o.ax") - F.col("ax"), F.col("o.ay") - F.col("ay")
    cross = F.nullif(vx * wy - vy * wx, F.lit(0.0))
    on_other = ((ux * vy - uy * vx) / cross).between(-1e-9, 1 + 1e-9)
    long2 = vx * vx + vy * vy
    parallel = F.array((ux * vx + uy * vy) / long2, ((ux + wx) * vx + (uy + wy) * vy) / long2)
    cuts = F.when(cross.isNull(), parallel).when(on_other, F.array((ux * wy - uy * wx) / cross))
    names = ["pid", "side", "ax", "ay", "bx", "by"]
    cut = c.select(*names, F.explode(cuts).alias("t")).filter((F.col("t") > 1e-9) & (F.col("t") < 1 - 1e-9))
    every = edges.select(*names, F.lit(0.0).alias("t")).union(cut)
    along = Window.partitionBy(*names).orderBy("t")
    return every.withColumn("t1", F.lead("t", 1, 1.0).over(along)).filter(F.col("t1") - F.col("t") > 1e-9)


def _beside(pieces: DataFrame, side: Column) -> DataFrame:
    """A point a hair beside the middle of each piece: ``x, y`` added."""
    vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    middle, hair = (F.col("t") + F.col("t1")) / 2, (F.col("t1") - F.col("t")) * 1e-6 * side
    return pieces.withColumn("x", F.col("ax") + middle * vx - hair * vy).withColumn("y", F.col("ay") + middle * vy + hair * vx)


def intersecting_areas(objects: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Pairs ``(pid, aid)`` of objects ``(pid, geom)`` whose inside meets the inside of an area ``(aid, geom)``.

    Contact of borders alone does not count.  Points are tested as they are.
    Lines and polygon borders are cut where the other side's edges meet them,
    so that each piece lies wholly inside, outside or on a border:

    * a line meets an area if both sides of some piece lie in it;
    * a polygon meets an area if the inner side of some piece of it lies in the area;
    * where none does, no border of the polygon goes through a part of the area: the polygon holds all of the part or
      nothing, so that one point inside the part tells.

    Every step is an equi join on grid cells followed by arithmetic.
    """
    kind = F.col("geom")["kind"]
    points = objects.filter(kind.endswith("POINT")).select("pid", F.explode(F.flatten(F.flatten(F.col("geom")["parts"]))).alias("p")).select(
        "pid", "p.x", "p.y", "p.x", "p.y", F.lit(0.0), F.lit(1), "p.x", "p.y").toDF("pid", "ax", "ay", "bx", "by", "t", "need", "x", "y")
    borders, outlines = _sided_edges(areas.withColumnRenamed("aid", "pid")), _sided_edges(objects.filter(~kind.endswith("POINT")))

    line = F.col("side") == 0
    sides = F.explode(F.when(line, F.array(F.lit(-1.0), F.lit(1.0))).otherwise(F.array("side")))
    pieces = _pieces(outlines, borders, cell).select("*", sides.alias("s"), F.when(line, 2).otherwise(1).alias("need"))
    tested = _beside(pieces, F.col("s")).select(*points.columns).union(points)
    what = F.struct("pid", "ax", "ay", "bx", "by", "t", "need").alias("pid")
    # counting crowded cells here would compute the pieces twice: left to AQE's skew join
    inner = points_in_polygons(tested.select(what, "x", "y"), areas, cell, hot_cell_rows=None)
    inner = inner.groupBy("pid", "aid").agg(F.count(F.lit(1)).alias("n"))
    inner = inner.filter(F.col("n") >= F.col("pid.need")).select("pid.pid", "aid")

    shapes = objects.filter(kind.endswith("POLYGON")).withColumnRenamed("pid", "aid")
    outer = points_in_polygons(_inside_points(areas), shapes, cell)
    return inner.union(outer.select(F.col("aid").alias("pid"), F.col("pid").alias("aid"))).distinct()


def _inside_points(areas: DataFrame) -> DataFrame:
    """A point inside each part of each area ``(aid, geom)``: a hair beside the middle of its longest outer edge, as ``pid, x, y``."""
    part = areas.filter(F.col("geom")["kind"].endswith("POLYGON")).select(F.col("aid").alias("pid"), F.explode(F.col("geom")["parts"]).alias("part"))
    e = part.select("pid", _turn(F.get("part", F.lit(0))).alias("side"), F.array_max(F.transform(_edges(F.get("part", F.lit(0))), lambda e: F.struct(
        (F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2)).alias("long2"), e["a"].alias("a"), e["b"].alias("b")))).alias("e"))
    e = e.filter("side <> 0").select("pid", "side", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"),
                                     F.col("e.b.y").alias("by"), F.lit(0.0).alias("t"), F.lit(1.0).alias("t1"))
    return _beside(e, F.col("side")).select("pid", "x", "y")


def link_areas(objects: DataFrame, areas: DataFrame, cell: float, oid: str = "pid", geom: str = "geom",
               aid: str = "aid", agg: str = "geom", enabled: str | None = None) -> DataFrame:
    """Object-area links for all objects (G12, J15): geometries that meet, enabled areas only."""
    a = areas.filter(F.col(enabled)) if enabled else areas
    return intersecting_areas(objects.select(F.col(oid).alias("pid"), F.col(geom).alias("geom")),
                              a.select(F.col(aid).alias("aid"), F.col(agg).alias("geom")), cell)


def refresh_links(links: DataFrame, changed: DataFrame, new_links: DataFrame, key: str = "pid") -> DataFrame:
    """Incremental link refresh (G13): drop old links of changed objects, add their recomputed links."""
    keys = changed.select(key).distinct()
    return links.join(keys, key, "left_anti").unionByName(new_links.join(keys, key, "left_semi"))
