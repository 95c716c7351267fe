"""Data-preparation recipes (R-1 ... R-8): complete jobs built from the operators.

Each recipe takes DataFrames and column names and returns DataFrames; no
table is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.functions.text import classify, json_of, round_half_up
from relata.operators import geo
from relata.operators.aggregates import agg_text, any_equals, frequencies, keep_first
from relata.operators.changes import update_from
from relata.operators.relations import join_list
from relata.operators.sets import union_distinct

# Class names, type codes and prefixes the recipes must reproduce.
# road classes -> linear type codes
ROAD_TYPE_CODES = {"Départementale": "RT_DEP", "Nationale": "RT_NAT", "Autoroute": "RT_AUT"}
# road classes numbered without a department suffix
ROAD_UNSUFFIXED = ("Autoroute", "Nationale")
ROAD_DEPARTMENTAL = "Départementale"
# segment id prefix shortened in linear names
SEGMENT_ID_PREFIX, SEGMENT_ID_SHORT = "TRONROUT000000", "TR "
# railway: high-speed category, kept segment natures, their type codes, group name prefixes
RAIL_HIGH_SPEED = "Ligne à grande vitesse"
RAIL_NATURES = ("Voie de service", "Voie ferrée principale", "LGV")
RAIL_TYPE_LGV, RAIL_TYPE_MAIN = "VF_LGV", "VF_P"
RAIL_GROUP_LGV, RAIL_GROUP_OTHER = "LGV_", "L_"
# route numbers: prefix -> type code, everything else departmental
ROUTE_PREFIX_CODES = (("A%", "RT_AUT"), ("N%", "RT_NAT"))
ROUTE_DEFAULT_CODE = "RT_DEP"


def dedupe_min(df: DataFrame, key: str = "id", order: str = "gid") -> DataFrame:
    """Keep the row with the smallest ``order`` per ``key``."""
    return keep_first(df, [key], [F.col(order).asc()])


def roads(segments: DataFrame, names: DataFrame, areas: DataFrame | None = None, overrides: dict | None = None,
          type_codes: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """R-1: road groups and segments.

    segments: gid, id, id_rn ('a/b' list of name ids), cl_admin, largeur, geom
    names:    gid, id, numero, type_route, gestion
    areas:    area_name, area_code (departments)
    Returns (groups: code, name) and (linear: id_type, linear_code, linear_name, groups, geom, additional_data).
    """
    seg = dedupe_min(segments)
    nm = dedupe_min(names)
    nm = nm.withColumn("numero_dept", F.lit(None).cast("string"))
    if areas is not None:
        a = areas.select(F.col("area_name").alias("gestion"), F.col("area_code"))
        nm = update_from(nm, a, ["gestion"], {"numero_dept": F.when(F.col("type_route") == ROAD_DEPARTMENTAL,
                                                                    F.concat(F.col("numero"), F.lit(" ("), F.col("__o_area_code"), F.lit(")")))
                                             .otherwise(F.col("numero_dept"))})
    for gestion, code in (overrides or {}).items():
        nm = nm.withColumn("numero_dept", F.when((F.col("type_route") == ROAD_DEPARTMENTAL) & (F.col("gestion") == gestion),
                                                 F.concat(F.col("numero"), F.lit(f" ({code})"))).otherwise(F.col("numero_dept")))
    nm = nm.withColumn("numero_dept", F.when(F.col("type_route").isin(*ROAD_UNSUFFIXED), F.col("numero")).otherwise(F.col("numero_dept")))
    groups = nm.groupBy("numero_dept", "type_route").agg(F.lit(1).alias("_")).select(
        F.col("numero_dept").alias("code"), F.concat_ws(" ", "type_route", "numero_dept").alias("name"))
    tc = type_codes or ROAD_TYPE_CODES
    joined = join_list(seg, "id_rn", "/", nm.select(F.col("id").alias("rn_id"), "numero_dept"), "rn_id")
    lin = agg_text(joined, ["id"], "numero_dept", "groups", sep=",")
    lin = lin.join(seg, "id")
    linear = lin.select(
        classify([(F.col("cl_admin") == k, v) for k, v in tc.items()]).alias("id_type"),
        F.col("id").alias("linear_code"),
        F.concat(F.regexp_replace(F.col("groups"), ",", ", "), F.lit(" "), F.replace(F.col("id"), F.lit(SEGMENT_ID_PREFIX), F.lit(SEGMENT_ID_SHORT))).alias("linear_name"),
        F.col("groups"),
        F.col("geom"),
        F.concat(F.lit('{ "largeur": '), F.col("largeur").cast("string"), F.lit(" }")).alias("additional_data"),
    )
    return groups, linear


def lines_within(a: DataFrame, b: DataFrame, r: float, aid="aid", aline="line", bid="bid", bline="line") -> DataFrame:
    """Line pairs within planar distance ``r`` (J16 for lines), with the distance.

    Both sides are cut into segments; on cells of 2 r, ``a``'s segments go to
    the cells within r of them, ``b``'s to the cells they cross, so any
    pair within r shares a cell.  Two segments are within r iff they cross
    or an end point of one is within r of the other: the distance is the
    minimum of four point-segment distances (0 when they cross), plain
    arithmetic; a map-side ``min`` per line pair removes duplicates.
    """
    sa = geo.segment_cell_rows(geo.line_segments(a, aid, aline), 2 * r, reach=r)
    sa = sa.select(F.col("lid").alias("__a"), *[F.col(c).alias(f"a_{c}") for c in ("ax", "ay", "bx", "by")], "cx", "cy")
    sb = geo.segment_cell_rows(geo.line_segments(b, bid, bline), 2 * r)
    sb = sb.select(F.col("lid").alias("__b"), *[F.col(c).alias(f"b_{c}") for c in ("ax", "ay", "bx", "by")], "cx", "cy")
    c = geo.meet(sa, sb, ["cx", "cy"])
    A =[F.col(f"a_{x}") for x in ("ax", "ay", "bx", "by")]
    B = [F.col(f"b_{x}") for x in ("ax", "ay", "bx", "by")]
    d = F.least(
        geo.seg_dist(A[0], A[1], *B), geo.seg_dist(A[2], A[3], *B),
        geo.seg_dist(B[0], B[1], *A), geo.seg_dist(B[2], B[3], *A),
    )

    def orient(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    cross = (orient(*A, B[0], B[1]) * orient(*A, B[2], B[3]) < 0) & (orient(*B, A[0], A[1]) * orient(*B, A[2], A[3]) < 0)
    dist = F.when(cross, F.lit(0.0)).otherwise(d)
    near = c.select("__a", "__b", dist.alias("dist")).filter(F.col("dist") <= F.lit(r))
    return near.groupBy("__a", "__b").agg(F.min("dist").alias("dist")).select(F.col("__a").alias(aid), F.col("__b").alias(bid), "dist")


def railways(lines_status: DataFrame, lines_kind: DataFrame, segments: DataFrame, r: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """R-2: railway groups (high-speed if any part is) and segments linked to groups within ``r`` metres.

    lines_status: code_ligne, lib_ligne, line (vertex list, projected metres)
    lines_kind:   code_ligne, catlig
    segments:     gid, id, nature, line
    """
    kinds = lines_kind.groupBy("code_ligne").agg(any_equals(F.col("catlig"), RAIL_HIGH_SPEED).alias("lgv"))
    g = lines_status.join(kinds, "code_ligne")
    groups = g.groupBy("code_ligne", "lib_ligne", "lgv").agg(F.count(F.lit(1)).alias("n_parts")).select(
        F.col("code_ligne").alias("code"),
        F.concat(F.when(F.col("lgv"), F.lit(RAIL_GROUP_LGV)).otherwise(F.lit(RAIL_GROUP_OTHER)), F.col("code_ligne"), F.lit(" "), F.col("lib_ligne")).alias("name"),
        "n_parts",
    )
    # the group's geometry stays in long form (one row per part): no group is gathered into one row
    glines = g.select(F.col("code_ligne").alias("code"), "line")
    seg = dedupe_min(segments).filter(F.col("nature").isin(*RAIL_NATURES))
    near = lines_within(seg.select(F.col("id").alias("sid"), "line"), glines.select(F.col("code").alias("gcode"), "line"), r,
                        aid="sid", bid="gcode").select("sid", "gcode").distinct()
    linked = agg_text(near, ["sid"], "gcode", "groups")
    out = linked.join(seg.withColumnRenamed("id", "sid"), "sid").select(
        F.col("sid").alias("linear_code"), F.col("groups"),
        F.concat(F.col("groups"), F.lit(" "), F.col("sid")).alias("linear_name"),
        classify([(F.col("nature") == RAIL_NATURES[2], RAIL_TYPE_LGV), (F.col("nature").isin(*RAIL_NATURES[:2]), RAIL_TYPE_MAIN)]).alias("id_type"),
    )
    return groups, out


def waterways(segments: DataFrame, rivers: DataFrame) -> DataFrame:
    """R-3: navigable segments with the names of their rivers (list column split on '/').

    segments: id, id_ce ('a/b'), nom (may be NULL); rivers: id, toponyme
    """
    j = join_list(segments, "id_ce", "/", rivers.select(F.col("id").alias("ce_id"), "toponyme"), "ce_id", "left")
    names = j.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("toponyme")), ", ").alias("noms"))
    return segments.join(names, "id", "left").select("id", F.coalesce(F.nullif(F.col("noms"), F.lit("")), F.col("nom")).alias("name"))


def markers(points: DataFrame, areas: DataFrame, keep_types: list[str]) -> DataFrame:
    """R-4: kilometre markers: dedupe, department code from the area, JSON extras, multi-points dumped.

    points: gid, id, route, numero, cote, type, dept_name, geom; areas: area_name, area_code
    """
    p = dedupe_min(points).filter(F.col("type").isin(*keep_types))
    p = p.withColumn("dept", F.lit(None).cast("string"))
    p = update_from(p, areas.select(F.col("area_name").alias("dept_name"), "area_code"), ["dept_name"], {"dept": F.col("__o_area_code")})
    p = p.withColumn("additional_data", json_of(["numero", "cote"]))
    return geo.explode_parts(p, "geom", "geom_part").drop("geom").withColumnRenamed("geom_part", "geom")


def observations(points: DataFrame, lines: DataFrame, polygons: DataFrame, descr: DataFrame, exclude_sensitive: bool = True) -> DataFrame:
    """R-5: one observation view from three geometry tables.

    Each geometry table: id_obs, geom, precision; descr: id_obs (may carry '.suffix'), cd_nom, sensitive, altitude
    """
    geoms = union_distinct([d.select("id_obs", "geom", "precision") for d in (points, lines, polygons)])
    d = descr.withColumn("id_key", F.when(F.instr("id_obs", ".") > 0, F.substring_index("id_obs", ".", 1)).otherwise(F.lit("")))
    out = geoms.join(d.drop("id_obs"), geoms.id_obs == d.id_key, "inner")
    if exclude_sensitive:
        out = out.filter(~F.coalesce(F.col("sensitive"), F.lit(False)))
    return out.select("id_obs", "cd_nom", round_half_up(F.col("altitude")).alias("altitude"),
                      F.coalesce(F.col("precision"), F.lit("unknown")).alias("precision"), "geom")


def _routes(a: DataFrame, b: DataFrame) -> DataFrame:
    return union_distinct([a.select("numero", "geom"), b.select("numero", "geom")])


def _with_route_code(c: DataFrame) -> DataFrame:
    num = F.regexp_replace(F.col("numero"), r"\s+", "")
    id_type = classify([(num.like(p), code) for p, code in ROUTE_PREFIX_CODES], ROUTE_DEFAULT_CODE)
    return c.select(num.alias("code"), id_type.alias("id_type"), *(x for x in c.columns if x != "numero"))


def route_parts(a: DataFrame, b: DataFrame) -> DataFrame:
    """R-6 in long form: merge two route tables, one row ``(code, id_type, part)`` for each part of a route.

    a, b: numero, geom
    """
    return _with_route_code(geo.collect_parts(_routes(a, b), ["numero"], "geom"))


def route_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """R-6: per merged route ``(code, id_type, kind, srid, n_parts, bbox)``; a route may have any number of parts."""
    return _with_route_code(geo.collect_summary(_routes(a, b), ["numero"], "geom"))


def merge_routes(a: DataFrame, b: DataFrame) -> DataFrame:
    """R-6: merge two route tables, one geometry per route, normalised number and type by prefix.

    A geometry holds all parts of its route: for the routes of a page;
    ``route_parts`` and ``route_summary`` take whole tables.

    a, b: numero, geom
    """
    return _with_route_code(geo.collect(_routes(a, b), ["numero"], "geom"))


def reassign(df: DataFrame, mapping: DataFrame, on: list[str], column: str, new_col: str) -> DataFrame:
    """R-7: bulk re-assignment: ``column`` takes ``mapping.new_col`` where keys match."""
    return update_from(df, mapping, on, {column: F.col(f"__o_{new_col}")})


def profile(df: DataFrame, by: list[str], key: str, other: DataFrame | None = None, other_key: str | None = None) -> dict[str, DataFrame]:
    """R-8: source profiling: frequencies, duplicated keys, rows without a match elsewhere."""
    out = {"frequencies": frequencies(df, by)}
    out["duplicated_keys"] = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    if other is not None:
        out["unmatched"] = df.join(other.select(F.col(other_key or key).alias(key)), key, "left_anti")
    return out
