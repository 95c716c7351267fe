"""Value-fits-type checks and typed casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_RE = r"^\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"

SPARK_TYPES = {
    "integer": "int",
    "boolean": "boolean",
    "number": "double",
    "string": "string",
    "date": "date",
    "datetime": "timestamp_ntz",
    "uuid": "string",
    "json": "string",
    "geometry": None,
}


#: What a value must look like before it is cast: casts alone take suffixes (12d) and parts of dates (2020-01).
FORMS = {
    "integer": r"^[+-]?[0-9]+$",
    "number": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "date": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "datetime": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$",
}


def fits_type(c: Column, kind: str) -> Column:
    """True when text ``c`` converts to ``kind`` (E1); NULL input fits; never raises; unknown type is false."""
    t = F.trim(c)
    if kind in FORMS:
        ok = t.rlike(FORMS[kind]) & t.try_cast(SPARK_TYPES[kind]).isNotNull()
    elif kind == "boolean":
        ok = F.lower(t).isin("true", "t", "false", "f", "yes", "y", "no", "n", "1", "0", "on", "off")
    elif kind == "string":
        ok = F.lit(True)
    elif kind == "uuid":
        ok = t.rlike(UUID_RE)
    elif kind == "json":
        ok = F.try_parse_json(c).isNotNull()
    elif kind == "geometry":
        from relata.operators.geo import is_valid_wkt

        ok = is_valid_wkt(c)
    else:
        ok = F.lit(False)
    return F.when(c.isNull(), F.lit(True)).otherwise(F.coalesce(ok, F.lit(False)))


def cast_to(c: Column, kind: str, srid: int = 4326) -> Column:
    """Typed cast after the check (E2); impossible values become NULL."""
    t = F.trim(c)
    if kind == "boolean":
        lo = F.lower(t)
        return F.when(lo.isin("true", "t", "yes", "y", "1", "on"), F.lit(True)).when(
            lo.isin("false", "f", "no", "n", "0", "off"), F.lit(False)
        )
    if kind == "uuid":
        return F.when(t.rlike(UUID_RE), F.lower(F.regexp_replace(t, r"[{}]", "")))
    if kind == "geometry":
        from relata.operators.geo import parse_wkt

        return parse_wkt(c, srid)
    if kind in ("string", "json"):
        return c
    return t.try_cast(SPARK_TYPES[kind])


def differs(a: Column, b: Column) -> Column:
    """``a IS DISTINCT FROM b``."""
    return ~a.eqNullSafe(b)


def row_hash(*cols: Column) -> Column:
    """Row fingerprint ``md5`` of the JSON of the columns."""
    return F.md5(F.to_json(F.struct(*cols)))


def content_uuid(run_id: str, *cols: Column) -> Column:
    """Deterministic UUID from the run id and the group columns.

    Same input, same value on every recompute (a random UUID would change
    when a lost task is re-run).
    """
    h = F.md5(F.concat_ws("\u0001", F.lit(run_id), *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.substring(h, 17, 4), F.substring(h, 21, 12),
    )
