"""Sinks: CSV, GeoJSON, nested JSON and flat records.

All writers are distributed (one file per partition); a single output file
is an explicit opt-in (``single_file=True``) for small exports only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.catalog import SEP, qcol
from relata.operators import geo


def render_cell(c: Column, dtype: T.DataType, labels: list[str] | None = None) -> Column:
    """Flat text of one value (P10): lists joined by ', ', records joined by '_', booleans as labels.

    Boolean labels: [true, false] or [true, false, null]; NULL gives the third label when present.
    """
    if isinstance(dtype, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: render_cell(x, dtype.elementType)), ", ")
    if isinstance(dtype, T.StructType):
        return F.concat_ws("_", *[render_cell(c[f.name], f.dataType) for f in dtype.fields])
    if isinstance(dtype, T.BooleanType) and labels:
        null_label = F.lit(labels[2]) if len(labels) > 2 else F.lit(None).cast("string")
        return F.when(c, F.lit(labels[0])).when(~c, F.lit(labels[1])).otherwise(null_label)
    return c.cast("string")


def flatten(df: DataFrame, sep: str = ".", labels: dict[str, list[str]] | None = None) -> DataFrame:
    """Flat records (S12): list and record columns rendered as text (booleans too when labels
    are given), scalar columns kept with their type; path separators shown as ``sep``."""
    labels = labels or {}
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType)) or (isinstance(f.dataType, T.BooleanType) and f.name in labels):
            c = render_cell(c, f.dataType, labels.get(f.name))
        out.append(c.alias(f.name.replace(SEP, sep)))
    return df.select(*out)


def export_headers(df: DataFrame, defs: list[str], titles: dict[str, str] | None = None, use_titles: bool = False) -> DataFrame:
    """Column headings (P11): ``field,header`` pairs, else the title of the first path part when asked."""
    titles = titles or {}
    out = []
    for d in defs:
        if "," in d:
            f, h = d.split(",", 1)
        else:
            f, h = d, None
        name = f.replace(".", SEP)
        if h is None and use_titles:
            h = titles.get(f.split(".")[0])
        out.append(qcol(name).alias(h or f))
    return df.select(*out)


def export_csv(df: DataFrame, path: str, sep: str = ",", single_file: bool = False, mode: str = "errorifexists") -> str:
    """CSV with a header row, cells flattened."""
    flat = flatten(df)
    if single_file:
        flat = flat.coalesce(1)
    flat.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


def geojson_features(df: DataFrame, geom_col: str, id_col: str | None = None) -> DataFrame:
    """One GeoJSON Feature per row as text (S10/G11); geometry taken out of the properties."""
    props = [qcol(c) for c in df.columns if c != geom_col]
    feat = F.concat(
        F.lit('{"type":"Feature","geometry":'), F.coalesce(geo.to_geojson_geometry(qcol(geom_col)), F.lit("null")),
        F.lit(',"properties":'), F.to_json(F.struct(*props)) if props else F.lit("{}"),
        F.lit("}"),
    )
    return df.select(feat.alias("feature"))


def write_geojson(df: DataFrame, geom_col: str, path: str, mode: str = "errorifexists") -> str:
    """Feature-per-line GeoJSON (GeoJSON text sequence); readers wrap lines in a FeatureCollection."""
    geojson_features(df, geom_col).write.mode(mode).text(path)
    return path


def feature_collection(df: DataFrame, geom_col: str) -> DataFrame:
    """A single FeatureCollection document (for page-sized frames only: one row holds all features)."""
    f = geojson_features(df, geom_col)
    return f.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("geojson"))


def write_nested_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Nested records, one JSON object per line."""
    df.write.mode(mode).json(path)
    return path
