"""Record validation (C20): rules become one array of error structs per row, exploded.

Rules per column: ``type`` (one of the nine definition types, checked on
the text form), ``required``, ``minimum``, ``maximum``, ``enum``,
``pattern`` (regex), ``geometry_type``.  Output: pk, field, rule, value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.catalog import qcol
from relata.functions.types import fits_type


def validate(df: DataFrame, pk: str, rules: dict[str, dict]) -> DataFrame:
    checks = []

    def err(field, rule, cond, value):
        return F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), value.cast("string").alias("value")))

    for c, r in rules.items():
        col = qcol(c)
        if r.get("required"):
            checks.append(err(c, "required", col.isNull(), col))
        if "type" in r:
            checks.append(err(c, "type", ~fits_type(col.cast("string"), r["type"]), col))
        if "minimum" in r:
            checks.append(err(c, "minimum", col < F.lit(r["minimum"]), col))
        if "maximum" in r:
            checks.append(err(c, "maximum", col > F.lit(r["maximum"]), col))
        if "enum" in r:
            checks.append(err(c, "enum", col.isNotNull() & ~col.isin(list(r["enum"])), col))
        if "pattern" in r:
            checks.append(err(c, "pattern", col.isNotNull() & ~col.cast("string").rlike(r["pattern"]), col))
        if "geometry_type" in r:
            checks.append(err(c, "geometry_type", col.isNotNull() & (F.upper(col["kind"]) != r["geometry_type"].upper()), col["kind"]))
    if not checks:
        return df.sparkSession.createDataFrame([], f"{pk} string, field string, rule string, value string")
    arr = F.array_compact(F.array(*checks))
    return df.select(qcol(pk), F.explode(arr).alias("e")).select(pk, "e.field", "e.rule", "e.value")
