"""Bulk import as a chain of DataFrame stages.

Steps, in order, stopping at the first step that reports errors:

    init, data_table, mapping_view, pre_check, raw_view, import_view,
    relations_view, post_check, count, update, insert, relations_data

``id_import`` (the staged line number) travels through every stage so each
error names its lines.  Errors are rows of one DataFrame (S16):
``error_code, key, value, nb_lines, lines, valid_values, msg``; only
"is there any error" is asked on the driver (``isEmpty``).

Nothing is updated in place: ``update``/``insert`` produce the new table
as a DataFrame (``result.table``); ``commit_table`` writes it as a new
snapshot directory.
"""

from __future__ import annotations

import dataclasses
import re
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.catalog import Catalog, qcol
from relata.functions.text import json_of, split_list
from relata.functions.types import cast_to, content_uuid, fits_type
from relata.operators import aggregates as agg
from relata.operators import geo
from relata.operators.ordering import with_row_number
from relata.plans.step_log import StepLog
from relata.sources import stage
from relata.sources.stage import ERROR_SCHEMA, Staged, bad_rows, good_rows

STEPS = [
    "init", "data_table", "mapping_view", "pre_check", "raw_view", "import_view",
    "relations_view", "post_check", "count", "update", "insert", "relations_data",
]

# Words refused in mapping expressions (one statement, no DDL/DML).
FORBIDDEN_WORDS = ["INSERT", "DROP", "DELETE", "UPDATE", "EXECUTE", "TRUNCATE", "ALTER", "CREATE", "GRANT", "COPY", "PERFORM"]

#: What may stand before a bracket in a mapping expression: operators, and functions of their arguments alone.
EXPRESSION_WORDS = frozenset("""
and or not in when then else case is between like ilike rlike decimal varchar char
cast try_cast coalesce nullif nvl ifnull if greatest least isnull isnotnull
concat concat_ws upper lower initcap trim ltrim rtrim btrim left right lpad rpad repeat reverse translate replace
substring substr split_part split length char_length instr locate position contains startswith endswith
regexp_replace regexp_extract regexp_substr regexp_count regexp_like md5 sha1 sha2 crc32
abs ceil ceiling floor round bround sign mod pmod power sqrt exp ln log10 format_number
to_date try_to_date to_timestamp try_to_timestamp date_format make_date date_add date_sub datediff add_months year month day hour minute
array array_join array_contains element_at size struct named_struct to_json get_json_object
""".split())
#: Staged and stored links that one task compares.
LINK_ROWS = 1_000_000
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`""", re.S)

@dataclass
class FieldSpec:
    type: str = "string"
    required: bool = False
    ref: str | None = None  # object code of a foreign key, resolved by natural key
    ref_unique: list[str] | None = None
    code_type: str | None = None  # code-list type: resolved against (type, code)
    nn: str | None = None  # n-n: object code of the linked rows; text holds a comma list of codes
    nn_unique: str | None = None
    srid: int | None = None
    geometry_type: str | None = None  # e.g. "multipolygon": single geometries are wrapped (G1)
    minimum: float | None = None
    default_uuid: bool = False
    nullable_key: bool = False


@dataclass
class ImportSpec:
    code: str
    fields: dict[str, FieldSpec]
    unique: list[str]
    mapping: dict | None = None
    values: dict | None = None
    skip_check_on: list[str] = field(default_factory=list)
    creator: tuple[str, object] | None = None
    srid: int | None = None
    target_step: str | None = None
    skip_steps: list[str] = field(default_factory=list)
    run_id: str = "run"
    parent_key: str | None = None  # for 1-n child imports: column holding the parent's natural key
    children: dict = field(default_factory=dict)  # relation name -> ChildSpec
    where: str | None = None  # row filter applied in the mapping step (F20)
    copy: dict = field(default_factory=dict)  # column -> columns that take its resolved value where they have none (C17)


@dataclass
class ChildSpec:
    """A 1-n relation imported from dotted columns ``<relation>.<column>``."""

    code: str  # child object
    fk: str  # child column pointing at the parent's PK
    fields: dict[str, FieldSpec] = field(default_factory=dict)


class MappingError(ValueError):
    pass


@dataclass
class ImportResult:
    status: str = "PENDING"
    res: dict = field(default_factory=dict)
    steps: dict = field(default_factory=dict)
    frames: dict = field(default_factory=dict)
    errors: DataFrame | None = None
    table: DataFrame | None = None
    links: dict = field(default_factory=dict)
    children: dict = field(default_factory=dict)
    last_step: str | None = None
    row_errors: DataFrame | None = None  # of a feature load: every error of every row
    resumed: list = field(default_factory=list)  # steps taken from an earlier run's log
    run: object = None

    def release(self) -> None:
        """Drop the persisted intermediate frames of the run."""
        if self.run is not None:
            self.run.release()


# ---------------------------------------------------------------- stage functions
def map_fields(df: DataFrame, mapping: dict | None, values: dict | None = None, where: str | None = None) -> DataFrame:
    """Field and value mapping.

    ``mapping[target]`` may be a source column name (rename), a list of
    columns (JSON object text), a SQL scalar expression (must contain ``(``
    or ``'``), or a non-string literal.  A plain name that is not a column is
    skipped.  Unmapped source columns are kept.  Statements and forbidden
    words are refused.
    """
    mapping = mapping or {}
    values = values or {}
    cols = df.columns
    out: list[tuple[str, Column]] = []
    used = set()
    for key, v in mapping.items():
        if isinstance(v, list):
            present = [x for x in v if x in cols]
            if not present:
                continue
            c = json_of(present)
        elif isinstance(v, str):
            if v in cols:
                c = qcol(v)
            elif "'" in v or "(" in v:
                check_expression(v)
                c = F.expr(v)
            else:
                continue
        else:
            c = F.lit(v)
        if key in values and values[key]:
            m = values[key]
            cc = None
            for src, dst in m.items():
                cond = c.cast("string") == F.lit(str(src))
                cc = F.when(cond, F.lit(str(dst))) if cc is None else cc.when(cond, F.lit(str(dst)))
            c = cc.otherwise(c.cast("string"))
        out.append((key, c))
        used.add(key)
    for c in cols:
        if c not in used:
            out.append((c, qcol(c)))
    if where:  # business-rule row filter of the mapping (F20)
        check_expression(where)
        df = df.filter(F.expr(where))
    return df.select(*[c.alias(k) for k, c in out])


def check_expression(expr: str) -> None:
    """One scalar expression of known functions only; refuse statements, queries and the fixed forbidden words."""
    bare = _QUOTED.sub(" 0 ", expr)  # what is quoted is data
    if re.search(r"[;'\"`]|--|/\*", bare):
        raise MappingError(f"mapping expression must be one statement: {expr!r}")
    if re.search(r"\b(select|from|with|table|values)\b", bare, re.I):
        raise MappingError(f"mapping expression must not hold a query: {expr!r}")
    unknown = sorted({n for n in re.findall(r"([A-Za-z_][\w.]*)\s*\(", bare) if n.lower() not in EXPRESSION_WORDS})
    if unknown:
        raise MappingError(f"function(s) {', '.join(unknown)} not allowed in mapping expression {expr!r}")
    up = expr.upper()
    bad = [w for w in FORBIDDEN_WORDS if re.search(rf"{w}\s", up)]  # the word followed by a blank
    if bad:
        raise MappingError(f"forbidden word(s) {', '.join(bad)} in mapping expression {expr!r}")


def fill_natural_key(df: DataFrame, spec: ImportSpec, own: list[str]) -> DataFrame:
    """Missing unique columns added as NULL; defaulted (uuid) ones filled per group of identical own columns."""
    for u in spec.unique:
        if u not in df.columns:
            df = df.withColumn(u, F.lit(None).cast("string"))
    for u in spec.unique:
        fs = spec.fields.get(u)
        if fs and fs.default_uuid:
            group = [qcol(c) for c in own if c != u and c in df.columns]
            df = df.withColumn(u, F.coalesce(qcol(u), content_uuid(spec.run_id, *group)))
    return df


def _error_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ERROR_SCHEMA)


def _errors(df: DataFrame, code: str, key: str, msg: str, valid: str | None = None) -> DataFrame:
    """Shape a value profile (value, nb_lines, lines) as error rows."""
    return df.select(
        F.lit(code).alias("error_code"), F.lit(key).alias("key"), F.col("value").cast("string").alias("value"),
        F.col("nb_lines").cast("long").alias("nb_lines"), F.col("lines").cast("array<long>").alias("lines"),
        F.lit(valid).cast("string").alias("valid_values"), F.lit(msg).alias("msg"),
    )


def type_errors(df: DataFrame, spec: ImportSpec) -> DataFrame:
    """ERR_IMPORT_INVALID_VALUE_FOR_TYPE (C5/E1/A5) for all typed columns in one pass.

    Each failing cell becomes one (column, value, line) row (``explode`` of
    an array that holds only the failures), then one profile aggregate.
    """
    checks = []
    for c, fs in spec.fields.items():
        if c in df.columns and not (fs.ref or fs.code_type or fs.nn) and fs.type != "string":
            checks.append(F.when(~fits_type(qcol(c).cast("string"), fs.type), F.struct(F.lit(c).alias("key"), qcol(c).cast("string").alias("value"))))
    if not checks:
        return _error_frame(df.sparkSession)
    cells = df.select("id_import", F.explode(F.array_compact(F.array(*checks))).alias("e")).select("id_import", "e.key", "e.value")
    prof = agg.value_profile(cells, ["key", "value"])
    return prof.select(
        F.lit("ERR_IMPORT_INVALID_VALUE_FOR_TYPE").alias("error_code"), "key", "value",
        F.col("nb_lines").cast("long").alias("nb_lines"), F.col("lines").cast("array<long>").alias("lines"),
        F.lit(None).cast("string").alias("valid_values"), F.lit("invalid value for type").alias("msg"),
    )


def conflict_errors(df: DataFrame, spec: ImportSpec, own: list[str]) -> DataFrame:
    """ERR_IMPORT_UNIQUE_DOUBLON (A4): a natural key carried by several distinct rows."""
    cols = [c for c in own if c in df.columns and c not in spec.unique]
    if not cols:  # lines of one key have nothing to differ in
        return _error_frame(df.sparkSession)
    conf = agg.key_conflicts(df, spec.unique, cols)
    val = F.concat_ws("|", *[qcol(u).cast("string") for u in spec.unique])
    return conf.select(
        F.lit("ERR_IMPORT_UNIQUE_DOUBLON").alias("error_code"), F.lit(",".join(spec.unique)).alias("key"),
        val.alias("value"), F.col("nb_lines").cast("long").alias("nb_lines"), F.col("lines").cast("array<long>").alias("lines"),
        F.lit(None).cast("string").alias("valid_values"), F.lit("duplicates on the natural key").alias("msg"),
    )


def key_text(unique: list[str]) -> Column:
    """A natural key as one text, ``a|b``; bars and backslashes in values are escaped and NULL is ``\\N``, so keys never collide."""
    if len(unique) == 1:
        return qcol(unique[0]).cast("string")
    escaped = (F.regexp_replace(qcol(u).cast("string"), r"([|\\])", r"\\$1") for u in unique)
    return F.concat_ws("|", *(F.coalesce(e, F.lit("\\N")) for e in escaped))


def to_raw(df: DataFrame, spec: ImportSpec, pk: str, geom_col: str | None = None, child_of: str | None = None) -> DataFrame:
    """Typed frame (C6, C7, G1-G3): own and n-n columns cast, geometry built, pk := natural key text."""
    cols = []
    reproj: dict[str, tuple[int, int]] = {}
    multis: list[str] = []
    for c, fs in spec.fields.items():
        if c not in df.columns:
            continue
        if fs.ref or fs.code_type or fs.nn:
            cols.append(qcol(c).alias(c))
        elif fs.type == "geometry":
            src = spec.srid or fs.srid or 4326
            cols.append(geo.parse_wkt(qcol(c), src).alias(c))
            if fs.srid and src != fs.srid:
                reproj[c] = (src, fs.srid)
            if fs.geometry_type and fs.geometry_type.lower().startswith("multi"):
                multis.append(c)
        else:
            cols.append(cast_to(qcol(c), fs.type).alias(c))
    if geom_col and geom_col not in df.columns and "x" in df.columns and "y" in df.columns:
        fs = spec.fields.get(geom_col, FieldSpec("geometry"))
        src = spec.srid or fs.srid or 4326
        cols.append(geo.make_point(F.col("x").try_cast("double"), F.col("y").try_cast("double"), src).alias(geom_col))
        if fs.srid and src != fs.srid:
            reproj[geom_col] = (src, fs.srid)
    nk = key_text(spec.unique)
    extra = [qcol(spec.parent_key).alias(spec.parent_key)] if spec.parent_key and spec.parent_key in df.columns else []
    out = df.select("id_import", *cols, nk.alias("__nk"), *extra)
    for c, (src, dst) in reproj.items():  # reprojected from the parsed column, not from the parse expression
        out = out.withColumn(c, geo.reproject(qcol(c), src, dst))
    for c in multis:
        out = out.withColumn(c, geo.multi(qcol(c)))
    if child_of:
        own = [c for c in spec.fields if c in df.columns and c not in spec.unique]
        if own:
            out = out.filter(F.coalesce(*[qcol(c).cast("string") for c in own]).isNotNull())
    return out


def resolve_key(
    catalog: Catalog, df: DataFrame, col: str, target: str, unique: list[str] | None = None, out: str | None = None,
    nullable: bool = False, memo: dict | None = None,
) -> DataFrame:
    """Foreign-key resolution by natural key.

    One unique field: equi join on the code.  Several: ``split_part(v, '|', i)``
    against the i-th field.  A unique field that is itself a foreign key is
    resolved first (recursively).  Output column ``out`` holds the target PK
    (NULL when unresolved).  The dimension side is the target's distinct
    natural keys; its join strategy is left to the planner (broadcast only
    when the statistics say it is small).
    """
    sd = catalog.schema(target)
    unique = unique or sd.unique or [sd.pk]
    out = out or col
    dim = catalog.frame(target)
    key_cols = []
    parts = [F.split_part(qcol(col).cast("string"), F.lit("|"), F.lit(i + 1)) if len(unique) > 1 else qcol(col).cast("string")
             for i in range(len(unique))]
    tmp = df
    for i, u in enumerate(unique):
        rel = sd.relation(u) if sd.relation(u) else _rel_by_local(sd, u)
        pcol = f"__p{i}_{out}"
        if rel is not None and not rel.to_many:
            # unique part is itself a foreign key: resolve that first
            tmp = tmp.withColumn(f"__raw{i}_{out}", parts[i])
            tmp = resolve_key(catalog, tmp, f"__raw{i}_{out}", rel.target, None, pcol, memo=memo).drop(f"__raw{i}_{out}")
            key_cols.append((pcol, rel.local_key))
        else:
            dtype = dim.schema[u].dataType
            tmp = tmp.withColumn(pcol, parts[i].try_cast(dtype) if not isinstance(dtype, T.StringType) else parts[i])
            key_cols.append((pcol, u))
    # one PK per natural key, chosen deterministically (the smallest) if the key is not unique
    d = dim.groupBy(*[F.col(dc).alias(f"__d_{dc}") for _, dc in key_cols]).agg(F.min(sd.pk).alias(f"__dpk_{out}"))
    cond = None
    for pc, dc in key_cols:
        e = F.col(pc).eqNullSafe(F.col(f"__d_{dc}")) if nullable else (F.col(pc) == F.col(f"__d_{dc}"))
        cond = e if cond is None else cond & e
    j = tmp.join(d, cond, "left")
    res = j.drop(*[f"__d_{dc}" for _, dc in key_cols], *[pc for pc, _ in key_cols])
    if out in res.columns and out != col:
        res = res.drop(out)
    if out == col:
        res = res.drop(col)
    return res.withColumnRenamed(f"__dpk_{out}", out)


def _rel_by_local(sd, col):
    for r in sd.relations.values():
        if r.local_key == col and not r.to_many:
            return r
    return None


def resolve_code(catalog: Catalog, df: DataFrame, col: str, code_type: str, out: str | None = None) -> DataFrame:
    """Code-list resolution (J9, E23): code = value AND type = fixed type -> id.  Of several ids for one code the smallest counts."""
    out = out or col
    codes = catalog.frame("nomenclature").filter(F.col("type") == code_type).select(
        F.col("cd_nomenclature").alias(f"__cd_{out}"), F.col("id_nomenclature").alias(f"__id_{out}")
    ).groupBy(f"__cd_{out}").agg(F.min(f"__id_{out}").alias(f"__id_{out}"))
    j = df.join(codes, qcol(col).cast("string") == F.col(f"__cd_{out}"), "left").drop(f"__cd_{out}")
    if out == col:
        j = j.drop(col)
    elif out in j.columns:
        j = j.drop(out)
    return j.withColumnRenamed(f"__id_{out}", out)


def code_values(catalog: Catalog, code_type: str) -> str | None:
    """Valid codes of a type as one text value; one row fetched (the code list is fixed-size)."""
    return catalog.frame("nomenclature").filter(F.col("type") == code_type).agg(
        F.array_join(F.array_sort(F.collect_list("cd_nomenclature")), ", ").alias("valid_values")
    ).first()["valid_values"]


# ---------------------------------------------------------------- the run
class ImportRun:
    """One import: the staged frame of ``spec.code`` rows, then the steps in order.

    With ``steps`` (a folder on shared storage) the frames that later steps
    read are written there and each finished step is logged, so that a stopped
    run goes on after its last good step.  Without it they are persisted.
    """

    def __init__(self, catalog: Catalog, spec: ImportSpec, source: DataFrame | Staged, target: DataFrame | None = None, steps: str | None = None):
        self.cat = catalog
        self.spec = spec
        self.source = source
        self.sd = catalog.schema(spec.code)
        self.target = target if target is not None else catalog.frame(spec.code)
        self.r = ImportResult()
        self.err_parts: list[DataFrame] = []
        self._persisted: list[DataFrame] = []
        self.keep = True  # False: single steps are run and nobody calls release()
        self.spark = source.sparkSession
        self.log = StepLog(self.spark, steps, repr(dataclasses.replace(spec, target_step=None))) if steps else None
        self.written: dict[str, str] = {}

    # --- helpers
    def own_columns(self) -> list[str]:
        return [c for c, fs in self.spec.fields.items() if not fs.nn]

    def add_errors(self, df: DataFrame) -> None:
        self.err_parts.append(df)

    def _step_errors(self, start: int) -> DataFrame | None:
        """Errors added since ``start``, as one frame; ``None`` when there are none (one job)."""
        new = self.err_parts[start:]
        if not new:
            return None
        errs = new[0]
        for p in new[1:]:
            errs = errs.unionByName(p)
        # error rows are grouped summaries (one per bad value): small, kept for the report
        errs = errs.persist(StorageLevel.MEMORY_AND_DISK)
        if errs.isEmpty():
            errs.unpersist()
            return None
        self._persisted.append(errs)
        return errs

    def persist(self, name: str, df: DataFrame, **counts: Column) -> DataFrame:
        """Keep a frame that later steps read; ``counts`` are observed in the one job that writes or caches it.

        A persisted frame is recomputed from its lineage if an executor is lost.
        """
        watch = None
        if counts and (self.log or self.keep):
            df, watch = agg.observe_counts(df, f"{self.spec.code}_{name}", **counts)
        if self.log:
            df = self.log.write(self.step, name, df)
            self.written[name] = self.step
        elif self.keep:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(df)
            if watch:
                df.write.format("noop").mode("overwrite").save()
        if watch:
            self.r.res.update({k: int(v) for k, v in watch.get.items()})
        elif counts:
            self.r.res.update({k: int(v) for k, v in df.agg(*[c.alias(k) for k, c in counts.items()]).first().asDict().items()})
        self.r.frames[name] = df
        return df

    def run(self) -> ImportResult:
        self.r.status = "PROCESSING"
        found = None
        for step in STEPS:
            if step in self.spec.skip_steps:
                continue
            t0 = time.time()
            self.step, self.written = step, {}
            start = len(self.err_parts)
            done = self.log.read(step) if self.log else None
            if done:
                self.r.res.update(done["res"])
                self.r.frames.update({name: self.log.frame(step, name) for name in done["frames"]})
                self.r.resumed.append(step)
                self._derive(step)
                found = None
            else:
                getattr(self, f"step_{step}")()
                found = self._step_errors(start)
                if self.log and found is None:
                    self.log.finish(step, self.r.res, sorted(self.written), round(time.time() - t0, 3))
            self.r.steps[step] = done["seconds"] if done else round(time.time() - t0, 3)
            self.r.last_step = step
            if found is not None:
                self.r.status = "ERROR"
                break
            if self.spec.target_step == step:
                break
        if self.r.status == "PROCESSING":
            last = [s for s in STEPS if s not in self.spec.skip_steps][-1]
            self.r.status = "DONE" if self.log is None or self.r.last_step == last else "PENDING"
        self.r.errors = found if found is not None else _error_frame(self.spark)
        return self.r

    def _derive(self, step: str) -> None:
        """What a finished step leaves as plans alone is planned again; no job of the step runs twice."""
        if step in ("raw_view", "update", "insert", "relations_data"):
            getattr(self, f"step_{step}")()
        elif step == "relations_view":
            self.child_frames()
        elif step == "data_table" and "staged" in self.r.frames:
            self.r.frames["data"] = good_rows(self.r.frames["staged"])

    def release(self) -> None:
        """Drop persisted intermediate frames (call once the result has been written)."""
        for df in getattr(self, "_persisted", []):
            df.unpersist()

    # --- steps
    def step_init(self):
        if not self.spec.unique:
            raise ValueError("an import needs the natural key (unique) of its object")

    def step_data_table(self):
        # the staged rows are read by every later step: keep them after the first pass
        if not isinstance(self.source, Staged):
            self.persist("data", self.source, nb_data=F.count(F.lit(1)))
        elif self.source.fault is not None:  # the file cannot be read
            self.r.res["nb_data"] = 0
            self.add_errors(self.source.errors)
            return
        else:  # records that do not fit the header are error rows (S5)
            bad = F.col(stage.BAD)
            kept = self.persist("staged", self.source.parsed, nb_data=F.count_if(bad.isNull()), nb_bad=F.count_if(bad.isNotNull()))
            self.r.frames["data"] = good_rows(kept)
            if self.r.res["nb_bad"]:
                self.add_errors(bad_rows(kept))
                return
        if self.r.res["nb_data"] == 0:
            self.add_errors(self.spark.createDataFrame(
                [("ERR_IMPORT_DATA_EMPTY", None, None, 0, [], None, "no data")], ERROR_SCHEMA))

    def step_mapping_view(self):
        df = map_fields(self.r.frames.get("data", self.source), self.spec.mapping, self.spec.values, self.spec.where)
        dump_only = [c for c in self.sd.dump_only if c in df.columns]
        if dump_only:  # read-only columns are never written (P13)
            df = df.drop(*dump_only)
        missing = [u for u in self.spec.unique if u not in df.columns and not (self.spec.fields.get(u) and self.spec.fields[u].default_uuid)]
        if missing:
            self.add_errors(self.spark.createDataFrame(
                [("ERR_IMPORT_MISSING_UNIQUE", ",".join(missing), None, 0, [], None, "natural key columns missing")], ERROR_SCHEMA))
        df = fill_natural_key(df, self.spec, self.own_columns())
        # a row filter changes the count; without one the rows are those of the data
        self.persist("mapping", df, **({"nb_raw": F.count(F.lit(1))} if self.spec.where else {}))

    def step_pre_check(self):
        df = self.r.frames["mapping"]
        self.add_errors(conflict_errors(df, self.spec, self.own_columns()))
        self.add_errors(type_errors(df, self.spec))

    def step_raw_view(self):
        df = self.r.frames["mapping"]
        raw = to_raw(df, self.spec, self.sd.pk, self.sd.geometry)
        if self.spec.creator:
            col, user = self.spec.creator
            raw = raw.withColumn(col, F.lit(user))
        self.r.frames["raw"] = raw
        # the raw frame is a projection of the mapped one, whose rows were counted as it was kept
        if "nb_raw" not in self.r.res:
            self.r.res["nb_raw"] = self.r.res["nb_data"] if "nb_data" in self.r.res and not self.spec.where else raw.count()

    def resolved(self) -> DataFrame:
        df = self.r.frames["raw"]
        for c, fs in self.spec.fields.items():
            if c not in df.columns or fs.nn:
                continue
            if fs.code_type:
                df = df.withColumn(f"__raw_{c}", qcol(c))
                df = resolve_code(self.cat, df, c, fs.code_type)
            elif fs.ref:
                df = df.withColumn(f"__raw_{c}", qcol(c))
                df = resolve_key(self.cat, df, c, fs.ref, fs.ref_unique, nullable=fs.nullable_key)
        for key, others in self.spec.copy.items():
            for k in others:
                if key in df.columns and k in df.columns:
                    df = df.withColumn(k, F.coalesce(qcol(k), qcol(key).cast(df.schema[k].dataType)))
        # primary key by natural key against the current table
        t = self.target
        unique = self.spec.unique
        tk = t.groupBy(*[F.col(u).alias(f"__t_{u}") for u in unique]).agg(F.min(self.sd.pk).alias("__tpk"))
        cond = None
        for u in unique:
            dt = t.schema[u].dataType
            left = qcol(u) if u in df.columns else F.lit(None)
            left = left.try_cast(dt) if not isinstance(dt, T.StringType) else left.cast("string")
            e = left == F.col(f"__t_{u}")
            cond = e if cond is None else cond & e
        df = df.join(tk, cond, "left").drop(*[f"__t_{u}" for u in unique])
        if self.sd.pk in df.columns and self.sd.pk not in unique:
            df = df.drop(self.sd.pk)
        return df.withColumnRenamed("__tpk", "__pk")

    def step_import_view(self):
        res = self.persist("resolved", self.resolved())
        group = [c for c in res.columns if c not in ("id_import",) and not c.startswith("__raw_") and not self._is_nn(c)]
        self.persist("process", agg.collapse(res, group), nb_process=F.count(F.lit(1)), nb_insert=F.count_if(F.col("__pk").isNull()))

    def _is_nn(self, c):
        fs = self.spec.fields.get(c)
        return bool(fs and fs.nn)

    def step_relations_view(self):
        self.child_frames()
        proc = self.r.frames["process"]
        raw = self.r.frames["raw"]
        for c, fs in self.spec.fields.items():
            if not fs.nn or c not in raw.columns:
                continue
            # codes of the first line of each object (the collapsed row's line)
            first = raw.join(proc.select("id_import"), "id_import", "left_semi").select("__nk", "id_import", qcol(c).alias("__codes"))
            ex = first.select("__nk", "id_import", F.explode(split_list(F.col("__codes"), ",")).alias("__code"))
            ex = ex.filter(F.col("__code") != "")
            tsd = self.cat.schema(fs.nn)
            tu = fs.nn_unique or (tsd.unique[-1] if tsd.unique else tsd.pk)
            dimf = self.cat.frame(fs.nn)
            if fs.code_type:
                dimf = dimf.filter(F.col("type") == fs.code_type)
            dim = dimf.groupBy(F.col(tu).cast("string").alias("__code")).agg(F.min(tsd.pk).alias("__link"))
            links = ex.join(dim, "__code", "left")
            # read by the unresolved check, the update count and the link rebuild
            self.persist(f"nn_{c}", links)

    def child_frames(self):
        """Child rows from dotted columns, typed and resolved (everything but the parent key)."""
        mapped = self.r.frames["mapping"]
        for rel, ch in self.spec.children.items():
            prefix = rel + "."
            cols = [c for c in mapped.columns if c.startswith(prefix)]
            if not cols:
                continue
            own = [c[len(prefix):] for c in cols]
            cdf = mapped.select("id_import", *[qcol(u).alias(f"__parent_{u}") for u in self.spec.unique],
                                *[qcol(c).alias(c[len(prefix):]) for c in cols])
            cdf = cdf.filter(F.coalesce(*[qcol(c) for c in own]).isNotNull())  # C7: empty child rows dropped
            sel = []
            for c in own:
                fs = ch.fields.get(c, FieldSpec())
                sel.append(qcol(c).alias(c) if (fs.ref or fs.code_type) else cast_to(qcol(c), fs.type).alias(c))
            raw = cdf.select("id_import", *[F.col(f"__parent_{u}") for u in self.spec.unique], *sel)
            res = raw
            for c in own:
                fs = ch.fields.get(c, FieldSpec())
                if fs.code_type:
                    res = resolve_code(self.cat, res.withColumn(f"__raw_{c}", qcol(c)), c, fs.code_type)
                elif fs.ref:
                    res = resolve_key(self.cat, res.withColumn(f"__raw_{c}", qcol(c)), c, fs.ref, fs.ref_unique)
            self.r.frames[f"child_raw_{rel}"] = raw
            self.r.frames[f"child_{rel}"] = res

    def child_checks(self):
        for rel, ch in self.spec.children.items():
            if f"child_{rel}" not in self.r.frames:
                continue
            raw, res = self.r.frames[f"child_raw_{rel}"], self.r.frames[f"child_{rel}"]
            req = [c for c, fs in ch.fields.items() if fs.required and c in raw.columns]
            if req:
                prof = agg.required_profile(raw, req)
                self.add_errors(prof.select(
                    F.lit("ERR_IMPORT_REQUIRED").alias("error_code"), F.concat(F.lit(rel + "."), F.col("column")).alias("key"),
                    F.lit(None).cast("string").alias("value"), F.col("nb_lines").cast("long").alias("nb_lines"),
                    F.col("lines").cast("array<long>").alias("lines"), F.lit(None).cast("string").alias("valid_values"),
                    F.lit("required").alias("msg")))
            for c, fs in ch.fields.items():
                if (fs.ref or fs.code_type) and c in raw.columns:
                    bad = res.filter(F.col(f"__raw_{c}").isNotNull() & qcol(c).isNull()).select("id_import", F.col(f"__raw_{c}").alias("value"))
                    e = _errors(agg.value_profile(bad, ["value"]), "ERR_IMPORT_UNRESOLVED", f"{rel}.{c}", "no match")
                    if fs.code_type:
                        e = e.withColumn("valid_values", F.lit(code_values(self.cat, fs.code_type)))
                    self.add_errors(e)

    def finish_children(self):
        """After the parent merge: parent key by natural key, children of touched parents replaced."""
        table = self.r.table if self.r.table is not None else self.target
        for rel, ch in self.spec.children.items():
            if f"child_{rel}" not in self.r.frames:
                continue
            res = self.r.frames[f"child_{rel}"]
            csd = self.cat.schema(ch.code)
            current = self.r.children.get(rel)
            if current is None:
                current = self.cat.frame(ch.code)
            keys = table.select(*[F.col(u).cast("string").alias(f"__pk_{u}") for u in self.spec.unique], F.col(self.sd.pk).alias("__parent_pk"))
            cond = None
            for u in self.spec.unique:
                e = F.col(f"__parent_{u}").cast("string") == F.col(f"__pk_{u}")
                cond = e if cond is None else cond & e
            own = [c for c in ch.fields if c in res.columns]
            rows = res.join(keys, cond, "inner").select(F.col("__parent_pk").alias(ch.fk), *[qcol(c) for c in own]).distinct()
            touched = rows.select(ch.fk).distinct()
            kept = current.join(touched, ch.fk, "left_anti")
            mx = current.agg(F.coalesce(F.max(csd.pk), F.lit(0)).alias("__mx")).first()["__mx"]  # one value
            numbered = with_row_number(rows, [F.col(ch.fk).asc()] + [qcol(c).asc_nulls_last() for c in own], "__rn").withColumn("__mx", F.lit(mx))
            pk_type = current.schema[csd.pk].dataType
            new = numbered.select(*[
                ((F.col("__mx") + F.col("__rn")).cast(pk_type) if c == csd.pk else (qcol(c).cast(current.schema[c].dataType) if c in numbered.columns
                                                                                      else F.lit(None).cast(current.schema[c].dataType))).alias(c)
                for c in current.columns])
            self.r.children[rel] = kept.unionByName(new)
            self.r.res[f"nb_{rel}"] = new.count()

    def step_post_check(self):
        raw = self.r.frames["raw"]
        req = [c for c, fs in self.spec.fields.items() if fs.required and c in raw.columns]
        if req:
            prof = agg.required_profile(raw, req)
            self.add_errors(prof.select(
                F.lit("ERR_IMPORT_REQUIRED").alias("error_code"), F.col("column").alias("key"), F.lit(None).cast("string").alias("value"),
                F.col("nb_lines").cast("long").alias("nb_lines"), F.col("lines").cast("array<long>").alias("lines"),
                F.lit(None).cast("string").alias("valid_values"), F.lit("required").alias("msg"),
            ))
        self.child_checks()
        res = self.r.frames["resolved"]
        for c, fs in self.spec.fields.items():
            if c in self.spec.skip_check_on or c not in raw.columns:
                continue
            if (fs.ref or fs.code_type) and not fs.nn:
                bad = res.filter(F.col(f"__raw_{c}").isNotNull() & qcol(c).isNull()).select("id_import", F.col(f"__raw_{c}").alias("value"))
                prof = agg.value_profile(bad, ["value"])
                valid = None
                e = _errors(prof, "ERR_IMPORT_UNRESOLVED", c, "no match", valid)
                if fs.code_type:
                    e = e.withColumn("valid_values", F.lit(code_values(self.cat, fs.code_type)))
                self.add_errors(e)
            if fs.nn and f"nn_{c}" in self.r.frames:
                links = self.r.frames[f"nn_{c}"]
                bad = links.filter(F.col("__link").isNull()).select("id_import", F.col("__code").alias("value"))
                self.add_errors(_errors(agg.value_profile(bad, ["value"]), "ERR_IMPORT_UNRESOLVED", c, "no match"))

    def changed_condition(self, cols: list[str]) -> Column:
        cond = F.lit(False)
        for c in cols:
            cond = cond | ~F.col(f"__new_{c}").eqNullSafe(F.col(f"__old_{c}"))
        return cond

    def update_columns(self) -> list[str]:
        proc = self.r.frames["process"]
        creator = self.spec.creator[0] if self.spec.creator else None
        return [c for c in proc.columns if c in self.target.columns and c != self.sd.pk and c != creator and not c.startswith("__")
                and c not in ("id_import", "nb_lines")]

    def compare_frame(self) -> DataFrame:
        """Matched process rows side by side with the current rows (null-safe per column)."""
        proc = self.r.frames["process"]
        cols = self.update_columns()
        new = proc.filter(F.col("__pk").isNotNull()).select(F.col("__pk"), *[qcol(c).alias(f"__new_{c}") for c in cols])
        old = self.target.select(F.col(self.sd.pk).alias("__pk"), *[qcol(c).alias(f"__old_{c}") for c in cols])
        cmp = new.join(old, "__pk", "inner")
        return cmp

    def nn_columns(self) -> list[str]:
        return [c for c, fs in self.spec.fields.items() if fs.nn and f"nn_{c}" in self.r.frames]

    def link_diff(self, c: str) -> DataFrame:
        """One row per stored or staged link of existing objects: ``__pk, __link, __new, __old, __touched``.

        The full outer comparison of both sides on (key, link) is one
        aggregate over their union, dealt to tasks of about ``LINK_ROWS``
        rows; no object's list is gathered.  The changed objects (A9), their count (C16) and the rebuilt
        rows (C15) are all read from it.
        """
        name = f"diff_{c}"
        if name in self.r.frames:
            return self.r.frames[name]
        links = self.r.frames[f"nn_{c}"].filter(F.col("__link").isNotNull()).select("__nk", "__link")
        known = self.r.frames["process"].filter(F.col("__pk").isNotNull()).select("__nk", "__pk")
        staged = links.join(known, "__nk").select("__pk", "__link", F.lit(True).alias("__new"), F.lit(False).alias("__old"))
        stored = self.links_store(c).select("__pk", "__link", F.lit(False).alias("__new"), F.lit(True).alias("__old"))
        # dealt by their number before the aggregate: nearly all pairs are distinct, and no task is to keep more than it can hold
        tasks = 1 + (links.count() + stored.count()) // LINK_ROWS
        dealt = staged.unionByName(stored).repartition(tasks, "__pk", "__link")
        both = dealt.groupBy("__pk", "__link").agg(F.max("__new").alias("__new"), F.max("__old").alias("__old"))
        touched = known.select("__pk", F.lit(True).alias("__touched")).distinct()
        return self.persist(name, both.join(touched, "__pk", "left").withColumn("__touched", F.coalesce("__touched", F.lit(False))))

    def nn_changed(self) -> DataFrame | None:
        """Objects whose n-n code set differs from the stored one."""
        out = None
        for c in self.nn_columns():
            diff = self.link_diff(c).filter(F.col("__touched") & (F.col("__new") != F.col("__old"))).select("__pk")
            out = diff if out is None else out.unionByName(diff)
        return out

    def links_store(self, c: str) -> DataFrame:
        """Current n-n rows of column ``c``: (__pk, __link), perhaps repeated; the bridge of the relation, if none were given."""
        s = self.r.links.get(c)
        if s is not None:
            return s
        rel = self.sd.relation(c)
        if rel is not None and rel.kind == "n-n" and rel.bridge in self.cat.codes():
            return self.cat.frame(rel.bridge).select(
                F.col(rel.bridge_local).alias("__pk"), F.col(rel.bridge_foreign).alias("__link"))
        return self.spark.createDataFrame([], "__pk long, __link long")

    def step_count(self):
        if "pre_check" in self.spec.skip_steps:  # conflicting lines of one key were not refused
            key = F.when(F.col("__pk").isNull(), F.struct(*[qcol(u) for u in self.spec.unique]))
            self.r.res["nb_insert"] = int(self.r.frames["process"].agg(F.count_distinct(key)).first()[0])
        cmp = self.compare_frame()
        changed = cmp.filter(self.changed_condition(self.update_columns())).select("__pk")
        nn = self.nn_changed()
        if nn is not None:
            changed = changed.unionByName(nn).distinct()
        self.r.frames["changed"] = changed
        self.r.res["nb_update"] = changed.count()
        self.r.res["nb_unchanged"] = self.r.res["nb_process"] - self.r.res["nb_insert"] - self.r.res["nb_update"]

    def step_update(self):
        """Changed rows rewritten (C13): every own column but the PK and the creator."""
        cols = self.update_columns()
        proc = self.r.frames["process"].filter(F.col("__pk").isNotNull())
        # one row per PK (conflicting rows were refused by the pre-check); min(struct) keeps the choice deterministic
        new = proc.groupBy("__pk").agg(F.min(F.struct(*[qcol(c).alias(f"__new_{c}") for c in cols])).alias("__r")) if cols else \
            proc.select("__pk").distinct()
        if cols:
            new = new.select("__pk", *[F.col(f"__r.__new_{c}").alias(f"__new_{c}") for c in cols])
        t = self.target.join(new, self.target[self.sd.pk] == F.col("__pk"), "left")
        sel = []
        for c in self.target.columns:
            if c in cols:
                sel.append(F.when(F.col("__pk").isNotNull(), F.col(f"__new_{c}")).otherwise(qcol(c)).alias(c))
            else:
                sel.append(qcol(c))
        self.r.table = t.select(*sel)

    def step_insert(self):
        """New rows (C14): NULL PK; integer PKs continue after the current maximum, in natural-key order."""
        proc = self.r.frames["process"].filter(F.col("__pk").isNull())
        base = self.r.table if self.r.table is not None else self.target
        keep = [c for c in proc.columns if c not in self.spec.unique]
        new = proc.groupBy(*[qcol(u) for u in self.spec.unique]).agg(F.min(F.struct(*[qcol(c) for c in keep])).alias("__r"))
        new = new.select(*[qcol(u) for u in self.spec.unique], *[F.col(f"__r.`{c}`").alias(c) for c in keep])
        pk_type = self.target.schema[self.sd.pk].dataType
        if self.sd.pk in self.spec.unique:
            new = new.withColumn("__newpk", qcol(self.sd.pk).try_cast(pk_type))
        elif isinstance(pk_type, (T.IntegerType, T.LongType)):
            mx = self.target.agg(F.coalesce(F.max(self.sd.pk), F.lit(0)).alias("__mx")).first()["__mx"]  # one value
            order = [qcol(u).asc_nulls_last() for u in self.spec.unique]
            new = with_row_number(new, order, "__rn").withColumn("__mx", F.lit(mx))
            new = new.withColumn("__newpk", (F.col("__mx") + F.col("__rn")).cast(pk_type))
        else:
            new = new.withColumn("__newpk", F.col("__nk"))
        self.r.frames["inserted"] = new
        sel = []
        for c in self.target.columns:
            if c == self.sd.pk:
                sel.append(F.col("__newpk").alias(c))
            elif c in new.columns:
                sel.append(qcol(c).cast(self.target.schema[c].dataType).alias(c))
            else:
                sel.append(F.lit(None).cast(self.target.schema[c].dataType).alias(c))
        self.r.table = base.unionByName(new.select(*sel))

    def step_relations_data(self):
        """Replace n-n rows of touched objects (C15): delete-using (anti join) then insert; then 1-n children."""
        self.finish_children()
        for c in self.nn_columns():
            # every imported object's rows are replaced, also when its list is empty now
            diff = self.link_diff(c)
            rows = diff.filter(F.when(F.col("__touched"), F.col("__new")).otherwise(F.col("__old"))).select("__pk", "__link")
            if self.r.res.get("nb_insert") != 0 and "inserted" in self.r.frames:
                links = self.r.frames[f"nn_{c}"].filter(F.col("__link").isNotNull()).select("__nk", "__link")
                fresh = self.r.frames["inserted"].select("__nk", F.col("__newpk").alias("__pk"))
                rows = rows.unionByName(links.join(fresh, "__nk").select("__pk", "__link").distinct())
            self.r.links[c] = rows


def run_import(catalog: Catalog, spec: ImportSpec, source: DataFrame | Staged, target: DataFrame | None = None,
               links: dict | None = None, children: dict | None = None, steps: str | None = None) -> ImportResult:
    """Run an import (C1) of staged rows, or of a staged file, whose bad records are then the run's errors.

    ``links`` holds current n-n rows per column as (__pk, __link) frames;
    ``children`` the current child tables per 1-n relation.  ``steps`` names a
    folder on shared storage that keeps every finished step's frames: a run
    with the same spec and folder goes on after the last good step (and does
    not read ``source`` again once it is staged); a run that has only reached
    ``target_step`` is PENDING.  Target, links and children must be those of
    the first run.
    """
    run = ImportRun(catalog, spec, source, target, steps)
    if links:
        run.r.links.update(links)
    if children:
        run.r.children.update(children)
    result = run.run()
    result.run = run  # keeps the handle for release() once the result has been used
    return result


def commit_table(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write a new table snapshot (never read and overwrite one path in one plan)."""
    df.write.mode(mode).parquet(path)
    return path


def run_record(spark: SparkSession, r: ImportResult, run_id: str, file: str | None = None) -> DataFrame:
    """The import-run log row (S15): status, last step, counts and step timings as JSON."""
    import json

    row = (run_id, file, r.status, r.last_step, json.dumps(r.res, default=str), json.dumps(r.steps))
    return spark.createDataFrame([row], "run_id string, file string, status string, last_step string, res string, steps string")


def row_errors(catalog: Catalog, spec: ImportSpec, staged: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Every error of every row, ``(id_import, error_code, key, value)``: cells that do not fit their type, required
    cells without value, keys and codes that nothing answers to, those of n-n lists and child records included."""
    run = ImportRun(catalog, dataclasses.replace(spec, target_step=None), staged, target)
    run.keep = False
    for step in ("data_table", "mapping_view", "raw_view", "import_view", "relations_view"):
        getattr(run, f"step_{step}")()
    frames = run.r.frames
    raw, parts = frames["raw"], []

    def add(df: DataFrame, code: str, key: str, value: Column) -> None:
        parts.append(df.select("id_import", F.lit(code).alias("error_code"), F.lit(key).alias("key"), value.cast("string").alias("value")))

    for c, f in spec.fields.items():
        if c in frames["mapping"].columns and f.type != "string" and not (f.ref or f.code_type or f.nn):
            text = qcol(c).cast("string")
            add(frames["mapping"].filter(~fits_type(text, f.type)), "ERR_IMPORT_INVALID_VALUE_FOR_TYPE", c, text)
        if f.required and c in raw.columns:
            add(raw.filter(qcol(c).isNull()), "ERR_IMPORT_REQUIRED", c, F.lit(None))
        if c in raw.columns and (f.ref or f.code_type) and not f.nn:
            add(frames["resolved"].filter(F.col(f"__raw_{c}").isNotNull() & qcol(c).isNull()), "ERR_IMPORT_UNRESOLVED", c, F.col(f"__raw_{c}"))
        if f.nn and f"nn_{c}" in frames:
            add(frames[f"nn_{c}"].filter(F.col("__link").isNull()), "ERR_IMPORT_UNRESOLVED", c, F.col("__code"))
    for rel, ch in spec.children.items():
        res = frames.get(f"child_{rel}")
        for c, f in ch.fields.items() if res is not None else ():
            if f.required and c in res.columns:
                add(frames[f"child_raw_{rel}"].filter(qcol(c).isNull()), "ERR_IMPORT_REQUIRED", f"{rel}.{c}", F.lit(None))
            if (f.ref or f.code_type) and c in res.columns:
                add(res.filter(F.col(f"__raw_{c}").isNotNull() & qcol(c).isNull()), "ERR_IMPORT_UNRESOLVED", f"{rel}.{c}", F.col(f"__raw_{c}"))
    out = parts[0] if parts else run.spark.createDataFrame([], "id_import long, error_code string, key string, value string")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def load_features(catalog: Catalog, groups: list[dict], specs: dict[str, ImportSpec], tables: dict[str, DataFrame] | None = None) -> dict:
    """Feature load (C17, S14): rows per object, dependencies first, each group upserted by natural key.

    ``groups``: [{"code", "keys", "items" or "file", "defaults", "copy",
    "dependencies"}], see ``feature_frame``.  The dependency order is computed
    on the driver over the group list (a few entries, not data).  Keys that
    the object does not have are dropped; of rows with one natural key the
    last counts.  Foreign keys, in nested records too, are resolved by the
    import spec of each object; each group sees the tables written by the
    groups before it.  A row with an error is left out and reported in the
    result's ``row_errors`` (``id_import, error_code, key, value``); the
    others are loaded.  Returns {code: ImportResult}.
    """
    by_code = {g["code"]: g for g in groups}
    order, seen = [], set()

    def visit(code, stack=()):
        if code in seen:
            return
        if code in stack:
            raise ValueError(f"circular feature dependencies: {' -> '.join(stack + (code,))}")
        for dep in by_code.get(code, {}).get("dependencies", []):
            if dep in by_code:
                visit(dep, stack + (code,))
        seen.add(code)
        order.append(code)

    for g in groups:
        visit(g["code"])
    tables = dict(tables or {})
    out = {}
    for code in order:
        g, spec, target = by_code[code], specs[code], tables.get(code)
        fields, copy = dict(spec.fields), {**spec.copy, **(g.get("copy") or {})}
        for key, others in copy.items():
            for k in others:  # filled by the copy, if by nothing else
                like = fields.get(k) or FieldSpec("integer" if fields[key].ref or fields[key].code_type else fields[key].type)
                fields[k] = dataclasses.replace(like, required=False)
        spec = dataclasses.replace(spec, fields=fields, copy=copy)
        staged = stage.feature_frame(catalog.spark, g, list(fields), {r: list(c.fields) for r, c in spec.children.items()})
        if staged.fault is not None:
            raise staged.fault
        kept = staged.parsed.persist(StorageLevel.MEMORY_AND_DISK)
        rows = good_rows(kept)
        last = Window.partitionBy(*[qcol(u) for u in spec.unique]) if all(u in rows.columns for u in spec.unique) else None
        if last is not None and not any(spec.fields[u].default_uuid for u in spec.unique if u in spec.fields):
            keyless = F.coalesce(*[F.when(qcol(u).isNull(), F.lit(True)) for u in spec.unique], F.lit(False))
            rows = rows.withColumn("__last", F.max("id_import").over(last)).filter(keyless | (F.col("id_import") == F.col("__last"))).drop("__last")
        bad = row_errors(catalog, spec, rows, target).unionByName(bad_rows(kept).select(
            F.col("lines")[0].alias("id_import"), "error_code", "key", F.col("msg").alias("value"))).persist(StorageLevel.MEMORY_AND_DISK)
        r = run_import(catalog, spec, rows.join(bad.select("id_import").distinct(), "id_import", "left_anti"), target=target)
        r.row_errors = bad
        r.run._persisted += [kept, bad]
        out[code] = r
        if r.status == "DONE" and r.table is not None:
            tables[code] = r.table
            catalog.set_frame(code, r.table)
    return out
