"""Delimited-file staging (S1-S5) and inline feature frames.

Every staged column is text.  Each record gets a stable id ``id_import``
(1..n in file order) from per-split offsets, so a recompute after a lost
executor gives every record the same id.

A file is read as lines, split over tasks also where quoted cells hold line
breaks: a line begins a record if the quotes before it, in its split and in
the splits before, come in pairs.  One small pass counts lines and quotes per
split; one pass parses.  Records that do not fit become error rows beside the
others.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.operators.ordering import with_row_number
from relata.session import checkpoint_dir
from relata.sources import fs


class StageError(Exception):
    def __init__(self, code: str, msg: str):
        super().__init__(f"{code}: {msg}")
        self.code = code
        self.msg = msg


def normalise_header(name: str) -> str:
    """Unquoted names fold to lower case and lose surrounding blanks; dotted names keep their case (S3)."""
    n = name.strip()
    return n if "." in n else n.lower()


def detect_delimiter(header: str) -> str:
    """``;`` if present in the header, else ``,``, else an error."""
    if ";" in header:
        return ";"
    if "," in header:
        return ","
    raise StageError("ERR_IMPORT_CSV_FILE_DELIMITER_NOT_FOUND", f"no ';' or ',' in header {header!r}")


#: Error rows of staging and of every import step.
ERROR_SCHEMA = T.StructType([
    T.StructField("error_code", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("nb_lines", T.LongType()),
    T.StructField("lines", T.ArrayType(T.LongType())),
    T.StructField("valid_values", T.StringType()),
    T.StructField("msg", T.StringType()),
])
BAD = "__bad"  # what is wrong with a parsed record, null for a good one
RECORD = "__record"  # a bad record's text


class Staged:
    """A staged file: ``parsed`` holds every record, good or bad; ``rows`` and ``errors`` are its two sides.

    A file that cannot be read at all has one error row and no ``parsed``.
    """

    def __init__(self, spark: SparkSession, parsed: DataFrame | None, fault: StageError | None = None):
        self.sparkSession = spark
        self.parsed, self.fault = parsed, fault

    @property
    def rows(self) -> DataFrame:
        return good_rows(self.parsed)

    @property
    def errors(self) -> DataFrame:
        if self.fault is not None:
            return self.sparkSession.createDataFrame([(self.fault.code, None, None, 0, [], None, self.fault.msg)], ERROR_SCHEMA)
        return bad_rows(self.parsed)


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(BAD).isNull()).drop(BAD, RECORD)


def bad_rows(parsed: DataFrame) -> DataFrame:
    """One error row for each record that does not fit, with its line id and text."""
    return parsed.filter(F.col(BAD).isNotNull()).select(
        F.col(BAD).alias("error_code"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"),
        F.lit(1).cast("long").alias("nb_lines"), F.array("id_import").alias("lines"), F.lit(None).cast("string").alias("valid_values"),
        F.col(RECORD).alias("msg"))


def stage_file(spark: SparkSession, path: str, delimiter: str | None = None) -> Staged:
    """Read a delimited file (or a folder of such files) as text columns plus ``id_import``, errors as rows.

    Only the header line reaches the driver.  A file of an unknown type, a
    missing or empty one, or one without a delimiter gives one error row; a
    record with more or fewer cells than the header
    (``ERR_IMPORT_DATA_LINE_CELLS``) or with an open quote
    (``ERR_IMPORT_DATA_QUOTE``) gives one of its own, and the others are
    staged.  Where a file's quotes do not pair, no record goes over a line.  Blank lines are no records; each file's first line is its header.
    """
    try:
        if not path.lower().endswith((".csv", ".tsv", ".txt")):
            raise StageError("ERR_IMPORT_DATA_FILE_TYPE_NOT_FOUND", f"unsupported file type: {path}")
        if not fs.exists(spark, path):
            raise StageError("ERR_IMPORT_DATA_FILE_NOT_FOUND", f"file not found: {path}")
        first = spark.read.text(path).filter("value <> ''").limit(1).collect()
        if not first:
            raise StageError("ERR_IMPORT_DATA_EMPTY", f"empty file: {path}")
        header = first[0][0].lstrip("\ufeff")
        sep = delimiter or detect_delimiter(header)
    except StageError as fault:
        return Staged(spark, None, fault)
    names = [normalise_header(n) for n in _split_header(header, sep)]
    records = _records(spark, path)
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    cells = F.from_csv("record", T.StructType([*fields, T.StructField("bad", T.StringType())]).simpleString(), {
        "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "columnPruning": "false"})
    parsed = records.select("id_import", "record", cells.alias("c"))
    bad = F.when(_quotes("record") % 2 == 1, F.lit("ERR_IMPORT_DATA_QUOTE")).when(
        F.col("c.bad").isNotNull() | F.col("c").isNull(), F.lit("ERR_IMPORT_DATA_LINE_CELLS"))
    return Staged(spark, parsed.select(
        "id_import", *[F.nullif(F.col(f"c.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)], bad.alias(BAD),
        F.when(bad.isNotNull(), F.col("record")).alias(RECORD)))


def stage_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """The rows of ``stage_file``; raises ``StageError`` if there is any error, naming the first lines."""
    staged = stage_file(spark, path, delimiter)
    if staged.fault is not None:
        raise staged.fault
    found = staged.errors.select("error_code", F.col("lines")[0].alias("line")).orderBy("line").limit(5).collect()
    if found:
        lines = ", ".join(str(r.line) for r in found)
        raise StageError(found[0].error_code, f"lines {lines} do not fit the header: {path}")
    return staged.rows


def _quotes(column: str) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit('"'), F.lit("")))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``(id_import, record)``: the records of the files, quoted line breaks included, numbered 1..n in file order.

    File splits and their packing into partitions are deterministic, and
    inside a partition the lines of one split are contiguous and in order.
    """
    where = [F.input_file_name().alias("f"), F.input_file_block_start().alias("b")]
    lines = spark.read.text(path).select("value", *where).withColumn("odd", _quotes("value") % 2)
    filled = lines.filter("value <> ''").withColumn("m", F.monotonically_increasing_id())
    # one row per split, written once: both its offsets and whether any cell is left open come from it
    splits = filled.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m0"), F.sum("odd").alias("odd"))
    checkpoint_dir(spark)
    splits = splits.checkpoint(eager=True)
    in_order, in_file = Window.orderBy("f", "b"), Window.partitionBy("f").orderBy("b")
    before = (Window.unboundedPreceding, -1)
    at_head = F.row_number().over(in_file) == 1  # the split with the file's header
    if splits.filter("odd > 0").isEmpty():  # every line is a record
        heads = splits.withColumn("head", at_head.cast("int"))
        offsets = heads.select("f", "b", "m0", "head", F.coalesce(F.sum(F.col("n") - F.col("head")).over(in_order.rowsBetween(*before)), F.lit(0)).alias("off"))
        numbered = filled.join(offsets, ["f", "b"]).withColumn("i", F.col("m") - F.col("m0") + 1 - F.col("head"))
        # (the header is no record, also for a caller's condition that the planner moves before this filter)
        record = F.when(F.col("i") > 0, F.col("value")).alias("record")
        return numbered.filter("i > 0").select((F.col("off") + F.col("i")).alias("id_import"), record)
    # quotes left open: whether a line begins a record depends on all quotes before it; blank lines inside a cell count
    # (in a file whose quotes do not pair at all, one stray quote would swallow the rest: there each line stands for itself)
    opened = splits.select("f", "b", F.coalesce(F.sum("odd").over(in_file.rowsBetween(*before)), F.lit(0)).alias("open"),
                           (F.sum("odd").over(Window.partitionBy("f")) % 2 == 0).alias("paired"))
    every = lines.withColumn("m", F.monotonically_increasing_id()).join(opened, ["f", "b"])
    line = Window.partitionBy("f", "b").orderBy("m")
    inside = (F.col("open") + F.coalesce(F.sum("odd").over(line.rowsBetween(*before)), F.lit(0))) % 2
    every = every.withColumn("inside", F.when(F.col("paired"), inside).otherwise(0))
    every = every.filter("inside = 1 OR value <> ''").withColumn("starts", 1 - F.col("inside"))
    every = every.withColumn("own", F.sum("starts").over(line))
    per_split = every.groupBy("f", "b").agg(F.sum("starts").alias("n")).withColumn("head", at_head.cast("int"))
    offsets = per_split.select("f", "b", F.coalesce(F.sum("n").over(in_file.rowsBetween(*before)), F.lit(0)).alias("in_file"),
                               F.coalesce(F.sum(F.col("n") - F.col("head")).over(in_order.rowsBetween(*before)), F.lit(0)).alias("off"), "head")
    every = every.join(offsets, ["f", "b"])
    # a record's number in its file (1: the header) and in all files; the lines of one record share both
    every = every.select("f", (F.col("in_file") + F.col("own")).alias("nth"), (F.col("off") - F.col("head") + F.col("own")).alias("i"), "b", "m", "value")
    joined = every.filter("nth > 1").groupBy("f", "nth").agg(F.min("i").alias("i"), F.array_sort(F.collect_list(F.struct("b", "m", "value"))).alias("ls"))
    return joined.select(F.col("i").alias("id_import"), F.array_join("ls.value", "\n").alias("record"))


def line_numbers(scan: DataFrame, name: str = "id_import") -> DataFrame:
    """Consecutive line numbers 1..n in file order for a frame read straight from files.

    File splits and their packing into partitions are deterministic, and
    inside a partition the rows of one split are contiguous and in file
    order.  A first, small pass gives one row per (file, split): its row
    count and the position of its first row; running offsets over those
    rows (one per split) are joined back.  Nothing is materialised, and a
    recomputed partition gets the same numbers.
    """
    keyed = scan.select("*", F.input_file_name().alias("__f"), F.input_file_block_start().alias("__b"),
                        F.monotonically_increasing_id().alias("__m"))
    splits = keyed.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__m0"))
    w = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__f", "__b", "__m0", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    # one row per split: small next to the data, but it grows with the input, so the join
    # strategy is left to the planner / AQE size check rather than forced
    out = keyed.join(offsets, ["__f", "__b"])
    return out.withColumn(name, F.col("__off") + (F.col("__m") - F.col("__m0")) + 1).drop("__f", "__b", "__m", "__m0", "__off")


def _split_header(header: str, sep: str) -> list[str]:
    import csv

    return next(csv.reader([header], delimiter=sep, quotechar='"'))


def blank_to_null(df: DataFrame, keep: tuple[str, ...] = ("id_import",)) -> DataFrame:
    """Empty string -> NULL on every column but ``id_import``."""
    return df.select(*[
        F.col(f"`{c}`") if c in keep else F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns
    ])


def stage_frame(df: DataFrame, line_col: str | None = None) -> DataFrame:
    """Stage an existing frame: every column as text, plus ``id_import``.

    ``line_col`` names a column already holding stable line numbers; without
    it lines are numbered by the checkpointed global row number over all
    columns.
    """
    cols = [c for c in df.columns if c != line_col]
    text = [F.col(f"`{c}`").cast("string").alias(c) for c in cols]
    if line_col:
        return blank_to_null(df.select(F.col(line_col).cast("long").alias("id_import"), *text))
    t = df.select(*text)
    return blank_to_null(with_row_number(t, [F.col(f"`{c}`").asc_nulls_last() for c in cols], "id_import").select("id_import", *cols))


def feature_frame(spark: SparkSession, item: dict, columns: list[str] | None = None, children: dict[str, list[str]] | None = None) -> Staged:
    """Feature rows (S14) as text columns with their line ids; rows that do not fit are error rows.

    ``item`` holds ``items`` (inline rows) or ``file`` (a JSON-lines file, one
    row a line, read as a Spark source).  A row is an object, or a list of
    values in the order of ``keys``.  ``defaults`` fill what is absent or
    null.  Only ``columns`` are kept (all keys of ``keys`` and
    ``defaults``, if not given); of a relation in ``children`` each record of
    the row's list makes a line with dotted columns.  A list of another length
    (``ERR_FEATURE_ROW_LENGTH``) and a row that is no JSON object or list
    (``ERR_FEATURE_ROW_FORM``) are errors of their own row.
    """
    keys, children = [str(k) for k in item.get("keys") or []], children or {}
    if item.get("file"):
        if not fs.exists(spark, item["file"]):
            return Staged(spark, None, StageError("ERR_IMPORT_DATA_FILE_NOT_FOUND", f"file not found: {item['file']}"))
        lines = line_numbers(spark.read.text(item["file"]).filter(F.trim("value") != "")).select("id_import", F.trim("value").alias("value"))
    else:
        rows = [(i, json.dumps(r, default=str)) for i, r in enumerate(item.get("items", []), 1)]
        lines = spark.createDataFrame(rows, "id_import long, value string")
    values, pairs = F.from_json("value", "array<string>"), F.from_json("value", "map<string,string>")
    listed = F.col("value").startswith("[")
    bad = F.when(listed & values.isNotNull() & (F.size(values) != len(keys)), F.lit("ERR_FEATURE_ROW_LENGTH")).when(
        F.when(listed, values.isNull()).otherwise(pairs.isNull() | ~F.col("value").startswith("{")), F.lit("ERR_FEATURE_ROW_FORM"))
    names = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    of_list = F.map_from_arrays(names, F.when(F.size(values) == len(keys), values)) if keys else F.lit(None).cast("map<string,string>")
    parsed = lines.select("id_import", "value", bad.alias(BAD), F.when(listed, of_list).otherwise(pairs).alias("m"))
    defaults = {str(k): str(v) for k, v in (item.get("defaults") or {}).items()}

    def cell(key: str) -> Column:
        c = F.try_element_at("m", F.lit(key))
        if key in defaults:
            c = F.coalesce(c, F.lit(defaults[key]))
        return c

    columns = list(dict.fromkeys([*keys, *defaults])) if columns is None else columns
    out = parsed.select("id_import", "value", BAD, *[F.nullif(cell(c), F.lit("")).alias(c) for c in columns],
                        *[F.from_json(F.try_element_at("m", F.lit(r)), "array<map<string,string>>").alias(f"__of_{r}") for r in children])
    for r, cols in children.items():
        out = out.withColumn("__one", F.explode_outer(f"__of_{r}"))
        out = out.select("*", *[F.nullif(F.try_element_at("__one", F.lit(c)), F.lit("")).alias(f"{r}.{c}") for c in cols]).drop("__one", f"__of_{r}")
    return Staged(spark, out.withColumn(RECORD, F.when(F.col(BAD).isNotNull(), F.col("value"))).drop("value"))
