"""Object definitions bound to DataFrames, and the dotted-path resolver.

A ``SchemaDef`` says, once per object, which table holds it, its primary
key, its natural (business) key, its label and its relations.  Queries and
imports then address columns by dotted paths such as
``nation.region.r_name``; the resolver turns a path into a chain of joins.

Relation kinds:

* ``n-1`` / ``1-1``: a foreign key on this table (``local_key``) pointing at
  ``foreign_key`` (usually the PK) of the target.  Joining never multiplies
  rows.
* ``1-n``: the foreign key sits on the target (``foreign_key``) and points at
  ``local_key`` of this table.
* ``n-n``: a bridge table links ``local_key`` (via ``bridge_local``) to the
  target's ``foreign_key`` (via ``bridge_foreign``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "__"  # separator used in column names produced for dotted paths

TO_ONE = ("n-1", "1-1")
TO_MANY = ("1-n", "n-n")


@dataclass
class Relation:
    name: str
    kind: str
    target: str
    local_key: str
    foreign_key: str
    bridge: str | None = None
    bridge_local: str | None = None
    bridge_foreign: str | None = None

    @property
    def to_many(self) -> bool:
        return self.kind in TO_MANY


@dataclass
class SchemaDef:
    code: str
    table: str
    pk: str
    unique: list[str] = field(default_factory=list)
    label: str | None = None
    title: str | None = None
    relations: dict[str, Relation] = field(default_factory=dict)
    default_fields: list[str] | None = None
    # computed columns: name -> callable(frame) -> Column
    computed: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    # columns holding code-list codes: column -> code type
    code_columns: dict[str, str] = field(default_factory=dict)
    geometry: str | None = None
    # True when the table is a fixed-size code list (safe to broadcast)
    bounded: bool = False
    # ownership rule: callable(catalog, frame, user) -> frame with 'scope'
    scope_rule: Callable | None = None
    authorized_fields: list[str] | None = None
    titles: dict[str, str] = field(default_factory=dict)
    load_only: list[str] = field(default_factory=list)  # written, never emitted (P13)
    dump_only: list[str] = field(default_factory=list)  # emitted, never written (P13)

    def relation(self, name: str) -> Relation | None:
        return self.relations.get(name)

    def defaults(self) -> list[str]:
        if self.default_fields:
            return list(self.default_fields)
        out = [self.pk]
        for c in (self.label, self.title):
            if c and c not in out:
                out.append(c)
        return out


class UnknownField(KeyError):
    pass


class Catalog:
    """Registry of object definitions plus a loader giving each table's DataFrame."""

    def __init__(self, spark: SparkSession, loader: Callable[[str], DataFrame]):
        self.spark = spark
        self._loader = loader
        self._schemas: dict[str, SchemaDef] = {}
        self._frames: dict[str, DataFrame] = {}

    def add(self, sd: SchemaDef) -> SchemaDef:
        self._schemas[sd.code] = sd
        return sd

    def schema(self, code: str) -> SchemaDef:
        try:
            return self._schemas[code]
        except KeyError as e:
            raise UnknownField(f"unknown object {code!r}") from e

    def codes(self) -> list[str]:
        return list(self._schemas)

    def frame(self, code: str) -> DataFrame:
        """The base DataFrame of an object, with its computed columns available on demand."""
        if code not in self._frames:
            sd = self.schema(code)
            self._frames[code] = self._loader(sd.table)
        return self._frames[code]

    def set_frame(self, code: str, df: DataFrame) -> None:
        self._frames[code] = df

    def dim(self, code: str, columns: list[str]) -> DataFrame:
        """Columns of an object's table; how it is joined is left to the planner and its size check."""
        df = with_computed(self, code, self.frame(code), columns)
        return df.select(*dict.fromkeys(columns))

    # ------------------------------------------------------------------ paths
    def split_path(self, code: str, path: str) -> tuple[list[Relation], str | None]:
        """Split ``rel1.rel2.col`` into relation hops and the final column.

        The final part may be ``None`` when the path names a relation only.
        JSON sub-fields (``props.k``) stop the walk: the rest is returned as a
        JSON path on the column.
        """
        parts = [p for p in path.strip().split(".") if p != ""]
        hops: list[Relation] = []
        cur = self.schema(code)
        for i, p in enumerate(parts):
            rel = cur.relation(p)
            if rel is not None:
                hops.append(rel)
                cur = self.schema(rel.target)
                continue
            rest = ".".join(parts[i:])
            return hops, rest
        return hops, None

    def column_type(self, code: str, column: str):
        df = self.frame(code)
        base = column.split(".")[0]
        sd = self.schema(code)
        if base in sd.computed:
            return with_computed(self, code, df, [base]).schema[base].dataType
        if base not in df.columns:
            raise UnknownField(f"{code}.{column}")
        return df.schema[base].dataType

    def has_field(self, code: str, path: str) -> bool:
        try:
            hops, last = self.split_path(code, path)
            target = hops[-1].target if hops else code
            if last is None:
                return bool(hops)
            self.column_type(target, last)
            return True
        except UnknownField:
            return False


def with_computed(catalog: Catalog, code: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the computed columns among ``columns`` that ``df`` lacks."""
    sd = catalog.schema(code)
    for c in columns:
        base = c.split(".")[0]
        if base in sd.computed and base not in df.columns:
            df = df.withColumn(base, sd.computed[base](df))
    return df


def col_name(prefix: str, column: str) -> str:
    """Column name for ``prefix.column`` in a flattened frame."""
    return f"{prefix}{SEP}{column}" if prefix else column


def qcol(name: str) -> Column:
    """Column reference safe for names holding dots."""
    return F.col(f"`{name}`")
