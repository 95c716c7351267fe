"""Relation joins along dotted paths.

To-one paths become left joins that never multiply rows.  To-many data is
always aggregated per parent key *before* it meets the parent, so two to-many
relations never multiply each other and a hot parent is combined map-side.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.catalog import SEP, Catalog, Relation, col_name, qcol, with_computed

KEY = "__key"


def prefix_name(prefix: tuple[str, ...]) -> str:
    return SEP.join(prefix)


def relation_chain(catalog: Catalog, code: str, prefix: tuple[str, ...]) -> list[Relation]:
    out, cur = [], code
    for name in prefix:
        rel = catalog.schema(cur).relation(name)
        if rel is None:
            raise KeyError(f"{cur} has no relation {name!r}")
        out.append(rel)
        cur = rel.target
    return out


def attach_to_one(
    catalog: Catalog, code: str, df: DataFrame, requests: dict[tuple[str, ...], set[str]]
) -> DataFrame:
    """Left-join every to-one prefix in ``requests``, adding ``prefix__col`` columns.

    ``requests`` maps a tuple of relation names to the target columns needed.
    Each prefix is joined once (the reference's path cache); parents of a
    prefix are joined first and carry the key of the next hop.
    """
    needed: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for prefix, cols in requests.items():
        if not prefix:
            continue
        needed[prefix] |= set(cols)
        chain = relation_chain(catalog, code, prefix)
        for i in range(1, len(prefix)):
            needed[prefix[:i]].add(chain[i].local_key)
    base_cols = {relation_chain(catalog, code, p)[0].local_key for p in needed}
    df = with_computed(catalog, code, df, sorted(base_cols))
    for prefix in sorted(needed, key=lambda p: (len(p), p)):
        chain = relation_chain(catalog, code, prefix)
        rel = chain[-1]
        if rel.to_many:
            raise ValueError(f"path {'.'.join(prefix)} is to-many; use a child frame")
        name = prefix_name(prefix)
        cols = sorted(needed[prefix])
        missing = [c for c in cols if col_name(name, c) not in df.columns]
        if not missing:
            continue
        if any(col_name(name, c) in df.columns for c in cols):
            # prefix already joined with other columns: join again for the missing ones only
            cols = missing
        left_key = col_name(prefix_name(prefix[:-1]), rel.local_key)
        k = f"__k_{name}"
        dim = catalog.dim(rel.target, [rel.foreign_key] + cols)
        dim = dim.select(
            F.col(rel.foreign_key).alias(k), *[F.col(c).alias(col_name(name, c)) for c in cols]
        )
        df = df.join(dim, qcol(left_key) == F.col(k), "left").drop(k)
    return df


def child_frame(catalog: Catalog, rel: Relation, columns: list[str] | None = None, dedupe: bool = True) -> DataFrame:
    """Rows of a to-many relation keyed by the parent key in column ``__key``.

    ``columns`` limits the target columns carried (None = all).  n-n bridges
    are de-duplicated (a correlation table holds each pair once) unless the
    consumer is insensitive to repeats (sets, semi joins, min/max), which
    saves a shuffle of the bridge.
    """
    target = catalog.frame(rel.target)
    if columns is not None:
        target = with_computed(catalog, rel.target, target, columns)
    if rel.kind == "1-n":
        cols = list(dict.fromkeys(columns if columns is not None else target.columns))
        return target.select(F.col(rel.foreign_key).alias(KEY), *cols)
    if rel.kind == "n-n":
        bridge = catalog.frame(rel.bridge).select(
            F.col(rel.bridge_local).alias(KEY), F.col(rel.bridge_foreign).alias("__bf")
        )
        if dedupe:
            bridge = bridge.distinct()
        cols = list(dict.fromkeys([rel.foreign_key] + (columns if columns is not None else target.columns)))
        t = target.select(*cols)
        return bridge.join(t, F.col("__bf") == F.col(rel.foreign_key), "inner").drop("__bf")
    raise ValueError(f"relation {rel.name} is not to-many")


def where_any(catalog: Catalog, code: str, df: DataFrame, rel_name: str, negate: bool = False) -> DataFrame:
    """Objects having at least one row in a to-many relation (J11, F10); ``negate`` gives J12."""
    rel = catalog.schema(code).relation(rel_name)
    keys = child_frame(catalog, rel, [], dedupe=False).select(KEY)
    return df.join(keys, qcol(rel.local_key) == F.col(KEY), "left_anti" if negate else "left_semi")


def nested(
    catalog: Catalog,
    code: str,
    df: DataFrame,
    rel_name: str,
    fields: list[str] | None = None,
    out: str | None = None,
    below: str = "",
) -> DataFrame:
    """To-many nested field (P3): a sorted list of child records per object.

    Fields may name to-many relations of the children; these become lists in
    the child records, at any depth.  ``below`` is the prefix of the joined
    to-one path whose object (``code``) owns the relation.  Children are restricted to the parents present in ``df`` first (a page is
    small; the key set is semi-joined, never collected), then aggregated per
    parent, then left-joined.  Sorting the list makes the value deterministic.
    """
    sd = catalog.schema(code)
    rel = sd.relation(rel_name)
    tsd = catalog.schema(rel.target)
    fields = fields or tsd.defaults()
    left = qcol(col_name(below, rel.local_key))
    own: list[str] = []
    names: list[str] = []
    reqs: dict[tuple[str, ...], set[str]] = defaultdict(set)
    deeper: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for f in fields:
        hops, last = catalog.split_path(rel.target, f)
        i = next((k for k, h in enumerate(hops) if h.to_many), None)
        if i is not None:
            path = tuple(h.name for h in hops[: i + 1])
            if path[:-1]:
                reqs[path[:-1]].add(hops[i].local_key)
                own.append(hops[0].local_key)
            else:
                own.append(hops[i].local_key)
            sub = ".".join([h.name for h in hops[i + 1 :]] + ([last] if last else []))
            deeper[path].append(sub) if sub else deeper[path]
            names.append(SEP.join(path))
            continue
        if hops:
            reqs[tuple(h.name for h in hops)].add(last)
            own.append(hops[0].local_key)
        else:
            own.append(f.split(".")[0])
        names.append(f.replace(".", SEP))
    child = child_frame(catalog, rel, list(dict.fromkeys(own)))
    keys = df.select(left.alias(KEY)).distinct()
    child = child.join(keys, KEY, "left_semi")
    if reqs:
        child = attach_to_one(catalog, rel.target, child, reqs)
    for path, subs in deeper.items():
        owner = relation_chain(catalog, rel.target, path[:-1])[-1].target if path[:-1] else rel.target
        # the parent key of this level steps aside while the level below is keyed by its own
        child = nested(catalog, owner, child.withColumnRenamed(KEY, "__outer"), path[-1], subs or None, SEP.join(path),
                       SEP.join(path[:-1])).withColumnRenamed("__outer", KEY)
    rec = F.struct(*[qcol(n).alias(n) for n in dict.fromkeys(names)])
    agg = child.groupBy(KEY).agg(F.sort_array(F.collect_list(rec)).alias(out or rel_name))
    return df.join(agg, left == F.col(KEY), "left").drop(KEY)


def related_labels(
    catalog: Catalog,
    code: str,
    df: DataFrame,
    rel_name: str,
    label: str,
    out: str,
    sep: str = ", ",
    where: Column | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Related-label list (P7): labels over a to-many relation joined by ``sep``, ordered."""
    rel = catalog.schema(code).relation(rel_name)
    hops, last = catalog.split_path(rel.target, label)
    child = child_frame(catalog, rel, None if hops else [last], dedupe=not distinct)
    lab = last
    if hops:
        prefix = tuple(h.name for h in hops)
        child = attach_to_one(catalog, rel.target, child, {prefix: {last}})
        lab = col_name(prefix_name(prefix), last)
    if where is not None:
        child = child.filter(where)
    from relata.operators.aggregates import agg_text

    agg = agg_text(child.select(KEY, qcol(lab).alias("__lab")), [KEY], "__lab", out, sep=sep, distinct=distinct)
    return df.join(agg, qcol(rel.local_key) == F.col(KEY), "left").drop(KEY)


def concat_template(catalog: Catalog, code: str, df: DataFrame, template: str, out: str) -> DataFrame:
    """Concat template (P6): ``'<a> <rel.b>'``.

    Own-table parts are NULL-as-empty; when a dotted part's relation is
    missing, the whole value is NULL (the reference evaluates dotted parts in
    a correlated select).
    """
    import re

    parts = re.split(r"(<[^>]+>)", template)
    reqs: dict[tuple[str, ...], set[str]] = defaultdict(set)
    pieces: list[Column] = []
    present: list[Column] = []
    for p in parts:
        if not p:
            continue
        if p.startswith("<") and p.endswith(">"):
            path = p[1:-1]
            hops, last = catalog.split_path(code, path)
            if hops:
                prefix = tuple(h.name for h in hops)
                reqs[prefix].add(last)
                reqs[prefix].add(hops[-1].foreign_key)
                name = col_name(prefix_name(prefix), last)
                present.append(qcol(col_name(prefix_name(prefix), hops[-1].foreign_key)).isNotNull())
            else:
                name = last
                df = with_computed(catalog, code, df, [last])
            pieces.append(qcol(name).cast("string"))
        else:
            pieces.append(F.lit(p))
    if reqs:
        df = attach_to_one(catalog, code, df, reqs)
    val = F.concat_ws("", *pieces)
    if present:
        ok = present[0]
        for c in present[1:]:
            ok = ok & c
        val = F.when(ok, val)
    return df.withColumn(out, val)


def join_list(df: DataFrame, col: str, sep: str, dim: DataFrame, dim_key: str, how: str = "inner") -> DataFrame:
    """Delimited-list join (J13): explode ``a/b/c`` into one row per member, then equi-join ``dim``."""
    import re

    ex = df.select("*", F.explode(F.transform(F.split(qcol(col), re.escape(sep)), lambda x: F.trim(x))).alias("__member"))
    return ex.join(dim, F.col("__member") == dim[dim_key], how).drop("__member")


def resolve_rows(rows: DataFrame, dims: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows holding codes resolved against several code tables by name.

    ``dims[col] = (table, code column, id column)``; inner joins, so rows
    with an unknown code are dropped.  Code tables are fixed-size lists.
    """
    out = rows
    for col, (dim, code, idc) in dims.items():
        d = dim.select(F.col(code).alias(f"__c_{col}"), F.col(idc).alias(f"__id_{col}"))
        out = out.join(d, qcol(col) == F.col(f"__c_{col}"), "inner").drop(f"__c_{col}", col).withColumnRenamed(f"__id_{col}", col)
    return out


def get_rows(df: DataFrame, values, fields: list[str] | str) -> DataFrame:
    """Row lookup by key values (F15): one value per field, lists of equal length.

    Bulk lookups pass a DataFrame of keys instead (semi join).
    """
    if isinstance(values, DataFrame):
        return df.join(values.select(*([fields] if isinstance(fields, str) else fields)), fields, "left_semi")
    fields = [fields] if isinstance(fields, str) else list(fields)
    values = values if isinstance(values, (list, tuple)) else [values]
    if len(values) != len(fields):
        raise ValueError(f"{len(values)} values for {len(fields)} fields")
    cond = None
    for f, v in zip(fields, values):
        c = qcol(f).isNull() if v is None else (qcol(f) == F.lit(v))
        cond = c if cond is None else cond & c
    return df.filter(cond)


def filter_nested(df: DataFrame, array_col: str, path: str, value) -> DataFrame:
    """Keep only the array elements whose ``path`` equals ``value``."""
    def get(x):
        for p in path.split("."):
            x = x[p]
        return x

    return df.withColumn(array_col, F.filter(qcol(array_col), lambda x: get(x) == F.lit(value)))


def expand_codes(df: DataFrame, col: str, mapping: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Cascading codes (F19): each code of ``col`` that is a parent also yields its children.

    ``mapping`` (parent, child) is a code hierarchy; the result keeps the
    original rows and adds one row per child code.
    """
    m = mapping.select(F.col(parent).alias("__p"), F.col(child).alias("__c"))
    kids = df.join(m, qcol(col) == F.col("__p"), "inner").withColumn(col, F.col("__c")).drop("__p", "__c")
    return df.unionByName(kids).distinct()
