"""Filter expressions (F1-F16) compiled to one Spark plan.

String form: items split on ``,``; ``*`` and, ``|`` or, ``!`` not, ``[`` ``]``
group; each item is ``field op value``.  Structured form: nested lists of
operators and ``{"field", "type", "value"}`` dicts.  Combination is
left-associative with no precedence, and ``!!`` cancels.

Row-matching rule for relation paths: an object matches when *some* row of
the left-joined relation satisfies the *whole* expression, and each object
is returned once.  Conditions on the same to-many relation share one joined
row.

How that is computed without multiplying rows: for every to-many relation
used, each child row gets a small integer coding the three-valued truth of
the conditions that refer to it; per parent only the *set* of codes is kept
(at most 3^k values, combined map-side, so a hot parent costs nothing
extra).  The expression is then evaluated over those sets with ``exists``.
Conditions that only touch one relation and cannot be true for a parent
without rows become a plain semi join of the filtered child rows.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.catalog import Catalog, Relation, col_name, qcol, with_computed
from relata.functions.text import contains_all_words, like_value, unaccent
from relata.operators.relations import KEY, attach_to_one, child_frame, prefix_name

# The names of the comparison operators, and the symbols between conditions.
REGISTERED = ["=", "<", ">", ">=", "<=", "like", "ilike", "in", "~", "dwithin", "bbox", "any"]
STRUCTURED_ONLY = ["!="]
AND, OR, NOT, OPEN, CLOSE = "*|![]"

_OPERATORS = "|".join(re.escape(op) for op in sorted(REGISTERED, key=len, reverse=True))
# field, operator, value: the shortest field wins, so the first operator in the text counts
_CONDITION = re.compile(rf"(?P<field>.*?\S.*?) (?P<type>{_OPERATORS})(?: (?P<value>.*))?", re.S)
_EXISTS = re.compile(r"has_(?P<field>\S+)")


class FilterSyntaxError(ValueError):
    pass


# ---------------------------------------------------------------- parsing
def parse_item(text: str):
    """One item of the string form: a symbol as it is, or a condition as a record."""
    if text in (AND, OR, NOT, OPEN, CLOSE):
        return text
    if m := _EXISTS.fullmatch(text):
        return {"field": m["field"], "type": "any"}
    m = _CONDITION.fullmatch(text)
    if m is None:
        raise FilterSyntaxError(f"filter item {text!r} is not of the form 'field operator value'")
    value = m["value"] or ""
    return {"field": m["field"], "type": m["type"], "value": value.split(";") if m["type"] == "in" else value}


def parse_filters(spec) -> list:
    """String or list of items -> tokens, groups as nested lists."""
    if not spec:
        return []
    return _group(iter(spec.split(",") if isinstance(spec, str) else spec), inside=False)


def _group(items: Iterator, inside: bool) -> list:
    """Tokens up to the bracket that closes this group, or to the end of the items."""
    tokens = []
    for item in items:
        token = parse_item(item) if isinstance(item, str) else item
        if token == CLOSE:
            if inside:
                return tokens
            raise FilterSyntaxError("a closing bracket has no opening one")
        tokens.append(_group(items, inside=True) if token == OPEN else token)
    if inside:
        raise FilterSyntaxError("an opening bracket has no closing one")
    return tokens


def to_ast(tokens):
    """Tokens -> AST of ('and'|'or', a, b), ('not', a), ('atom', dict); None if there are none.

    expression = operand, { [ "*" | "|" ], operand };  operand = { "!" }, ( condition | group ).
    Expressions associate to the left, without precedence.
    """
    if isinstance(tokens, dict):
        tokens = [tokens]
    elif isinstance(tokens, str):
        tokens = parse_filters(tokens)
    tree, rest = None, deque(tokens)
    while rest:
        joined = "and"
        if tree is not None and rest[0] in (AND, OR):
            joined = "and" if rest.popleft() == AND else "or"
        operand = _operand(rest)
        tree = operand if tree is None else (joined, tree, operand)
    return tree


def _operand(rest: deque):
    negations = 0
    while rest and rest[0] == NOT:
        rest.popleft()
        negations += 1
    token = rest.popleft() if rest else None
    if isinstance(token, dict):
        node = ("atom", {**token, "field": str(token["field"]).strip()})
    elif isinstance(token, (list, tuple)) or (isinstance(token, str) and token not in (AND, OR)):
        node = to_ast(token)
    else:
        node = None
    if node is None:
        raise FilterSyntaxError(f"a condition or a group is expected in place of {token!r}")
    return ("not", node) if negations % 2 else node


def atoms_of(ast) -> list[dict]:
    if ast is None:
        return []
    if ast[0] == "atom":
        return [ast[1]]
    if ast[0] == "not":
        return atoms_of(ast[1])
    return atoms_of(ast[1]) + atoms_of(ast[2])


def conjuncts(ast) -> list:
    if ast is not None and ast[0] == "and":
        return conjuncts(ast[1]) + conjuncts(ast[2])
    return [] if ast is None else [ast]


# ---------------------------------------------------------------- atoms
def typed_literal(v, dtype: T.DataType) -> Column:
    if v is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit(str(v))
    return F.lit(str(v)).try_cast(dtype)


def _same_as_text(values: list, dtype: T.DataType) -> bool:
    """Whether comparing whole numbers gives what comparing their text would (and can be pushed down)."""
    bits = {T.IntegerType: 31, T.LongType: 63}.get(type(dtype))
    return bool(bits and values) and all(
        re.fullmatch(r"0|-?[1-9][0-9]{0,18}", str(v)) and -(1 << bits) <= int(v) < 1 << bits for v in values)


def atom_column(c: Column, dtype: T.DataType, item: dict, geo_ctx=None) -> Column:
    """Column for one comparison on column ``c`` of type ``dtype``."""
    t, v = item["type"], item.get("value")
    if t == "=":
        return c.isNull() if v is None else c == typed_literal(v, dtype)
    if t == "!=":
        return c != F.lit(str(v)).cast(dtype) if _same_as_text([v], dtype) else c.cast("string") != F.lit(str(v))
    if t in ("<", "<=", ">", ">="):
        lit = typed_literal(v, dtype)
        return {"<": c < lit, "<=": c <= lit, ">": c > lit, ">=": c >= lit}[t]
    if t == "in":
        vals = v if isinstance(v, list) else str(v).split(";")
        if _same_as_text(vals, dtype):
            return c.isin([int(x) for x in vals])
        return c.cast("string").isin([str(x) for x in vals])
    if t in ("like", "ilike"):
        target = unaccent(c.cast("string"))
        pat = like_value(str(v))
        return target.like(pat) if t == "like" else target.ilike(pat)
    if t == "~":
        return contains_all_words(c, str(v))
    if t in ("dwithin", "bbox"):
        from relata.operators import geo

        if "_ctx" in item:
            return geo.filter_atom(c, t, v, {"dwithin": item["_ctx"]})
        return geo.filter_atom(c, t, v, geo_ctx)
    raise FilterSyntaxError(f"unknown filter type {t!r}")


@dataclass
class _Atom:
    item: dict
    group: tuple[str, ...] | None  # first to-many prefix, None for base
    prefix: tuple[str, ...]  # to-one prefix on the base (base atoms) or inside the child
    column: str | None
    flag: str | None = None  # helper column for 'any'
    json_path: str | None = None


def _split(catalog: Catalog, code: str, path: str):
    """-> (to_one_prefix, to_many_rel or None, rest_prefix, column)"""
    hops, last = catalog.split_path(code, path)
    for i, h in enumerate(hops):
        if h.to_many:
            return tuple(x.name for x in hops[:i]), h, tuple(x.name for x in hops[i + 1 :]), last, hops[i + 1 :]
    return tuple(x.name for x in hops), None, (), last, []


def _json_split(catalog: Catalog, code: str, column: str):
    """``props.k`` -> ('props', '$.k') when the column is a string holding JSON."""
    if column and "." in column:
        base, rest = column.split(".", 1)
        return base, "$." + rest
    return column, None


def _col_expr(df_col: Column, json_path: str | None) -> Column:
    return F.get_json_object(df_col, json_path) if json_path else df_col


def apply_filters(catalog: Catalog, code: str, df: DataFrame, spec, geo_ctx=None) -> DataFrame:
    """Filter ``df`` (rows of object ``code``) by a filter spec (F1)."""
    ast = spec if isinstance(spec, tuple) else to_ast(spec)
    if ast is None:
        return df
    base_cols = list(df.columns)
    df, pred, semis = compile_filter(catalog, code, df, ast, geo_ctx)
    for kind, keys, left in semis:
        df = df.join(keys, qcol(left) == F.col(KEY), kind)
    if pred is not None:
        df = df.filter(pred)
    return df.select(*[qcol(c) for c in base_cols])


def compile_filter(catalog: Catalog, code: str, df: DataFrame, ast, geo_ctx=None):
    """-> (frame with helper columns, predicate Column or None, semi/anti joins)."""
    atoms = atoms_of(ast)
    df = _attach_dwithin_objects(catalog, df, atoms)
    info: dict[int, _Atom] = {}
    to_one_reqs: dict[tuple[str, ...], set[str]] = defaultdict(set)
    groups: dict[tuple[str, ...], Relation] = {}
    for a in atoms:
        prefix, rel, rest, last, rest_hops = _split(catalog, code, a["field"])
        if a["type"] == "any":
            if rel is None or last is not None or rest:
                raise FilterSyntaxError(f"'any' needs a to-many relation path, got {a['field']!r}")
            info[id(a)] = _Atom(a, None, prefix, None, flag=f"__any_{prefix_name(prefix + (rel.name,))}")
            groups.setdefault(("any",) + prefix + (rel.name,), rel)
            if prefix:
                to_one_reqs[prefix].add(rel.local_key)
            continue
        if last is None:
            raise FilterSyntaxError(f"filter field {a['field']!r} names a relation, not a column")
        if rel is None:
            target = catalog.schema(prefix and _target(catalog, code, prefix) or code).code
            column, jp = _json_split(catalog, target, last)
            if prefix:
                to_one_reqs[prefix].add(column)
            info[id(a)] = _Atom(a, None, prefix, column, json_path=jp)
        else:
            g = prefix + (rel.name,)
            groups.setdefault(g, rel)
            if prefix:
                to_one_reqs[prefix].add(rel.local_key)
            column, jp = _json_split(catalog, rel.target, last)
            info[id(a)] = _Atom(a, g, rest, column, json_path=jp)
    if to_one_reqs:
        df = attach_to_one(catalog, code, df, to_one_reqs)
    own = [at.column for at in info.values() if at.group is None and not at.prefix and at.column]
    df = with_computed(catalog, code, df, own)

    def base_atom_col(at: _Atom, frame: DataFrame, tcode: str) -> Column:
        name = col_name(prefix_name(at.prefix), at.column)
        dtype = T.StringType() if at.json_path else catalog.column_type(tcode, at.column)
        return atom_column(_col_expr(qcol(name), at.json_path), dtype, at.item, geo_ctx)

    # ---- 'any' flags: distinct parent keys of the relation (map-side combined)
    semis = []
    conj = conjuncts(ast)
    remaining = []
    for c in conj:
        # top-level (possibly negated) 'any' -> semi / anti join
        node, neg = c, False
        if node[0] == "not":
            node, neg = node[1], True
        if node[0] == "atom" and node[1]["type"] == "any":
            at = info[id(node[1])]
            rel = groups[("any",) + at.prefix + (_last_rel(catalog, code, node[1]["field"]).name,)]
            keys = child_frame(catalog, rel, [], dedupe=False).select(KEY).distinct()
            semis.append(("left_anti" if neg else "left_semi", keys, col_name(prefix_name(at.prefix), rel.local_key)))
            continue
        remaining.append(c)

    for a in atoms:
        at = info[id(a)]
        if at.flag and at.flag not in df.columns and any(a in atoms_of(c) for c in remaining):
            rel = _last_rel(catalog, code, a["field"])
            keys = child_frame(catalog, rel, [], dedupe=False).select(F.col(KEY)).distinct().withColumn(at.flag, F.lit(True))
            left = col_name(prefix_name(at.prefix), rel.local_key)
            df = df.join(keys, qcol(left) == F.col(KEY), "left").drop(KEY)
            df = df.withColumn(at.flag, F.coalesce(F.col(at.flag), F.lit(False)))

    # ---- cluster conjuncts by the to-many groups they touch
    def groups_of(node) -> set:
        return {info[id(a)].group for a in atoms_of(node) if info[id(a)].group is not None}

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for c in remaining:
        gs = list(groups_of(c))
        for g in gs[1:]:
            parent[find(g)] = find(gs[0])
    clusters: dict = defaultdict(list)
    plain = []
    for c in remaining:
        gs = groups_of(c)
        if not gs:
            plain.append(c)
        else:
            clusters[find(next(iter(gs)))].append(c)

    preds: list[Column] = []

    def build(node, env) -> Column:
        """Truth on a row of ``df``; ``env`` holds a mask for each relation."""
        def own(a):
            at = info[id(a)]
            return F.col(at.flag) if at.flag else base_atom_col(at, df, _target(catalog, code, at.prefix) if at.prefix else code)

        return _evaluated(node, own, lambda g, i: _digit(env[g], i))

    for c in plain:
        preds.append(build(c, {}))

    for cl in clusters.values():
        gset = sorted({g for c in cl for g in groups_of(c)})
        node = cl[0]
        for c in cl[1:]:
            node = ("and", node, c)
        # the largest parts of the expression that only one relation's rows decide; equal parts are one
        parts: dict = {g: [] for g in gset}

        def fold(node):
            mine = atoms_of(node)
            gs = {info[id(a)].group for a in mine}
            if gs and None not in gs and len(gs) == 1:
                g = next(iter(gs))
                if node not in parts[g]:
                    parts[g].append(node)
                return ("part", g, parts[g].index(node))
            return node if node[0] == "atom" else (node[0], *(fold(n) for n in node[1:]))

        folded = fold(node)
        child_frames, verdicts = {}, {}
        for g in gset:
            child_frames[g], verdicts[g] = _child_rows(
                catalog, groups[g], [info[id(a)] for part in parts[g] for a in atoms_of(part)], geo_ctx)

        def row_truth(g, part, none=False):
            """Truth of a part on a row of the relation; ``none``: for an object without rows."""
            def of(a):
                at, rel = info[id(a)], groups[g]
                name = next((v for v, w in verdicts[g] if w.item == a), None)
                if name and not none:
                    return F.col(name)
                tcode = _target(catalog, rel.target, at.prefix) if at.prefix else rel.target
                dtype = T.StringType() if at.json_path else catalog.column_type(tcode, at.column)
                value = qcol(col_name(prefix_name(at.prefix), at.column))
                return atom_column(F.lit(None).cast(dtype) if none else _col_expr(value, at.json_path), dtype, a, geo_ctx)

            return _evaluated(part, of)

        if folded[0] == "part" and _null_row_truth(node) is not True:
            # exists-a-child-row-satisfying: semi join of filtered children
            g = gset[0]
            keys = child_frames[g].filter(row_truth(g, node)).select(KEY)
            semis.append(("left_semi", keys, col_name(prefix_name(g[:-1]), groups[g].local_key)))
            continue

        masks = {}
        for g in gset:
            mcol = f"__m_{prefix_name(g)}"
            agg = child_frames[g].groupBy(KEY).agg(F.collect_set(_mask([row_truth(g, p) for p in parts[g]])).alias(mcol))
            left = col_name(prefix_name(g[:-1]), groups[g].local_key)
            df = df.join(agg, qcol(left) == F.col(KEY), "left").drop(KEY)
            df = df.withColumn(mcol, F.coalesce(F.col(mcol), F.array(_mask([row_truth(g, p, True) for p in parts[g]]))))
            masks[g] = mcol

        def over_rows(gs, env, folded=folded, masks=masks):
            """Whether one row of each relation can be chosen so that the expression is true."""
            if not gs:
                return build(folded, env)
            return F.exists(F.col(masks[gs[0]]), lambda x: over_rows(gs[1:], {**env, gs[0]: x}))

        preds.append(over_rows(gset, {}))

    pred = None
    for p in preds:
        pred = p if pred is None else (pred & p)
    return df, pred, semis


def _evaluated(node, atom, part=None) -> Column:
    """An expression's truth from that of its conditions (and of its folded parts)."""
    kind = node[0]
    if kind == "atom":
        return atom(node[1])
    if kind == "part":
        return part(node[1], node[2])
    sides = [_evaluated(n, atom, part) for n in node[1:]]
    return ~sides[0] if kind == "not" else sides[0] & sides[1] if kind == "and" else sides[0] | sides[1]


#: Truth values (two bits each) that one long of a mask holds.
MASK_DIGITS = 31


def _mask(truths: list[Column]) -> Column:
    """Three-valued truths of a row as two bits each (1: true, 2: false, 0: unknown), in as many longs as it takes."""
    words = []
    for at in range(0, len(truths), MASK_DIGITS):
        word = F.lit(0).cast("long")
        for i, t in enumerate(truths[at:at + MASK_DIGITS]):
            word = word + F.when(t, F.lit(1 << 2 * i).cast("long")).when(~t, F.lit(2 << 2 * i).cast("long")).otherwise(F.lit(0).cast("long"))
        words.append(word)
    return F.array(*words)


def _digit(mask: Column, i: int) -> Column:
    bits = F.shiftright(mask[i // MASK_DIGITS], 2 * (i % MASK_DIGITS)).bitwiseAND(F.lit(3).cast("long"))
    return F.when(bits == 1, F.lit(True)).when(bits == 2, F.lit(False))


def _child_rows(catalog: Catalog, rel: Relation, atoms: list[_Atom], geo_ctx) -> tuple[DataFrame, list[tuple[str, _Atom]]]:
    """Rows of a relation with what the conditions need, and the columns that hold verdicts of conditions on sibling branches."""
    sub: dict = defaultdict(set)
    cols: set = set()
    for at in atoms:
        if at.prefix:
            sub[at.prefix].add(at.column)
        else:
            cols.add(at.column)
    wanted: list[tuple[str, _Atom, tuple]] = []
    below = [at for at in atoms if _has_many(catalog, rel.target, at.prefix)]
    ends = {_to_last_many(catalog, rel.target, at.prefix) for at in below}
    longest = max(ends, key=len, default=())
    if any(longest[:len(e)] != e for e in ends):  # siblings: joined rows would multiply
        for at in below:
            if all(at.item != w.item for _, w, _ in wanted):
                wanted.append((f"__v{len(wanted)}", at, at.prefix))
            sub.pop(at.prefix, None)
    heads = {catalog.schema(rel.target).relation(path[0]).local_key for path in [*sub, *(w[2] for w in wanted)]}
    # masks and semi joins ignore repeated rows: no bridge de-duplication needed
    ch = child_frame(catalog, rel, sorted(cols | heads), dedupe=False)
    if wanted:
        ch = attach_verdicts(catalog, rel.target, ch, wanted, geo_ctx)
    if sub:
        ch = attach_chain(catalog, rel.target, ch, sub)
    return ch, [(name, at) for name, at, _ in wanted]


def _to_last_many(catalog: Catalog, code: str, prefix) -> tuple:
    """The path up to its last to-many hop."""
    many = [i for i, r in enumerate(_chain(catalog, code, prefix)) if r.to_many]
    return tuple(prefix[:many[-1] + 1])


def _first_many(catalog: Catalog, code: str, sub) -> list[Relation]:
    out = []
    for prefix in sub:
        chain = _chain(catalog, code, prefix)
        if chain and chain[0].to_many:
            out.append(chain[0])
    return out


def _chain(catalog: Catalog, code: str, prefix) -> list[Relation]:
    out, cur = [], code
    for name in prefix:
        rel = catalog.schema(cur).relation(name)
        out.append(rel)
        cur = rel.target
    return out


def attach_chain(catalog: Catalog, code: str, df: DataFrame, sub: dict) -> DataFrame:
    """Attach relation paths below a child frame; to-many hops are left joins.

    One to-many chain per relation frame (sibling chains would multiply rows:
    ``attach_verdicts`` serves those); to-one hops use ``attach_to_one``.
    """
    one = {p: c for p, c in sub.items() if not any(r.to_many for r in _chain(catalog, code, p))}
    many = {p: c for p, c in sub.items() if p not in one}
    if one:
        df = attach_to_one(catalog, code, df, one)
    heads = {p[0] for p in many}
    if len(heads) > 1:
        raise FilterSyntaxError(f"several to-many paths below one relation: {sorted(heads)}")
    for head in heads:
        rel = catalog.schema(code).relation(head)
        rest: dict = defaultdict(set)
        cols: set = set()
        for p, c in many.items():
            if len(p) == 1:
                cols |= set(c)
            else:
                rest[p[1:]] |= set(c)
        inner = child_frame(catalog, rel, sorted(cols) + sorted({r.local_key for r in _first_many(catalog, rel.target, rest)}))
        if rest:
            inner = attach_chain(catalog, rel.target, inner, rest)
        inner = inner.select(F.col(KEY).alias("__k2"), *[F.col(c).alias(col_name(head, c)) for c in inner.columns if c != KEY])
        df = df.join(inner, qcol(rel.local_key) == F.col("__k2"), "left").drop("__k2")
    return df


def _has_many(catalog: Catalog, code: str, prefix) -> bool:
    return any(r.to_many for r in _chain(catalog, code, prefix))


def _related(catalog: Catalog, rel: Relation, columns: list[str]) -> DataFrame:
    """Rows at the other end of a relation, to-one or to-many, keyed by ``__key``."""
    if rel.to_many:
        return child_frame(catalog, rel, columns, dedupe=False)
    target = with_computed(catalog, rel.target, catalog.frame(rel.target), columns)
    return target.select(F.col(rel.foreign_key).alias(KEY), *columns)


def attach_verdicts(catalog: Catalog, code: str, df: DataFrame, wanted: list[tuple[str, _Atom, tuple]], geo_ctx=None) -> DataFrame:
    """``df`` with the truth of conditions on sibling to-many branches below it.

    ``wanted`` holds ``(column, condition, path below code)``.  Each branch is
    reduced to the distinct truth values its rows give to each parent before
    it is joined, so a row of ``df`` meets at most 3^k combinations of a
    branch with k conditions, however many related rows there are.
    """
    def truth(name: str, at: _Atom, value: Column | None = None) -> Column:
        target = _target(catalog, code, tuple(path_of[name]))
        dtype = T.StringType() if at.json_path else catalog.column_type(target, at.column)
        return atom_column(F.lit(None).cast(dtype) if value is None else _col_expr(value, at.json_path), dtype, at.item, geo_ctx)

    path_of = {name: path for name, _, path in wanted}
    for head in sorted({path[0] for _, _, path in wanted}):
        mine = [(name, at, path[1:]) for name, at, path in wanted if path[0] == head]
        rel = catalog.schema(code).relation(head)
        own = [w for w in mine if not _has_many(catalog, rel.target, w[2])]
        deep = [w for w in mine if w not in own]
        one: dict = defaultdict(set)
        for _, at, path in own:
            if path:
                one[path].add(at.column)
        keys = {catalog.schema(rel.target).relation(path[0]).local_key for _, _, path in mine if path}
        inner = _related(catalog, rel, sorted({at.column for _, at, path in own if not path} | keys))
        if one:
            inner = attach_to_one(catalog, rel.target, inner, one)
        if deep:
            inner = attach_verdicts(catalog, rel.target, inner, deep, geo_ctx)
        truths = [truth(name, at, qcol(col_name(prefix_name(path), at.column))).alias(name) for name, at, path in own]
        inner = inner.select(F.col(KEY).alias("__k2"), F.lit(True).alias("__has"), *truths, *[F.col(name) for name, _, _ in deep]).distinct()
        df = df.join(inner, qcol(rel.local_key) == F.col("__k2"), "left")
        for name, at, _ in mine:  # a parent without rows gets the truth of a null
            df = df.withColumn(name, F.when(F.col("__has"), F.col(name)).otherwise(truth(name, at)))
        df = df.drop("__k2", "__has")
    return df


def _attach_dwithin_objects(catalog: Catalog, df: DataFrame, atoms: list[dict]) -> DataFrame:
    """``dwithin code;pk;field;radius``: the other object's centroid, fetched once by key, as literals."""
    from relata.operators import geo

    for i, a in enumerate(atoms):
        if a["type"] != "dwithin":
            continue
        parts = str(a["value"]).split(";")
        if len(parts) != 4:
            continue
        code, pk_value, gfield, radius = parts
        sd = catalog.schema(code)
        other = catalog.frame(code)
        g = sd.computed[gfield](other) if gfield in sd.computed else F.col(gfield)
        cen = geo.centroid(g)
        one = other.filter(F.col(sd.pk) == F.lit(pk_value).try_cast(other.schema[sd.pk].dataType)).select(
            cen["x"].alias("x"), cen["y"].alias("y")).first()  # one row, by primary key
        ox, oy = (one["x"], one["y"]) if one is not None else (None, None)
        a["_ctx"] = (F.lit(ox).cast("double"), F.lit(oy).cast("double"), float(radius))
    return df


def _null_row_truth(node):
    """Three-valued truth of ``node`` for a parent with no related rows."""
    k = node[0]
    if k == "atom":
        a = node[1]
        if a["type"] == "=" and a.get("value") is None:
            return True
        if a["type"] == "any":
            return None  # unknown here: keep the general path
        return None
    if k == "not":
        v = _null_row_truth(node[1])
        return None if v is None else (not v)
    l, r = _null_row_truth(node[1]), _null_row_truth(node[2])
    if k == "and":
        if l is False or r is False:
            return False
        return True if (l is True and r is True) else None
    if l is True or r is True:
        return True
    return False if (l is False and r is False) else None


def _target(catalog: Catalog, code: str, prefix: tuple[str, ...]) -> str:
    cur = code
    for name in prefix:
        cur = catalog.schema(cur).relation(name).target
    return cur


def _last_rel(catalog: Catalog, code: str, path: str) -> Relation:
    hops, _ = catalog.split_path(code, path)
    return hops[-1]


def filter_column(catalog: Catalog, code: str, df: DataFrame, spec, geo_ctx=None):
    """Filter as a boolean column on a widened frame: -> (frame, Column).

    Used when a count of matching rows and a count of all rows are wanted in
    one aggregate.  Semi joins are turned into flags.
    """
    ast = to_ast(spec) if not isinstance(spec, tuple) else spec
    if ast is None:
        return df, F.lit(True)
    df, pred, semis = compile_filter(catalog, code, df, ast, geo_ctx)
    for i, (kind, keys, left) in enumerate(semis):
        flag = f"__semi_{i}"
        k = keys.select(F.col(KEY)).distinct().withColumn(flag, F.lit(True))
        df = df.join(k, qcol(left) == F.col(KEY), "left").drop(KEY)
        f = F.coalesce(F.col(flag), F.lit(False))
        f = ~f if kind == "left_anti" else f
        pred = f if pred is None else (pred & f)
    return df, F.coalesce(pred, F.lit(False)) if pred is not None else F.lit(True)
