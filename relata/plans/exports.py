"""Export views (S13, A6, P11): scalar fields plus de-duplicated text of to-many fields.

To-many fields are aggregated per object *before* meeting the object, each
relation on its own, so two to-many relations never multiply; then rows are
grouped by the scalar fields as the flattened view requires.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.catalog import SEP, Catalog, col_name, qcol
from relata.operators.relations import KEY, attach_to_one, child_frame, prefix_name


def export_view_of(catalog: Catalog, code: str, fields: list[str], names: dict[str, str] | None = None,
                   sep: str = ", ", base: DataFrame | None = None) -> DataFrame:
    names = names or {}
    sd = catalog.schema(code)
    df = base if base is not None else catalog.frame(code)
    scalar_reqs: dict = defaultdict(set)
    scalars: list[tuple[str, str]] = []
    many: list[tuple[str, tuple, object, tuple, str]] = []
    for f in fields:
        hops, last = catalog.split_path(code, f)
        out = names.get(f, f.replace(".", SEP))
        if any(h.to_many for h in hops):
            i = next(k for k, h in enumerate(hops) if h.to_many)
            prefix = tuple(h.name for h in hops[:i])
            if prefix:
                scalar_reqs[prefix].add(hops[i].local_key)
            many.append((out, prefix, hops[i], tuple(h.name for h in hops[i + 1:]), last))
        elif hops:
            prefix = tuple(h.name for h in hops)
            scalar_reqs[prefix].add(last)
            scalars.append((out, col_name(prefix_name(prefix), last)))
        else:
            scalars.append((out, last))
    if scalar_reqs:
        df = attach_to_one(catalog, code, df, scalar_reqs)
    links = dict.fromkeys(col_name(prefix_name(prefix), rel.local_key) for _, prefix, rel, _, _ in many)
    df = df.select(*[qcol(k).alias(f"__l_{k}") for k in links], *[qcol(src).alias(o) for o, src in scalars])
    # to-many fields of the same relation share one child frame and one aggregation
    by_rel: dict = defaultdict(list)
    for o, prefix, rel, rest, last in many:
        by_rel[prefix, rel.name].append((o, rel, rest, last))
    for (prefix, _), items in by_rel.items():
        rel = items[0][1]
        own = sorted({last for _, _, rest, last in items if not rest})
        reqs: dict = defaultdict(set)
        for _, _, rest, last in items:
            if rest:
                reqs[rest].add(last)
        hop_keys = {catalog.schema(rel.target).relation(rest[0]).local_key for rest in reqs}
        ch = child_frame(catalog, rel, sorted(set(own) | hop_keys), dedupe=False)  # collect_set ignores repeats
        if reqs:
            ch = attach_to_one(catalog, rel.target, ch, reqs)
        aggs = [F.collect_set(qcol(col_name(prefix_name(rest), last) if rest else last).cast("string")).alias(o)
                for o, _, rest, last in items]
        agg = ch.groupBy(KEY).agg(*aggs)
        df = df.join(agg, qcol(f"__l_{col_name(prefix_name(prefix), rel.local_key)}") == F.col(KEY), "left").drop(KEY)
    outs = [o for o, _ in scalars]

    def text(c):
        c = F.array_sort(c)
        return F.when(F.size(c) > 0, F.array_join(c, sep))

    if sd.pk in [src for _, src in scalars]:
        # one object per group: no regrouping needed
        return df.select(*[qcol(o) for o in outs], *[text(F.coalesce(qcol(o), F.array())).alias(o) for o, *_ in many])
    if not many:
        return df.select(*[qcol(o) for o in outs]).distinct()
    aggs = [text(F.array_distinct(F.flatten(F.collect_list(qcol(o))))).alias(o) for o, *_ in many]
    return df.groupBy(*[qcol(o) for o in outs]).agg(*aggs)
