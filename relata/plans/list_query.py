"""The list query: fields, permission scope, pre-filters, filters, sort, page, counts.

``ListQuery(...).build()`` returns the page as a lazy DataFrame;
``.info()`` returns one row with page, page_size, total, filtered,
last_page (A1, A2, O6) computed by one aggregate plan.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.catalog import SEP, Catalog, UnknownField, col_name, qcol, with_computed
from relata.operators import filters as flt
from relata.operators import ordering, relations, scope


class FieldError(ValueError):
    pass


def check_fields(catalog: Catalog, code: str, fields: list[str], allowed: list[str] | None = None) -> None:
    """Plan-time field check (P12): unknown and unauthorised fields are distinct errors."""
    unknown = [f for f in fields if f not in ("row_number", "scope") and not catalog.has_field(code, f)]
    if unknown:
        raise FieldError(f"unknown fields for {code}: {unknown}")
    allowed = allowed if allowed is not None else catalog.schema(code).authorized_fields
    if allowed is not None:
        bad = [f for f in fields if f not in allowed and f.split(".")[0] not in allowed]
        if bad:
            raise FieldError(f"unauthorised fields for {code}: {bad}")


@dataclass
class ListQuery:
    catalog: Catalog
    code: str
    fields: list[str] | None = None
    prefilters: object = None
    filters: object = None
    sort: object = None
    page: int | None = None
    page_size: int | None = None
    user: object = None
    allowed_scope: int = 3
    sensitive_only: bool = False
    object_prefilters: object = None
    geo_ctx: dict | None = field(default=None)
    strict: bool = False  # check fields before planning (P12) instead of skipping unknown ones (P1)

    def __post_init__(self):
        if self.strict and self.fields:
            check_fields(self.catalog, self.code, list(self.fields))

    # ------------------------------------------------------------ stages
    def _scoped(self) -> DataFrame:
        df = self.catalog.frame(self.code)
        df = scope.restrict(self.catalog, self.code, df, self.user, self.allowed_scope)
        if self.sensitive_only:
            df = scope.restrict_sensitive(self.catalog, self.code, df)
        return df

    def total_frame(self) -> DataFrame:
        """Rows counted by ``total``: permission + object pre-filters + request pre-filters."""
        df = self._scoped()
        for spec in (self.object_prefilters, self.prefilters):
            if spec:
                df = flt.apply_filters(self.catalog, self.code, df, spec, self.geo_ctx)
        return df

    def filtered_frame(self) -> DataFrame:
        df = self.total_frame()
        if self.filters:
            df = flt.apply_filters(self.catalog, self.code, df, self.filters, self.geo_ctx)
        return df

    # ------------------------------------------------------------ output
    def build(self) -> DataFrame:
        sd = self.catalog.schema(self.code)
        df = self.filtered_frame()
        fields = list(self.fields or sd.defaults())
        df, order = ordering.sort_columns(self.catalog, self.code, df, self.sort)
        want_rn = "row_number" in fields
        if want_rn and self.page_size and int(self.page_size) > 0:
            pg = ordering.page(df, order, self.page, self.page_size)
            off = (max(int(self.page or 1), 1) - 1) * int(self.page_size)
            # the page is small: numbering inside it is a bounded window
            from pyspark.sql import Window

            pg = pg.withColumn("row_number", (F.row_number().over(Window.orderBy(*order)) + F.lit(off)).cast("long"))
        elif want_rn:
            pg = ordering.with_row_number(df, order, "row_number")
        elif not self.sort and not (self.page_size and int(self.page_size) > 0):
            return self._project(df, fields).drop(*ordering.sort_helpers(df))  # everything, in no order asked for
        else:
            pg = ordering.page(df, order, self.page, self.page_size)
        out = self._project(pg, fields)
        helpers = ordering.sort_helpers(out)
        return out.orderBy(*order).drop(*helpers)

    def _project(self, df: DataFrame, fields: list[str]) -> DataFrame:
        sd = self.catalog.schema(self.code)
        cat = self.catalog
        reqs: dict[tuple[str, ...], set[str]] = defaultdict(set)
        select = []
        nested_specs: dict[tuple[str, ...], list[str]] = defaultdict(list)
        keep = [sd.pk]
        fields = [f for f in fields if f not in sd.load_only]
        for f in fields:
            if f == "row_number":
                select.append(("row_number", F.col("row_number")))
                continue
            if f == "scope":
                df = scope.scope_of(cat, self.code, df, self.user)
                select.append(("scope", F.col("scope")))
                continue
            try:
                hops, last = cat.split_path(self.code, f)
            except UnknownField:
                continue
            if any(h.to_many for h in hops):
                i = next(k for k, h in enumerate(hops) if h.to_many)
                path = tuple(h.name for h in hops[: i + 1])
                if i > 0:
                    reqs[path[:-1]].add(hops[i].local_key)
                sub = ".".join([h.name for h in hops[i + 1 :]] + ([last] if last else []))
                nested_specs[path].append(sub) if sub else nested_specs[path]
                continue
            if hops and last is None:
                # relation without sub-field: its default fields
                tsd = cat.schema(hops[-1].target)
                prefix = tuple(h.name for h in hops)
                for d in tsd.defaults():
                    reqs[prefix].add(d)
                    select.append((f"{SEP.join(prefix)}{SEP}{d}", qcol(col_name(SEP.join(prefix), d))))
                continue
            if hops:
                prefix = tuple(h.name for h in hops)
                base, jp = flt._json_split(cat, hops[-1].target, last)
                try:
                    cat.column_type(hops[-1].target, base)
                except UnknownField:
                    continue
                reqs[prefix].add(base)
                c = qcol(col_name(SEP.join(prefix), base))
                select.append((f.replace(".", SEP), F.get_json_object(c, jp) if jp else c))
                continue
            base, jp = flt._json_split(cat, self.code, last)
            try:
                cat.column_type(self.code, base)
            except UnknownField:
                continue
            df = with_computed(cat, self.code, df, [base])
            select.append((f.replace(".", SEP), F.get_json_object(qcol(base), jp) if jp else qcol(base)))
        if reqs:
            df = relations.attach_to_one(cat, self.code, df, reqs)
        for path, subs in nested_specs.items():
            owner = relations.relation_chain(cat, self.code, path[:-1])[-1].target if path[:-1] else self.code
            name = SEP.join(path)
            df = relations.nested(cat, owner, df, path[-1], [s for s in subs if s] or None, out=name, below=SEP.join(path[:-1]))
            select.append((name, F.col(name)))
        helpers = ordering.sort_helpers(df)
        return df.select(*[c.alias(n) for n, c in select], *[F.col(h) for h in helpers])

    def info(self) -> DataFrame:
        """One row: page, page_size, total, filtered, last_page, last_page_filtered."""
        tot = self.total_frame()
        if self.filters:
            wide, pred = flt.filter_column(self.catalog, self.code, tot, self.filters, self.geo_ctx)
            counts = wide.agg(F.count(F.lit(1)).alias("total"), F.count_if(pred).alias("filtered"))
        else:
            counts = tot.agg(F.count(F.lit(1)).alias("total")).withColumn("filtered", F.col("total"))
        size = int(self.page_size) if self.page_size else 0
        last = (F.ceil(F.col("total") / F.lit(size)) if size > 0 else F.lit(1)).cast("long")
        lastf = (F.ceil(F.col("filtered") / F.lit(size)) if size > 0 else F.lit(1)).cast("long")
        return counts.select(
            F.lit(int(self.page or 1)).alias("page"),
            F.lit(size).alias("page_size"),
            F.col("total").cast("long").alias("total"),
            F.col("filtered").cast("long").alias("filtered"),
            last.alias("last_page"),
            lastf.alias("last_page_filtered"),
        )

    def page_with(self, pk_value) -> DataFrame:
        """The page holding a given object (O10): its page number (one bounded row), then that page."""
        r = self.page_of(pk_value).first()
        if r is None:  # unknown object: no page holds it
            return ListQuery(**self.__dict__).build().limit(0)
        return ListQuery(**{**self.__dict__, "page": int(r["page"])}).build()

    def page_of(self, pk_value) -> DataFrame:
        """Page number holding a given object under the current filters and sort."""
        return ordering.page_of(self.catalog, self.code, self.filtered_frame(), self.sort, pk_value, int(self.page_size or 10))


def lookup(catalog: Catalog, code: str, text: str, k: int = 10, min_length: int = 1) -> DataFrame:
    """Search-as-you-type (O8): label ``~`` text, first ``k`` by label."""
    sd = catalog.schema(code)
    label = sd.label or sd.pk
    if text is None or len(text) < min_length:
        return catalog.frame(code).limit(0).select(sd.pk, label)
    q = ListQuery(catalog, code, fields=[sd.pk, label], filters=f"{label} ~ {text}", sort=label, page_size=k)
    return q.build()
