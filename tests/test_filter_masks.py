"""Filters with many conditions on to-many relations, and sibling branches below a to-one hop."""

import random

from relata.catalog import Catalog, Relation, SchemaDef
from relata.operators.filters import apply_filters


def tables(spark):
    rnd = random.Random(3)
    p = [(i, i % 4) for i in range(40)]
    k = [(i, rnd.randrange(35), rnd.randrange(60), rnd.randrange(6) or None) for i in range(90)]  # parents 35..39 have none
    o = [(i, i % 3) for i in range(6)]
    x = [(i, rnd.randrange(5), rnd.randrange(4)) for i in range(12)]
    y = [(i, rnd.randrange(5), rnd.randrange(4)) for i in range(12)]
    frames = {"p": spark.createDataFrame(p, "pk long, a long"), "k": spark.createDataFrame(k, "ck long, fk long, v long, ok long"),
              "o": spark.createDataFrame(o, "ok long, b long"), "x": spark.createDataFrame(x, "xk long, ok long, c long"),
              "y": spark.createDataFrame(y, "yk long, ok long, d long")}
    cat = Catalog(spark, lambda t: frames[t])
    cat.add(SchemaDef("p", "p", "pk", relations={"kids": Relation("kids", "1-n", "k", "pk", "fk")}))
    cat.add(SchemaDef("k", "k", "ck", relations={"own": Relation("own", "n-1", "o", "ok", "ok")}))
    cat.add(SchemaDef("o", "o", "ok", relations={"xs": Relation("xs", "1-n", "x", "ok", "ok"), "ys": Relation("ys", "1-n", "y", "ok", "ok")}))
    cat.add(SchemaDef("x", "x", "xk"))
    cat.add(SchemaDef("y", "y", "yk"))
    return cat, frames, p, k, x, y


def test_forty_conditions(spark):
    cat, frames, p, k, _, _ = tables(spark)
    kids = {i: [r for r in k if r[1] == i] for i, _ in p}
    ored = ",|,".join(f"kids.v = {i}" for i in range(0, 40))
    got = sorted(r.pk for r in apply_filters(cat, "p", frames["p"], ored).collect())
    assert got == [i for i, _ in p if any(r[2] < 40 for r in kids[i])]
    # negated: a row that equals none of them; without rows the conditions are unknown
    anded = ",".join(f"!,kids.v = {i}" for i in range(0, 40))
    got = sorted(r.pk for r in apply_filters(cat, "p", frames["p"], anded).collect())
    assert got == [i for i, _ in p if any(r[2] >= 40 for r in kids[i])]
    # each condition beside one of the object's own: nothing folds, 40 truths a row
    mixed = ",|,".join(f"[,kids.v = {i},*,a = {i % 4},]" for i in range(0, 40))
    got = sorted(r.pk for r in apply_filters(cat, "p", frames["p"], mixed).collect())
    assert got == [i for i, a in p if any(r[2] < 40 and r[2] % 4 == a for r in kids[i])]
    negated = "!,[," + mixed + ",]"
    got = sorted(r.pk for r in apply_filters(cat, "p", frames["p"], negated).collect())
    false = {i for i, a in p if any(not (r[2] < 40 and r[2] % 4 == a) for r in kids[i])}
    assert got == sorted(false)  # without rows every branch but those of another `a` is unknown


def test_siblings_below_a_to_one_hop_below_a_to_many_one(spark):
    cat, frames, p, k, x, y = tables(spark)
    for spec, rule in (("kids.own.xs.c = 1,*,kids.own.ys.d = 2", lambda c, d: c == 1 and d == 2),
                       ("kids.own.xs.c = 1,|,kids.own.ys.d = 2", lambda c, d: c == 1 or d == 2)):
        got = sorted(r.pk for r in apply_filters(cat, "p", frames["p"], spec).collect())
        exp = set()
        for _, fk, _, ok in k:
            cs = [r[2] for r in x if ok is not None and r[1] == ok] or [None]
            ds = [r[2] for r in y if ok is not None and r[1] == ok] or [None]
            if any(rule(c, d) for c in cs for d in ds):
                exp.add(fk)
        assert got == sorted(exp), spec
