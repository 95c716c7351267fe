"""Random filter expressions: Spark result == a direct evaluation of the grammar's rules."""

import random

from relata.catalog import Catalog, SchemaDef
from relata.operators.filters import apply_filters

ROWS = [(i, i % 7, "abcde"[i % 5]) for i in range(40)]


def atom(rnd):
    if rnd.random() < 0.5:
        op, v = rnd.choice(["=", "<", ">", ">=", "<="]), rnd.randint(0, 6)
        f = {"=": lambda r: r[1] == v, "<": lambda r: r[1] < v, ">": lambda r: r[1] > v,
             ">=": lambda r: r[1] >= v, "<=": lambda r: r[1] <= v}[op]
        return f"a {op} {v}", f
    vals = rnd.sample("abcde", rnd.randint(1, 3))
    return f"b in {';'.join(vals)}", (lambda r, vals=vals: r[2] in vals)


def expr(rnd, depth=0):
    """-> (tokens, python predicate) following: left-assoc, no precedence, '!' on the next operand."""
    toks, cur = [], None
    for i in range(rnd.randint(1, 3)):
        op = None
        if i:
            op = rnd.choice(["*", "|", None])  # None = implicit and
            if op:
                toks.append(op)
        neg = rnd.random() < 0.3
        if neg:
            toks.append("!")
        if depth < 2 and rnd.random() < 0.3:
            sub, f = expr(rnd, depth + 1)
            toks += ["["] + sub + ["]"]
        else:
            t, f = atom(rnd)
            toks.append(t)
        g = (lambda r, f=f: not f(r)) if neg else f
        if cur is None:
            cur = g
        elif op == "|":
            cur = (lambda r, a=cur, b=g: a(r) or b(r))
        else:
            cur = (lambda r, a=cur, b=g: a(r) and b(r))
    return toks, cur


def test_random_filters_match_python(spark):
    df = spark.createDataFrame(ROWS, "k long, a long, b string")
    cat = Catalog(spark, lambda t: df)
    cat.add(SchemaDef("t", "t", "k"))
    rnd = random.Random(17)
    for _ in range(25):
        toks, f = expr(rnd)
        got = sorted(r.k for r in apply_filters(cat, "t", df, ",".join(toks)).collect())
        exp = sorted(r[0] for r in ROWS if f(r))
        assert got == exp, ",".join(toks)


def test_random_to_many_filters_match_row_rule(spark):
    from relata.catalog import Relation

    parents = [(p, p % 4) for p in range(30)]
    kids = [(c, c % 25, c % 5) for c in range(60)]  # parents 25..29 have no children
    P = spark.createDataFrame(parents, "pk long, a long")
    K = spark.createDataFrame(kids, "ck long, fk long, v long")
    cat = Catalog(spark, lambda t: {"p": P, "k": K}[t])
    cat.add(SchemaDef("p", "p", "pk", relations={"kids": Relation("kids", "1-n", "k", "pk", "fk")}))
    cat.add(SchemaDef("k", "k", "ck"))
    rnd = random.Random(23)

    def AND(x, y):
        if x is False or y is False:
            return False
        return None if (x is None or y is None) else True

    def OR(x, y):
        if x is True or y is True:
            return True
        return None if (x is None or y is None) else False

    def NOT(x):
        return None if x is None else not x

    def gen(depth=0):
        toks, cur = [], None
        for i in range(rnd.randint(1, 3)):
            op = rnd.choice(["*", "|"]) if i else None
            if op:
                toks.append(op)
            neg = rnd.random() < 0.3
            if neg:
                toks.append("!")
            if depth < 1 and rnd.random() < 0.3:
                sub, f = gen(depth + 1)
                toks += ["["] + sub + ["]"]
            elif rnd.random() < 0.5:
                v = rnd.randint(0, 3)
                toks.append(f"a = {v}")
                f = lambda p, c, v=v: p[1] == v
            else:
                v = rnd.randint(0, 4)
                toks.append(f"kids.v = {v}")
                f = lambda p, c, v=v: None if c is None else c[2] == v
            g = (lambda p, c, f=f: NOT(f(p, c))) if neg else f
            cur = g if cur is None else ((lambda p, c, x=cur, y=g: OR(x(p, c), y(p, c))) if op == "|" else
                                         (lambda p, c, x=cur, y=g: AND(x(p, c), y(p, c))))
        return toks, cur

    for _ in range(15):
        toks, f = gen()
        got = sorted(r.pk for r in apply_filters(cat, "p", P, ",".join(toks)).collect())
        exp = []
        for p in parents:
            rows = [c for c in kids if c[1] == p[0]] or [None]
            if any(f(p, c) is True for c in rows):
                exp.append(p[0])
        assert got == exp, ",".join(toks)
