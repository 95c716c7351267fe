"""Filter audit and centroid clustering: odd cases and brute force beside their SQL."""

import hashlib
import itertools
import math
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import documents, empty_documents  # noqa: E402

from relata.llm import ptolemaic  # noqa: E402
from relata.llm.filter_audit import audit  # noqa: E402


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                             ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", re.search(r"[#$%&*|]", text))) if bad}


def brute_audit(rows, good, toxic):
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    out = {}
    bad = [(i, p or "", fails(t or "") | ({"E"} if i is not None and texts[t or ""] < i else set())) for i, t, p in rows]
    for part in {p for _, p, _ in bad}:
        mine = [(i, f) for i, p, f in bad if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    rnd = random.Random(12)
    long = [" ".join(f"w{rnd.randrange(900)}" for _ in range(260)) for _ in range(6)]
    pool = long + ["same " * 250, long[0].upper(), long[1] + " | 5 %", "", None, " \t\n\x0b\f\r ", "Ü 中 😀 ſ", "x y z " * 210]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(pool), rnd.choice(["a", "b", "hot", "hot", None, ""])) for _ in range(300)]
    rows += [(7, pool[0], "a"), (7, pool[0], "a"), (7, pool[1], "b")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 30)] + [(3, None, 1), (4, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit(1) for c in ("id", "part", "hash", "bits", "n", "good", "c", "s")}).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("is_good", F.lit("x"))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit(docs, marks).collect()}
    assert got == brute_audit(rows, good, toxic)


def test_audit_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(empty_documents(spark), labels).collect() == []
    rows = audit(documents(spark), labels).collect()  # very long texts, nulls, clashing columns
    assert len(rows) == 600 and {r.part for r in rows} == {"x"}
    assert all(r.kept + sum(s.removed for s in rows if s.filter_order == r.filter_order and s.step <= r.step) == 12 for r in rows)


# ---------------------------------------------------------------- centroid clustering
def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept))][:k]
    cents = [list(c) for c in cents]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    per = {j: sum(d for _, d, o in last if o == j) for _, _, j in last}
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for i, d, j in last), key=repr)


def vectors(n, seed, wide=1.0):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(9, 64)) * wide
    return [(i, [float(np.float32(x)) for x in middle[i % 9] + rnd.normal(size=64) * wide / 4]) for i in range(n)]


@pytest.mark.parametrize("wide", [1.0, 1e5])
def test_clusters_against_brute_force(spark, wide):
    rows = vectors(400, 3, wide) + [(5, None), (6, [1.0] * 63), (7, [None] + [1.0] * 63), (8, [float("nan")] * 64), (9, [float("inf")] * 64),
                                    (None, [0.5] * 64), (11, [0.0] * 64), (11, [0.0] * 64), (12, [-0.001] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "x", "h", "cluster", "n")})
    got = sorted(map(tuple, ptolemaic.cluster(df.repartition(5), k=20, rounds=3).collect()), key=repr)
    assert got == brute_clusters([(i, v) for i, v in rows], 20, 3)


def test_clusters_of_few_and_equal_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert ptolemaic.cluster(spark.createDataFrame([], kind)).collect() == []
    equal = [(i, [2.0] * 64) for i in range(90)]
    got = ptolemaic.cluster(spark.createDataFrame(equal, kind)).collect()
    assert len(got) == 90 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}
    few = vectors(7, 1)
    got = sorted(map(tuple, ptolemaic.cluster(spark.createDataFrame(few, kind)).collect()), key=repr)
    assert got == brute_clusters(few, 40, 5)


def test_bounds_are_below_distances_and_pass_centroids_over():
    v = np.floor(256 * np.array([x for _, x in vectors(3000, 8)])).astype(np.int64)
    cents = v[:40]
    pivots = ptolemaic.far_pivots(cents)
    assign = ptolemaic.Assigner(cents, pivots)
    x = ptolemaic.to_pivots(v, pivots)
    true = ((v[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (assign.bounds(x) ** 2 <= true).all()
    of, dist = assign(v, x)
    assert (of == true.argmin(axis=1)).all() and (dist == true.min(axis=1)).all()
    assert assign.checked < 0.6 * true.size
