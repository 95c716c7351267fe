import random

from pyspark.sql import functions as F

from relata.operators.patterns import join_contains
from relata.operators.relations import expand_codes, filter_nested, get_rows


def test_join_contains_equals_brute_force(spark):
    rnd = random.Random(3)
    alphabet = "abcé "
    texts = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300)))) for i in range(60)]
    pats = []
    for j in range(50):
        src = texts[rnd.randrange(len(texts))][1]
        m = rnd.choice([1, 2, 3, 5, 9, 20, 64, 90])
        if len(src) >= m and rnd.random() < 0.7:
            p = rnd.randrange(len(src) - m + 1)
            pats.append((j, src[p:p + m]))
        else:
            pats.append((j, "".join(rnd.choice(alphabet) for _ in range(m))))
    pats.append((99, ""))
    a = spark.createDataFrame(texts, "id long, txt string")
    b = spark.createDataFrame(pats, "pid long, pat string")
    exp = sorted((i, j) for i, t in texts for j, p in pats if p in t)  # the empty pattern is in every text
    for chars in (1 << 20, 200):  # one block of patterns, and several
        got = join_contains(a, "id", "txt", b, "pid", "pat", block_chars=chars).collect()
        assert sorted((r.id, r.pid) for r in got) == exp and len(exp) > 50


def test_join_contains_short_patterns_nulls_and_wildcards(spark):
    a = spark.createDataFrame([(1, "50% of_x"), (2, None), (3, ""), (4, "é😀é")], "id int, txt string")
    b = spark.createDataFrame([("p", "%"), ("q", "_"), ("r", None), ("s", ""), ("t", "é"), ("u", "😀é"), ("v", "é"), ("w", "of")], "pid string, pat string")
    got = sorted((r.id, r.pid) for r in join_contains(a, "id", "txt", b, "pid", "pat").collect())
    assert got == [(1, "p"), (1, "q"), (1, "s"), (1, "w"), (3, "s"), (4, "s"), (4, "t"), (4, "u"), (4, "v")]
    assert join_contains(a, "id", "txt", b.limit(0), "pid", "pat").collect() == []
    assert join_contains(a.limit(0), "id", "txt", b, "pid", "pat").collect() == []


def test_get_rows_filter_nested_expand(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    assert [r.k for r in get_rows(df, [None], ["v"]).collect()] == [2]
    keys = spark.createDataFrame([(3,), (1,)], "k long")
    assert sorted(r.k for r in get_rows(df, keys, "k").collect()) == [1, 3]
    nested = spark.createDataFrame([(1, [{"s": "F", "n": 1}, {"s": "O", "n": 2}])], "k long, items array<struct<s:string,n:long>>")
    assert [x.n for x in filter_nested(nested, "items", "s", "F").first().items] == [1]
    codes = spark.createDataFrame([("R1",), ("X",)], "code string")
    m = spark.createDataFrame([("R1", "D1"), ("R1", "D2"), ("R2", "D3")], "parent string, child string")
    assert sorted(r.code for r in expand_codes(codes, "code", m).collect()) == ["D1", "D2", "R1", "X"]


def test_join_contains_hot_block(spark):
    # every text holds a long run of '#' (a block common to all texts); patterns mix the run with rare parts
    rnd = random.Random(9)
    texts = [(i, "".join(rnd.choice("xyz") for _ in range(rnd.randint(20, 80))) + "#" * 40 + "".join(rnd.choice("xyz") for _ in range(30)))
             for i in range(80)]
    pats = []
    for j in range(30):
        t = texts[rnd.randrange(len(texts))][1]
        p = t.index("#") - 12
        pats.append((j, t[p:p + 30]))
    pats.append((100, "#" * 20))  # genuinely matches every text
    a = spark.createDataFrame(texts, "id long, txt string")
    b = spark.createDataFrame(pats, "pid long, pat string")
    got = {(r.id, r.pid) for r in join_contains(a, "id", "txt", b, "pid", "pat").collect()}
    exp = {(i, j) for i, t in texts for j, p in pats if p in t}
    assert got == exp
