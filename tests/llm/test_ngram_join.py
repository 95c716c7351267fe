"""N-gram Jaccard join against brute force, and the odd cases."""

import itertools
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import LONG, documents, empty_documents  # noqa: E402

from relata.llm.ngram_join import ngram_join, one_of_each_group  # noqa: E402


def grams(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = {i: grams(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if x and y and 100 * both >= percent * (len(x) + len(y) - both):
            links.add((a, b))
            u, v = sorted((root(a), root(b)))
            parent[v] = u
    return {(i, len(s), root(i)) for i, s in sets.items()}, links


def near_copies(seed):
    """Families of edited copies around and below the threshold, chains, short texts and a shared passage."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows, i = [], 0
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 20, 60, 150]))] + (passage if rnd.random() < 0.5 else [])
        for _ in range(rnd.choice([1, 3, 8])):
            text = base[:]
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                text[rnd.randrange(len(text))] = f"edit{rnd.randrange(10 ** 6)}"
            if rnd.random() < 0.3:
                base = text  # chains: each near the one before
            rows.append((i, " ".join(text).upper() if rnd.random() < 0.2 else " ".join(text)))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 3, 80), (3, 5, 80), (4, 1, 70)])
def test_matches_brute_force(spark, seed, k, percent):
    rows = near_copies(seed)
    want, links = brute(rows, k, percent)
    out, found = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()} == want
    for r in found.collect():  # links between classes are links between texts
        assert (r.a, r.b) in links


def test_large_group_of_near_copies_without_its_original(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 58] + [f"x{i}"] + base[i % 58 + 1:])) for i in range(1, 300)]
    want, _ = brute(rows, 3, 90)
    out, links = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()} == want
    with_base = rows + [(1000, " ".join(base))]
    out, links = ngram_join(spark.createDataFrame(with_base, "doc_id long, text string"), 3, 90)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()} == brute(with_base, 3, 90)[0]
    assert links.count() < 3 * len(with_base)


def test_odd_rows(spark):
    out, _ = ngram_join(documents(spark), 3, 90)
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    got = {r[0]: r for r in rows}
    assert len(rows) == 12
    assert got[1][2] == got[2][2] == 1  # only A-Z is folded, and it is
    assert [got[i] for i in (3, 4, 5)] == [(3, 0, 3), (4, 0, 4), (5, 0, 5)]
    assert rows.count((6, 1, 6)) == 2
    assert got[7][2] == got[8][2] == 7
    assert got[None][1] == 3 and got[None][2] is None


def test_empty_table(spark):
    out, links = ngram_join(empty_documents(spark))
    assert out.collect() == [] and links.collect() == []


def test_one_of_each_group_keeps_columns(spark):
    docs = documents(spark)
    kept = one_of_each_group(docs, 3, 90)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 6, 7, 9, 10, None]))


def test_long_texts_are_read_whole(spark):
    rows = [(1, LONG), (2, LONG + " " + " ".join(f"tail{i}" for i in range(20_000)))]
    out, _ = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()} == brute(rows, 5, 80)[0]


def test_one_row_of_each_group(spark):
    """Repeated ids with different texts, repeated rows, and rows without id or words."""
    from collections import Counter

    from pyspark.sql import functions as F

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(200)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (2, b + " end"), (3, c), (3, c), (3, c), (4, c + " end"), (None, c), (None, d), (None, d), (None, d + " end"),
            (5, "short"), (None, "short"), (6, None), (6, None), (7, " \t\n"), (None, ""), (8, a + " end"), (8, "else")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x")).withColumn("times", F.lit(1))
    out = one_of_each_group(df, repeats=False)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    either = [r for r in [(2, b), (2, b + " end")] + [(None, d), (None, d + " end")] if got.pop(r, 0)]
    assert sorted(i or 0 for i, _ in either) == [0, 2]
    assert got == Counter([(1, a), (3, c), (5, "short"), (6, None), (6, None), (7, " \t\n"), (None, ""), (8, "else")])
    again = Counter((r.doc_id, r.text) for r in one_of_each_group(df).collect())
    assert again[3, c] == 3 and again[6, None] == 2 and again[1, a] == 1 and not again[None, c]
    assert one_of_each_group(df.limit(0), repeats=False).count() == 0
