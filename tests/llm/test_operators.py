"""Operators 1 to 9 against brute force, round trips or held-out accuracy, and the odd cases."""

import collections
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import LONG, TEXTS, documents, empty_documents  # noqa: E402

from relata.llm import ann, html_text, mixing, packing, quality, sharding, token_counts, topk, url_filter  # noqa: E402
from relata.llm.common import components, dense_sum, split_words, table  # noqa: E402

SF = "/root/testdata/sf0.001"
SF_LABELS = "/root/testdata/sf0.1"


# ---------------------------------------------------------------- shared helpers
def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        u, v = sorted((root(a), root(b)))
        parent[v] = u
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_dense_sum(spark):
    def add(batch, acc):
        np.add.at(acc, batch.column(0).to_numpy(), 1)

    rows = spark.range(5000).select((F.col("id") % 37).alias("x"))
    got = dense_sum(rows, add, 40, block=16)
    assert got.tolist() == [5000 // 37 + (i < 5000 % 37) for i in range(37)] + [0, 0, 0]
    assert dense_sum(rows.limit(0), add, 40, block=16).tolist() == [0] * 40


def test_split_words():
    import pyarrow as pa

    texts = [t for _, t in TEXTS]
    words, index, counts = split_words(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), "text")
    at = 0
    for t, n in zip(texts, counts):
        assert [words[i] for i in index[at:at + n]] == (t or "").encode().split()
        at += n


# ---------------------------------------------------------------- 1: token counts
def tokens_of(text):
    import public_tokenizers

    encoder, lengths = token_counts._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return [int(lengths[i]) for i in encoder.encode_ordinary(text)]


def brute_sections(text, rule):
    raw = text.encode()
    lines = raw.split(b"\n")
    ends = np.cumsum([len(x) + 1 for x in lines])
    ends[-1] -= 1
    if len(lines) > 1 and not lines[-1]:
        ends = ends[:-1]
    counts, at = [0.0] * len(ends), 0
    for n in tokens_of(text):
        held = [max(0, min(at + n, e) - max(at, s)) for s, e in zip([0, *ends[:-1]], ends)]
        if rule == "share":
            counts = [c + h / n for c, h in zip(counts, held)]
        else:
            counts[next(i for i, h in enumerate(held) if h) if rule == "first" else int(np.argmax(held))] += 1
        at += n
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_brute_force(spark, rule):
    rows = [(i, t) for i, t in enumerate(["a\n\n\nb", "x  \n  y\n", "\n", "eins zwei\n\n\n\n\tdrei 😀\n中文", "plain", "a\r\n\r\nb \n c"])]
    got = collections.defaultdict(list)
    for r in sorted(token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), rule=rule).collect()):
        got[r.doc_id].append(r)
    for i, t in rows:
        assert [r.n_tokens for r in got[i]] == pytest.approx(brute_sections(t, rule))
        assert sum(r.n_tokens for r in got[i]) == pytest.approx(len(tokens_of(t)))
        assert [t[r.start_char:r.end_char] for r in got[i]] == t.splitlines(keepends=True) or "\r" in t
        assert got[i][-1].end_char == len(t)


def test_long_white_space_gets_the_tokenizers_ids(monkeypatch):
    import public_tokenizers

    encoder, _ = token_counts._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rnd = random.Random(4)
    monkeypatch.setattr(token_counts, "_RUN", token_counts.re.compile(token_counts._RUN.pattern.replace("10000", "3")))
    for _ in range(3000):
        text = "".join(rnd.choice([" ", "\n", "\t", "\xa0", "\u2003", "\r", "a", "1", ".", "'s", "\x1c", "é"]) * rnd.choice([1, 1, 2, 5]) for _ in range(rnd.randrange(12)))
        assert token_counts.encode(encoder, text) == encoder.encode_ordinary(text), repr(text)


def test_token_counts_of_blank_runs_and_bytes(spark):
    n = 10_000_000
    blank = spark.sql(f"SELECT 1L AS doc_id, concat('a', repeat(' ', {n}), 'b') AS text UNION ALL SELECT 2L, repeat('\n', 1000) || repeat('\t', {n})")
    got = {r.doc_id: r for r in token_counts.token_counts(blank).groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("d"), F.max("end_char").alias("c")).collect()}
    assert got[1].n == got[1].d and got[1].c == n + 2 and got[2].n == got[2].d and got[2].c == n + 1000
    odd = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61ff620a63') AS STRING) AS text")
    assert [(r.section, r.start_char, r.end_char) for r in token_counts.token_counts(odd).collect()] == [(0, 0, 4), (1, 4, 5)]


def test_token_counts_odd_rows(spark):
    rows = token_counts.token_counts(documents(spark)).collect()
    by = collections.Counter(r.doc_id for r in rows)
    assert by[3] == by[4] == 1 and by[6] == 2 and by[None] == 1
    for i, t in TEXTS:
        if by[i] and i not in (6, None):
            assert sum(r.n_tokens for r in rows if r.doc_id == i) == len(tokens_of(t or ""))
    assert token_counts.token_counts(empty_documents(spark)).collect() == []
    with pytest.raises(ValueError):
        token_counts.token_counts(documents(spark), rule="last")


# ---------------------------------------------------------------- 2 and 4: vectors
def vectors(spark, n=600, dim=16, seed=0, nulls=True):
    rnd = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rnd.normal(0, 0.3, (n, dim)) + rnd.normal(0, 1, (8, dim))[rnd.integers(0, 8, n)])]
    if nulls:
        rows += [(200, None), (700, [None] * dim), (800, [float("nan")] * dim), (900, []), (None, rows[0][1]), (1000, [float("inf")] * dim),
                 (300, rows[5][1]), (301, rows[5][1]), (1100, [0.0] * dim), (1200, [1.0, 2.0]), (1300, [0.5, -1.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "score", "c", "q", "rank")})


def usable(rows, zero):
    return [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def brute_search(rows, every, k, score):
    """A set of answers; rows of one query id ask together, and each row is a candidate of its own."""
    asked = collections.defaultdict(list)
    for i, v in rows:
        if i % every == 0:
            asked[i] += [(-score(v, w), j) for j, w in rows if j != i and len(w) == len(v)]
    return {(i, r, j, -s) for i, found in asked.items() for r, (s, j) in enumerate(sorted(found)[:k], 1)}


@pytest.mark.parametrize("nulls", [True, False])
def test_exact_topk(spark, nulls):
    rows, df = vectors(spark, seed=int(nulls), nulls=nulls)
    whole = [(i, np.floor(1024 * v).astype(int)) for i, v in usable(rows, True)]
    got = {tuple(r) for r in topk.exact_topk(df, every=100, k=10).collect()}
    assert got == brute_search(whole, 100, 10, lambda a, b: int(a @ b))


def test_exact_topk_ties_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 2000, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.exact_topk(df, every=100, k=10).collect()}
    assert got == brute_search([(i, np.array([1024, 0])) for i, _ in rows], 100, 10, lambda a, b: int(a @ b))
    df = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.exact_topk(df, every=7, k=10).collect()} == brute_search(
        [(i, np.array([1024, 0])) for i, _ in rows[:3]], 7, 10, lambda a, b: int(a @ b))


def test_threshold_search_stops_early_and_exactly():
    rnd = np.random.default_rng(2)
    m = rnd.normal(0, 1, (4000, 4))
    q = rnd.normal(0, 1, (5, 4))
    for i, ids, scores in topk.threshold_search(np.arange(-5, 0), q, np.arange(4000), m, 10):
        all_scores = (np.floor(1024 * m) @ np.floor(1024 * q[i + 5])).astype(int)
        order = np.lexsort((np.arange(4000), -all_scores))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == all_scores[order].tolist()


def test_vector_searches_take_odd_rows(spark):
    rows, df = vectors(spark)
    for out, every, zero in ((topk.exact_topk(df), 100, True), (ann.nearest(df), 50, False)):
        got = out.collect()
        ids = {i for i, _ in usable(rows, zero)}
        assert {r.query_id for r in got} == {i for i in ids if i % every == 0}
        assert {r.vec_id for r in got} <= ids
        assert [r for r in got if r.query_id in (1200, 1300)] != [] and all(r.vec_id in (1200, 1300) for r in got if r.query_id in (1200, 1300))
    assert topk.exact_topk(df.limit(0)).collect() == [] and ann.nearest(df.limit(0)).collect() == []


def test_ann_recall_and_scores(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.select("vec_id", "embedding").collect()]
    got = ann.nearest(df, every=50, k=5).collect()
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    at = {i: n for n, (i, _) in enumerate(rows)}
    ids = np.array([i for i, _ in rows])
    hits = total = 0
    for i in ids[ids % 50 == 0]:
        s = m @ m[at[i]]
        s[at[i]] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        mine = [r for r in got if r.query_id == i]
        assert [r.rank for r in sorted(mine, key=lambda r: r.rank)] == [1, 2, 3, 4, 5]
        for r in mine:
            assert r.score == pytest.approx(s[at[r.vec_id]], abs=1e-12)
        hits += len(best & {r.vec_id for r in mine})
        total += 5
    assert hits / total >= 0.9


def test_kd_tree_gives_every_row_nearest_leaf_first():
    p = np.random.default_rng(0).normal(size=(1000, 8))
    leaves = list(ann.KdTree(p).leaves(p[7]))
    assert sorted(np.concatenate([r for _, r in leaves]).tolist()) == list(range(1000)) and 7 in leaves[0][1]
    far = [d for d, _ in leaves]
    assert far == sorted(far) and all(d <= ((p[r] - p[7]) ** 2).sum(axis=1).min() + 1e-12 for d, r in leaves)
    assert sum(len(r) for _, r in ann.KdTree(np.zeros((100, 8))).leaves(np.ones(8))) == 100


def test_the_chi_square_stop_fires_in_a_full_block():
    """Recall against brute force and the share of a full block that is verified."""
    from relata.llm.vectors import CANDIDATES

    rng = np.random.default_rng(5)
    middle = rng.normal(size=(300, 64))
    m = middle[rng.integers(0, 300, CANDIDATES)] + rng.normal(size=(CANDIDATES, 64)) * 0.4
    ids, q, seen, hits = np.arange(CANDIDATES), np.arange(0, CANDIDATES, 200), [], 0
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i, found, _ in ann.projected_search(q, m[q], ids, m, verified=seen):
        s = unit @ unit[i]
        s[i] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(found.tolist()))
    assert hits >= 0.9 * 5 * len(q)
    assert np.mean(seen) <= 0.3 * CANDIDATES


def test_equal_vectors_come_in_id_order(spark):
    rng = np.random.default_rng(8)
    for n in (20, 57, 200):
        v = rng.normal(size=64)
        ids = rng.permutation(np.arange(1, n + 1))
        for one, found, scores in ann.projected_search(np.array([0]), v[None], ids, np.tile(v, (n, 1))):
            assert found.tolist() == [1, 2, 3, 4, 5] and len(set(scores.tolist())) == 1
    v = [float(np.float32(x)) for x in rng.normal(size=64)]
    rows = [(i, v) for i in range(0, 300)] + [(i, [float(np.float32(x)) for x in rng.normal(size=64)]) for i in range(300, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df.repartition(7), every=50, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert all(got[q] == [i for i in range(6) if i != q][:5] for q in range(0, 300, 50))


def test_results_do_not_depend_on_partitions(spark, monkeypatch):
    from relata.llm import vectors as blocks

    monkeypatch.setattr(blocks, "CANDIDATES", 100)  # several blocks
    _, df = vectors(spark, n=900, dim=24, seed=3, nulls=False)
    runs = [sorted(map(tuple, ann.nearest(df.repartition(n), every=20).collect())) for n in (1, 8)]
    assert runs[0] == runs[1]
    monkeypatch.setattr(blocks, "QUERY_BYTES", 2000)  # and several groups of queries
    assert sorted(map(tuple, ann.nearest(df, every=20).collect())) == runs[0]


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95) - 15.507) < 1e-2


# ---------------------------------------------------------------- 3: HTML
PAGES = {
    "<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy, now!</div><article><h1>Head</h1>"
    "<p>First &amp; <b>bold</b>  text.</p><p>Second<br>line.</p></article><footer>&copy; x</footer></body></html>":
        "Head\nFirst & bold text.\nSecond line.",
    "<article><p><b>Open bold.<br><p>Next.</article><footer>f": "Open bold.\nNext.",
    "<body><header><h1>Site</h1></header><main><p>Body text, one.</p><aside>Side</aside><form>Name <input></form>"
    "<section class='comments'><p>Reader says.</p></section></main></body>": "Body text, one.",
    "<body><div id='nav'><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><div id=content><h2>Title here</h2>"
    "<p>A long paragraph, with commas, and more. It goes on and on.</p><p>Another long paragraph, also with commas. Fine.</p>"
    "<p>And a third paragraph, of the same kind. Good.</p></div><div class='cookie-notice'>We use cookies.</div><div class=footer>c</div></body>":
        "Title here\nA long paragraph, with commas, and more. It goes on and on.\nAnother long paragraph, also with commas. Fine.\n"
        "And a third paragraph, of the same kind. Good.",
    "<article><p>a < b and c &lt; d</p><script>var t='</p>';</script><!-- no --><p hidden>gone</p><p>x<!-- y -->z</p>": "a < b and c < d\nxz",
    "<article></article><p>outside</p>": "outside",
    "": "",
    "<": "<",
    "<p": "",
}


def test_main_text():
    for page, want in PAGES.items():
        assert html_text.main_text(page) == want or page.startswith("<article></article>"), page
    assert html_text.main_text(None) == ""
    assert html_text.main_text("<article>" + "<p>" + "x" * 10**6 + "</p>" * 3) == "x" * 10**6


def test_content_nodes_elect_the_element():
    """Pages where <article>/<main> alone would choose wrongly: none, several, blank, or only a notice."""
    one = "<p>A long paragraph, with commas, and more. It goes on, and on.</p><p>Short.</p>"
    two = "<p>Another long one, also with commas. Fine, it ends, here.</p>"
    first, second = "A long paragraph, with commas, and more. It goes on, and on.\nShort.", "Another long one, also with commas. Fine, it ends, here."
    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li></ul>"
    whole = f"{first}\n{second}"
    for page, want in {
        "<article></article><p>outside</p>": "outside",
        f"<body>{menu}<article>{one}</article><article>{two}</article>{menu}</body>": whole,
        f"<body>{menu}<article>{one}</article>{menu}<article><a href=4>More of this</a></article></body>": first,
        f"<body>{menu}<main> <p> </p></main><div>{one}{two}</div>{menu}</body>": whole,
        f"<body>{menu}<main><p>Loading</p></main><div>{one}{two}</div>{menu}</body>": whole,
        f"<body>{menu}<div><div>{one}{two}</div><div>{menu}</div></div></body>": whole,
        f"<body>{menu}{one}{two}{menu}</body>": whole,
        f"<body>{menu}<h2>Head</h2>{one}<div>aside of two words</div>{two}{menu}</body>": f"Head\n{first}\naside of two words\n{second}",
        "<article><a href=1>Only a link</a></article>": "Only a link",
        f"<body>{menu}</body>": "",
    }.items():
        assert html_text.main_text(page) == want, page


def test_names_and_open_tags_keep_the_article():
    text = "<p>A long paragraph, with commas, and more. It goes on, and on.</p><p>Another long one, also with commas. Fine, it ends.</p>"
    want = "A long paragraph, with commas, and more. It goes on, and on.\nAnother long one, also with commas. Fine, it ends."
    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>"
    for page in (
        *(f"<body>{menu}<div {name}><article>{text}</article></div></body>" for name in (
            "class='content with-sidebar'", "class='layout-has-sidebar'", "id='search-content'", "class='post share-enabled'",
            "class='search'", "id=overlay", "role=search")),
        *(f"<body>{menu}<div {name}>{text}</div></body>" for name in ("class='content with-sidebar'", "id='search-content'", "class=widget")),
        f"<body>{menu}" + "".join(f"<div class=widget>{p}</p></div>" for p in text.split("</p>")[:-1]) + "</body>",
        f"<body><form action=x>{menu}<article>{text}</article></form></body>",
        f"<body><form action=x>{menu}<div>{text}</div></form></body>",
        f"<body><article><svg class=icon />{text}</article></body>",
        f"<body><article><svg class='a>b'/>{text}</article><svg><text>x</text></svg></body>",
        f"<body><article><math />{text}</article></body>",
        f"<body><article><svg><g><svg/></g><text>x</text></svg>{text}</article></body>",
        *(f"<body><article><{tag} name=a>{text}</article></body>" for tag in ("select", "button", "object")),
        f"<body><article>{text}<div class='share'>Share, now!</div><form>Name <input></form></article><div class='ad-2-box'>Buy, now!</div></body>",
        f"<body><article>{text}</article><section class='post-comments'><article class=comment><p>Reader says.</p></article></section></body>",
        f"<body>{menu}<article><div class=widget>{text}</div></article></body>",
        f"<body><div class=share>{text.split('</p>')[0]}</p></div><div class=widget>{text.split('</p>')[1]}</p></div></body>",
        f"<body><article>{text}<p hidden>gone</p><button>Like</button><select><option>A</select></article></body>",
    ):
        assert html_text.main_text(page) == want, page
    long_advert = "<div class=ad>Buy, now, all of it, here, today, at once, and again, and again! Cheap, good, new, and more.</div>"
    assert html_text.main_text(f"<body>{menu}{long_advert}<article><h1>Brief.</h1></article></body>") == "Brief."


def test_extract(spark):
    rows = [(1, "u", p) for p in PAGES] + [(None, None, None), (1, "u", "<article>same</article>"), (1, "u", "<article>same</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(df).collect()
    assert len(out) == len(rows) and sum(r.text == "same" for r in out) == 2
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract(df.limit(0)).collect() == []


def test_extract_driver_pages(spark):
    import html
    import re

    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", body))
        assert html_text.main_text(r.html) == "\n".join(x for x in parts if x)


# ---------------------------------------------------------------- 5: mixing
def test_rates_meet_targets(spark):
    rnd = np.random.default_rng(1)
    p = rnd.dirichlet([0.3, 0.3, 0.3], 400)
    n = rnd.integers(1, 200, 400)
    rows = [(i, i, int(n[i]), 1, *map(float, p[i])) for i in range(400)]
    members = spark.createDataFrame(rows, "doc_id long, h long, n long, copies long, p0 double, p1 double, p2 double")
    for least, want in ((0.0, [0.5, 0.3, 0.2]), (1.0, [0.4, 0.4, 0.2])):
        got = {r.doc_id: r.rate for r in mixing.fit_rates(members, want, least).collect()}
        x = np.array([got[i] for i in range(400)])
        totals = (x * n) @ p
        assert x.min() >= least
        if least == 0:
            assert np.allclose(totals / totals.sum(), want, atol=1e-4)
        # brute-force projected gradient
        t = n @ p
        goal, y = np.array(want) * max(t / np.array(want)), np.ones(400)
        for _ in range(2000):
            y = np.maximum(least, y - p @ (((y * n) @ p - goal) / t))
        ours = ((((x * n) @ p - goal) ** 2) / t).sum()
        best = ((((y * n) @ p - goal) ** 2) / t).sum()
        assert ours <= best + 2e-3 * (((t - goal) ** 2) / t).sum() + 1e-6


def test_mixing_on_driver_tables(spark):
    from relata.llm.queries import TARGETS, labelled_domains

    docs = table(spark, SF, "documents")
    labelled = labelled_domains(spark, SF)
    out = mixing.rates_by_row(docs, docs, labelled, TARGETS).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(out) == len(lang) and sum(r.domain == lang[r.doc_id] for r in out) >= 0.9 * len(out)
    totals = {d: sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in out) for d in TARGETS}
    for d, w in TARGETS.items():
        assert totals[d] / sum(totals.values()) == pytest.approx(w, abs=1e-3)
    mixed = mixing.mix(docs, docs, labelled, TARGETS, least=1.0)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == set(lang)


def test_mixing_odd_rows(spark):
    from relata.llm.queries import TARGETS

    docs = documents(spark)
    labelled = spark.createDataFrame([(1, "en"), (9, "de"), (9, "xx"), (None, "en"), (5, None)], "doc_id long, domain string")
    out = mixing.rates_by_row(docs, docs, labelled, TARGETS).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in TEXTS)
    assert all(r.rate >= 0 for r in out) and [r.n_tokens for r in out if r.doc_id in (3, 4, 5)] == [0, 0, 0]
    assert mixing.mix(docs, docs, labelled, TARGETS, least=1.0).columns == docs.columns
    none = empty_documents(spark)
    assert mixing.rates_by_row(none, none, labelled.limit(0), TARGETS).collect() == []
    assert mixing.mix(none, none, labelled.limit(0), TARGETS).collect() == []


# ---------------------------------------------------------------- 6: quality
def test_quality_held_out_accuracy(spark):
    docs, labels = table(spark, SF_LABELS, "documents"), table(spark, SF_LABELS, "labels")
    out = quality.quality_scores(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out)
    good = [r.predicted for r in held if r.quality == 1]
    poor = [r.predicted for r in held if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.1 * len(poor)
    assert sum((r.score - r.quality) ** 2 for r in held) / len(held) < 0.05


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (6, 0, 0), (9, None, 0), (None, 1, 0), (7, 5, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(documents(spark), labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (3, 4, 5)}) == 1
    none = quality.quality_scores(documents(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(empty_documents(spark), labels).collect() == []
    kept = quality.keep_good(documents(spark), labels)
    assert kept.columns == documents(spark).columns
    assert quality.keep_good(empty_documents(spark), labels).collect() == []


# ---------------------------------------------------------------- 7: packing
def check_pack(rows, out, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizer())
    want = collections.Counter()
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[(i, ids.tobytes())] += 1
    place = collections.defaultdict(list)
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        place[r.sequence_id].append((r.offset, r))
    stream = []
    for s in sorted(place):
        at = 0
        for offset, r in sorted(place[s], key=lambda x: x[0]):
            assert offset == at
            at += r.length
            stream.append(r)
        assert at == window or s == max(place)
    assert sorted(place) == list(range(len(place)))
    got, open_ids = collections.Counter(), b""
    for r in stream:  # pieces of a document follow each other
        assert r.start * 4 == len(open_ids) and r.cut_before == (r.start > 0) and r.cut_after == (r.start + r.length < r.doc_tokens)
        open_ids += bytes(r.ids)
        if not r.cut_after:
            got[(r.doc_id, open_ids)] += 1
            open_ids = b""
    assert got == want


@pytest.mark.parametrize("window", [2048, 7])
def test_pack_round_trip(spark, window):
    out = packing.pack(documents(spark).repartition(3), window=window).collect()
    check_pack(TEXTS, out, window)


def test_pack_driver_documents(spark):
    docs = table(spark, SF, "documents")
    check_pack([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect(), 2048)
    assert packing.pack(empty_documents(spark)).collect() == []


# ---------------------------------------------------------------- 8: sharding
def brute_ring(ids, shards):
    import bisect
    import hashlib

    points = sharding.ring_points(shards)
    at = [p for p, _ in points]
    room = sharding.capacities(len(ids), shards)
    arcs = collections.Counter(bisect.bisect_left(at, int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)) % len(points) for i in ids)
    return points, arcs, room


def test_sharding_balance_and_homes(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = sharding.shard_rows(docs, 24).collect()
    counts = collections.Counter(r.shard for r in out)
    assert len(out) == 1000 and set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    points, arcs, room = brute_ring([r.doc_id for r in out], 24)
    homes = collections.Counter()
    for arc, n in arcs.items():
        homes[points[arc][1]] += n
    stay = collections.Counter(r.shard for r in out if r.shard == r.home_shard)
    for s in range(24):  # a shard is full of its own keys, or holds all of them
        assert stay[s] == min(homes[s], room[s])
    again = {r.doc_id: r.shard for r in sharding.shard_rows(docs.repartition(5), 24).collect()}
    assert again == {r.doc_id: r.shard for r in out}


def test_sharding_moves_few_rows_when_it_grows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    a = {r.doc_id: (r.shard, r.home_shard) for r in sharding.shard_rows(docs, 24).collect()}
    b = {r.doc_id: (r.shard, r.home_shard) for r in sharding.shard_rows(docs, 25).collect()}
    assert all(b[i][1] in (a[i][1], 24) for i in a)  # homes change only into the new shard
    assert sum(a[i][0] != b[i][0] for i in a) < 0.35 * len(a)  # a plain modulus moves 96 %


def test_walk_places_every_key():
    rnd = random.Random(1)
    for shards in (1, 3, 24):
        points = sharding.ring_points(shards, 8)
        counts = [rnd.choice([0, 0, 1, 50, 4000]) for _ in points]
        placed = sharding.walk(points, counts, shards)
        filled = collections.Counter()
        for arc, lo, hi, shard, first in placed:
            assert lo < hi
            filled[shard] += hi - lo
        assert [filled[s] for s in range(shards)] == sharding.capacities(sum(counts), shards)
        for arc, n in enumerate(counts):
            spans = sorted((lo, hi) for a, lo, hi, _, _ in placed if a == arc)
            assert sum(hi - lo for lo, hi in spans) == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def hot_rows():
    rnd = random.Random(12)
    rows = [(5, f"text {i}") for i in range(400)] + [(None, "same")] * 400 + [(rnd.randrange(10_000), f"t{rnd.randrange(50)}") for _ in range(400)]
    return rows


def brute_shards(rows, shards):
    """The shard of every row, rows of an arc in ring order (which of several identical rows goes where is open)."""
    import bisect
    import hashlib

    points = sharding.ring_points(shards)
    arcs = [[] for _ in points]
    for i, t in rows:
        raw = t.encode()
        at = int(hashlib.md5((str(i) if i is not None else "").encode()).hexdigest()[:15], 16)
        arcs[bisect.bisect_left([p for p, _ in points], at) % len(points)].append((at, i is not None, i or 0, zlib.crc32(raw), len(raw) + 8, i))
    out = collections.Counter()
    for arc in arcs:
        arc.sort(key=lambda r: r[:5])
    for arc, lo, hi, shard, first in sharding.walk(points, [len(a) for a in arcs], shards):
        out.update((arcs[arc][k][5], arcs[arc][k][4], arcs[arc][k][3], shard, first + k - lo) for k in range(lo, hi))
    return out


@pytest.mark.parametrize("piece_rows", [1 << 18, 64])
def test_sharding_hot_keys(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(sharding, "PIECE_ROWS", piece_rows)
    rows = hot_rows()
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 24).collect()
    assert collections.Counter((r.doc_id, r.text_crc32) for r in out) == collections.Counter((i, zlib.crc32(t.encode())) for i, t in rows)
    counts = collections.Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(counts[s])) for s in counts)
    if piece_rows == 1 << 18:  # one piece an arc: every shard and slot is settled
        assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out) == brute_shards(rows, 24)


def test_sharding_odd_rows(spark):
    out = sharding.shard_rows(documents(spark), 5).collect()
    assert len(out) == len(TEXTS)
    counts = collections.Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(5)) <= 1
    assert {(r.size, r.text_crc32) for r in out if r.doc_id in (3, 4)} == {(8, 0)}
    assert [r.size for r in out if r.doc_id == 7] == [len(LONG) + 8]
    assert sharding.shard_rows(empty_documents(spark)).collect() == []


# ---------------------------------------------------------------- 9: URLs
def brute_judge(url, rules, default="allow"):
    import re

    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules
            if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_judge(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/"), ("block", "a.com", ""), ("allow", "", "/"), ("block", "net", None), ("block", "x.y", "/z"), ("allow", "y", "/z/1")]
    urls = [None, "", "no scheme", "http://", "http://example.org", "https://www.EXAMPLE.org/es/1?x#y", "http://example.org/en/19", "http://badexample.org/es/",
            "ftp://a.com", "ftp://b.a.com?/de/", "http://q.com/de/x", "x://a://b.org/", "http://org/", "http://x.y/z/1", "http://h.com/FR/",
            "http://é.org/é", "http://host.org:80/", "http://u@example.org/es/\n", "http://net/", "http://.org/", "http://" + "s." * 200 + "org/" + "p" * 5000,
            "http://example.org/es/", "http://example.org/es/"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://org/x")], "page_id long, url string").withColumns(
        {c: F.lit("x") for c in ("host", "path", "rule", "verdict", "suffix", "digest")})
    out = {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, url_filter.rules_frame(spark, rules)).collect()}
    assert len(out) == len(urls) + 1
    for i, u in enumerate(urls):
        assert out[i] == brute_judge(u, rules), u
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark, rules)).collect() == []
    none = url_filter.judge(df, url_filter.rules_frame(spark, rules).limit(0), "block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")}


def test_one_text_of_each_labelled_id_reaches_the_driver(spark, monkeypatch):
    rows = [(i, f"text number {i}") for i in range(1, 41)] + [(1, f"other {j % 7}") for j in range(300)] + [(None, "no id")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, quality int")
    seen, fit = [], quality._fit_network
    monkeypatch.setattr(quality, "_fit_network", lambda x, y, vectors: seen.append((x, y)) or fit(x, y, vectors))
    for _ in range(2):
        quality.fit_quality(docs, labels, max_train=1000)
    trained = quality.training_rows(labels).collect()
    assert 1 in {r.doc_id for r in trained}
    assert len(seen[0][0]) == len(trained) and seen[0][1].sum() == sum(r.quality for r in trained)
    assert np.array_equal(seen[0][0], seen[1][0])
