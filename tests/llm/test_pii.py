"""Personal data: base patterns against plain regular expressions, and what the field adds."""

import collections
import hashlib
import os
import random
import re
import sys
import time

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import documents, empty_documents  # noqa: E402

from relata.llm import pii_crf  # noqa: E402
from relata.llm.common import table  # noqa: E402

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0


def brute(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def card(rnd):
    d = "".join(rnd.choice("0123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_base_spans_match_plain_patterns():
    rnd = random.Random(11)
    bits = ["a", "B.c", "@", "@x", ".", "..", "1", "25", "256", "007", "+", "+1", "(", ")", "-", " ", "%", "_", "x@y.z", "1.2.3.4", "é", "😀", "中", "\n"]
    for _ in range(30_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 24)))
        if rnd.random() < 0.3:
            text += card(rnd)
        assert pii_crf.base_spans(text) == brute(text), text


def test_base_spans_take_linear_time():
    start = time.time()
    for bit in ("a", "1", "1.", "1 ", "+1 ", "@", "a@", "a@b", "a@b.", "+1(", "1-", "+", ".", "1.1.1."):
        pii_crf.base_spans(bit * (1_000_000 // len(bit)))
    assert time.time() - start < 30


def corpus(n=400):
    rnd = random.Random(5)
    words = "the of and in to was for on that with".split()
    rows = []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(60)]
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(60)] = rnd.choice([card(rnd), f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}",
                                               f"{rnd.choice(words)}.{rnd.randrange(10, 99)}@mail{rnd.randrange(9)}.example.com",
                                               ".".join(str(rnd.randrange(256)) for _ in range(4)), str(rnd.randrange(3000)),
                                               "".join(rnd.choice("123456789") for _ in range(16)), f"{rnd.randrange(1900, 2020)}-{rnd.randrange(1900, 2020)}"])
            if rnd.random() < 0.3:
                t.insert(rnd.randrange(len(t)), rnd.choice([w for w in t if re.search("[0-9]", w)] or ["x"]))
        rows.append((i, " ".join(t)))
    return rows


def test_skip_edges_carry_labels(spark):
    rnd = random.Random(6)
    c = card(rnd)
    planted = [
        (1000, f"pay with {c} or so. Later the same card 12 {c} again"),  # digits before it hide the second from the patterns
        (1001, "call +1 (017) 555-7713 today, that is 555-7713 for short, yes"),
        (1002, "room 5559 is to let, and 5559 is not"),
        (1003, "from 1999-2004 and again 1999-2004, see 3.12. and 3.12."),
        (1004, "no. 1234567890123456 and again 1234567890123456"),  # fails the check sum twice
    ]
    docs = spark.createDataFrame(corpus() + planted, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii_crf.find_spans(docs).collect()}
    text = dict(planted)
    got = {i: [(a.kind, text[i][a.start:a.end]) for a in rows[i].added] for i in text}
    assert got == {1000: [("like_card", c)], 1001: [("like_phone", "555-7713")], 1002: [], 1003: [], 1004: []}
    assert all([(s.start, pii_crf.KINDS.index(s.kind), s.end) for s in rows[i].base] == brute(t) for i, t in corpus() + planted)


def exact_marginals(field, x, label, chain, skip):
    import itertools

    unary = field.w[x].sum(axis=1)
    p = np.zeros((len(x), pii_crf.LABELS))
    for ys in itertools.product(range(pii_crf.LABELS), repeat=len(x)):
        if any(k and y != k for y, k in zip(ys, label)):
            continue
        s = sum(0 if k else u[y] for u, y, k in zip(unary, ys, label))
        s += sum(field.c[ys[a], ys[b]] for a, b in chain) + sum(field.s[ys[a], ys[b]] for a, b in skip)
        for i, y in enumerate(ys):
            p[i, y] += np.exp(s)
    return p / p.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees():
    rnd = np.random.default_rng(2)
    field = pii_crf.Field()
    field.w[:] = rnd.normal(size=field.w.shape) / 3
    field.c[:] = rnd.normal(size=field.c.shape)
    s = rnd.normal(size=field.s.shape)
    field.s[:] = s + s.T
    x = rnd.integers(0, pii_crf.BUCKETS, (6, pii_crf.FEATURES))
    chain, skip = np.array([[0, 1], [2, 3]]), np.array([[1, 4], [3, 5], [0, 2]])
    label = np.array([0, 0, 0, 0, 2, 0])
    rounds, pii_crf.ROUNDS = pii_crf.ROUNDS, 60
    try:
        got = field.marginals(x, label, chain, skip)
    finally:
        pii_crf.ROUNDS = rounds
    assert np.allclose(got, exact_marginals(field, x, label, chain, skip), atol=1e-6)


def test_repeated_tokens_make_one_edge_each():
    g = pii_crf.Graph()
    g.add(0, "555-1234 x " * 2000, [])
    assert len(g.spans) == 2000 and len(g.skip) == 1999 and not g.chain
    assert pii_crf.Field().added(g) == []


def test_query_digests(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = pii_crf.digests(pii_crf.find_spans(docs)).collect()
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(text)
    more = collections.Counter()
    for r in rows:
        base = [f"{pii_crf.KINDS[k]}:{s}:{e}" for s, k, e in brute(text[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii_crf.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("like_")] == base
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        more.update(s.split(":")[0] for s in spans if s.startswith("like_"))
        for kind, s, e in (x.split(":") for x in spans if x.startswith("like_")):
            print(kind, text[r.doc_id][int(s):int(e)])
    print(more)


def test_odd_rows(spark):
    assert pii_crf.digests(pii_crf.find_spans(empty_documents(spark))).collect() == []
    rows = pii_crf.digests(pii_crf.find_spans(documents(spark))).collect()
    assert len(rows) == 12 and sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 6 for r in rows) == 2
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id in (3, 4, 5, 6))
    long = spark.createDataFrame([(1, "7 " * 200_000), (2, "a@b.cd " * 50_000), (3, "\x00 1.2.3.4")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii_crf.digests(pii_crf.find_spans(long)).collect()}
    assert (got[1].n_card, got[2].n_email, got[3].n_ip) == (0, 50_000, 1)


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(unhex('ff20612e3140622e6364ff') AS STRING) AS text")
    r = pii_crf.digests(pii_crf.find_spans(docs)).first()
    assert r.n_email == 1 and r.spans == "email:2:10"


if __name__ == "__main__":
    pytest.main([__file__])
