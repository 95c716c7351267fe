"""Personal data: base patterns, and a skip-chain conditional random field over each document's mentions.

Mentions are the words that hold a digit or an ``@``.  Each has a label: none,
email, ip, card or phone.  The field's potentials are

* node features (shape, digit count, check sum, the words beside it),
* chain edges between mentions that are neighbouring words,
* skip edges between distant mentions of a document that are equal or similar
  (the same last digits, or the same letters and digits before an ``@``); each
  is tied to the next of its kind, so a token that occurs n times makes n - 1
  edges.

Weights, those of the edges included, are learned by pseudo-likelihood from
the labels that the base patterns give to a bounded sample of mentions (one
that they leave but that a skip edge ties to one they take has no label).  At
inference base spans are evidence; loopy sum-product messages over chain and
skip edges carry them to the other mentions of the document.  A mention that
the patterns miss (``555-7713`` beside an earlier ``+1 (017) 555-7713``, a card
number with digits beside it) becomes a span ``like_<kind>`` if its marginal
reaches ``CERTAIN`` and a skip edge ties it to a mention of that kind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import lean

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
#: Mentions whose hash is smallest train the field; nothing else is sampled.
MAX_TRAIN = 50_000
BUCKETS = 1 << 12
FEATURES = 12
CERTAIN = 0.6
ROUNDS = 12
EVIDENCE = 60.0
#: Prior mean of the skip weights: equal or similar mentions have one label, before any data.
AGREE = 3.0
#: Characters of text handled at a time; a longer document is handled by itself.
SLICE_CHARS = 1 << 22

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can only begin where a run of digits begins: what fails there fails inside the run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]++")
_MENTION = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NOT_PLAIN = re.compile(r"[^a-z0-9]+")
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "+@")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base patterns, each kind leftmost without overlap; time linear in the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        left = text[free:at]  # no part of a match, and without an @
        start = free + len(left.rstrip(_LOCAL))
        if m and start < at:
            out.append((start, 0, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(word: str) -> str:
    """Runs of digits by their length, runs of letters as one letter, other characters as they are; bounded."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 20)}d", word))[:40]


def _bucket(kind: str, value) -> int:
    return zlib.crc32(f"{kind} {value}".encode("utf-8", "surrogatepass")) % BUCKETS


@lru_cache(maxsize=20_000)  # of bounded strings
def _features(core: str, tail: str, before: str, after: str) -> list[int]:
    digits = _NOT_DIGIT.sub("", core) if len(core) <= 64 else ""
    parts = [("shape", _shape(core)), ("digits", len(digits)), ("luhn", 12 <= len(digits) <= 19 and luhn(digits)),
             ("at", "@" in core), ("dots", min(core.count("."), 5)), ("plus", core.startswith("+")),
             ("long", min(len(core) // 8, 8)), ("before", _shape(before)), ("after", _shape(after)),
             ("head", _shape(core[:3])), ("tail", _shape(tail))]
    return [0] + [_bucket(*p) or 1 for p in parts]


class Graph:
    """The mentions of some documents with features, evidence and edges; documents never share an edge."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.features: list[list[int]] = []
        self.label: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        last: dict[str, int] = {}
        word_before, mention_before, at_base, reach = "", -2, 0, []
        words = _WORD.finditer(text)
        m = next(words, None)
        number = 0
        while m:
            after = next(words, None)
            if _MENTION.search(m[0]):
                core = m[0].strip(_OUTER)
                start = m.start() + m[0].find(core) if core else m.start()
                end = start + len(core or m[0])
                while at_base < len(base) and base[at_base][0] < end:
                    reach.append(base[at_base])
                    at_base += 1
                reach = [b for b in reach if b[2] > start]
                node = len(self.spans)
                self.spans.append((doc, start, end))
                self.label.append(min((b[1] for b in reach if b[0] < end), default=-1) + 1)
                self.features.append(_features(core[:65], core[-3:], word_before[-24:], after[0][:24] if after else ""))
                if mention_before == number - 1:
                    self.chain.append((node - 1, node))
                for key in self._keys(core):
                    if key in last and (node - 1 != last[key] or mention_before != number - 1):
                        self.skip.append((last[key], node))
                    last[key] = node
                mention_before = number
            word_before, m = m[0], after
            number += 1

    @staticmethod
    def _keys(core: str) -> set[str]:
        """What tells that two mentions are equal or similar."""
        keys = set()
        digits = _NOT_DIGIT.sub("", core)
        if len(digits) >= 6:
            keys.add("d" + digits[-6:])
        plain = _NOT_PLAIN.sub("", core.split("@")[0].lower())
        if len(plain) >= 4 and not plain.isdigit():
            keys.add("p" + plain[:200] + (str(zlib.crc32(plain.encode())) if len(plain) > 200 else ""))
        return keys

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        def edges(e):
            return np.array(e, np.int64).reshape(-1, 2)

        return np.array(self.features, np.int64).reshape(-1, FEATURES), np.array(self.label, np.int64), edges(self.chain), edges(self.skip)


class Field:
    """Weights of the field: ``w`` per feature and label, ``c`` from a mention to the next, ``s`` (symmetric) along skip edges."""

    def __init__(self) -> None:
        self.w, self.c, self.s = np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), AGREE * np.eye(LABELS)

    def fit(self, x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, skip: np.ndarray,
            steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> Field:
        """Pseudo-likelihood: each mention's label given its features and its neighbours' labels.

        ``left`` and ``right`` are neighbours' labels (-1: none), ``skip`` counts
        the labels at the other ends of its skip edges.  Adam, full batch.
        """
        n = len(y)
        if not n:
            return self
        one = np.eye(LABELS)
        prev, nxt, truth = np.vstack([one, np.zeros(LABELS)])[left], np.vstack([one, np.zeros(LABELS)])[right], one[y]
        params, means = [self.w, self.c, self.s], [0, 0, AGREE * np.eye(LABELS)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            z = self.w[x].sum(axis=1) + prev @ self.c + nxt @ self.c.T + skip @ self.s
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            d = (p / p.sum(axis=1, keepdims=True) - truth) / n
            gw = np.stack([np.bincount(x.ravel(), np.repeat(d[:, k], x.shape[1]), BUCKETS) for k in range(LABELS)], axis=1)
            gs = skip.T @ d
            for i, g in enumerate((gw, prev.T @ d + (nxt.T @ d).T, (gs + gs.T) / 2)):
                g = g + decay * (params[i] - means[i])
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def marginals(self, x: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Label probabilities after loopy sum-product; mentions with a base label are evidence."""
        unary = self.w[x].sum(axis=1)
        known = np.flatnonzero(label)
        unary[known] = -EVIDENCE
        unary[known, label[known]] = 0
        src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        kind = np.repeat([0, 1, 2], [len(chain), len(chain), 2 * len(skip)])
        back = np.concatenate([len(chain) + np.arange(len(chain)), np.arange(len(chain)),
                               2 * len(chain) + len(skip) + np.arange(len(skip)), 2 * len(chain) + np.arange(len(skip))])
        pots = np.stack([self.c, self.c.T, self.s])
        message = np.zeros((len(src), LABELS))
        for _ in range(ROUNDS if len(src) else 0):
            new = np.empty_like(message)
            total = unary + self._received(message, dst, len(x))
            for lo in range(0, len(src), 65_536):  # bounded memory
                part = slice(lo, lo + 65_536)
                out = (total[src[part]] - message[back[part]])[:, :, None] + pots[kind[part]]
                new[part] = np.logaddexp.reduce(out, axis=1)
            new -= new.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        total = unary + self._received(message, dst, len(x))
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)

    @staticmethod
    def _received(message: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(dst, message[:, k], n) for k in range(LABELS)], axis=1)

    def added(self, graph: Graph) -> list[tuple[int, int, int, int]]:
        """``(document, start, kind number, end)`` of the spans beyond the base patterns, neighbours of one kind joined."""
        x, label, chain, skip = graph.arrays()
        if not len(x) or not len(skip):
            return []
        p = self.marginals(x, label, chain, skip)
        best, sure = p.argmax(axis=1), p.max(axis=1) >= CERTAIN
        a, b = skip[:, 0], skip[:, 1]
        tied = np.zeros(len(x), bool)
        agree = (best[a] == best[b]) & (best[a] > 0)
        reached = np.zeros(len(x), bool)
        reached[label > 0] = True
        while True:  # spread along agreeing skip edges from the evidence
            go = agree & (reached[a] != reached[b])
            if not go.any():
                break
            reached[a[go]] = reached[b[go]] = True
        tied[a[agree]] = tied[b[agree]] = True
        new = np.flatnonzero((label == 0) & (best > 0) & sure & tied & reached)
        beside, out = {int(v): int(u) for u, v in chain}, []
        place: dict[int, int] = {}
        for i in new.tolist():
            doc, start, end = graph.spans[i]
            j = place.get(beside.get(i, -1))
            if j is not None and out[j][2] == best[i]:
                out[j] = (doc, out[j][1], out[j][2], end)
                place[i] = j
            else:
                place[i] = len(out)
                out.append((doc, start, int(best[i]), end))
        return [(d, s, k - 1, e) for d, s, k, e in out]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, str]]:
    """Row number and text of the rows that hold a digit or an @; texts that are not UTF-8 are decoded with replacements."""
    col = batch.column(batch.schema.get_field_index(column))
    raw = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    some = pc.fill_null(pc.match_substring_regex(raw, "[0-9@]"), False)
    for i in np.flatnonzero(some.to_numpy(zero_copy_only=False)).tolist():
        yield i, raw[i].as_py().decode("utf-8", "replace")


def _graphs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[Graph, list[tuple[int, list[tuple[int, int, int]]]]]]:
    graph, docs, size = Graph(), [], 0
    for i, text in _texts(batch, column):
        base = base_spans(text)
        graph.add(i, text, base)
        docs.append((i, base))
        size += len(text)
        if size > SLICE_CHARS:
            yield graph, docs
            graph, docs, size = Graph(), [], 0
    yield graph, docs


def fit_field(docs: DataFrame, max_train: int = MAX_TRAIN) -> Field:
    """The field of the ``max_train`` mentions with the smallest hashes; base patterns give the labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for graph, _ in _graphs(b, "text"):
                x, y, chain, skip = graph.arrays()
                left, right, seen = np.full(len(y), -1), np.full(len(y), -1), np.zeros((len(y), LABELS), np.int64)
                left[chain[:, 1]], right[chain[:, 0]] = y[chain[:, 0]], y[chain[:, 1]]
                # a mention that the patterns leave, but that equals one they take, is unlabelled, not a "none"
                a, b = skip[(y[skip[:, 0]] > 0) == (y[skip[:, 1]] > 0)].T
                np.add.at(seen, a, np.eye(LABELS, dtype=np.int64)[y[b]])
                np.add.at(seen, b, np.eye(LABELS, dtype=np.int64)[y[a]])
                unlabelled = np.zeros(len(y), bool)
                for a, b in (skip.T, skip.T[::-1]):
                    unlabelled[a[(y[a] == 0) & (y[b] > 0)]] = True
                rows = np.concatenate([y[:, None], left[:, None], right[:, None], seen, x], axis=1)[~unlabelled]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel().astype(np.int32)))],
                    names=["m"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "m array<int>")
    # equal mentions are one training row with its count, so that a hot document does not fill the sample
    rows = found.groupBy("m").agg(F.count("*").alias("times")).orderBy(F.xxhash64("m"), "m").limit(max_train).collect()
    if not rows:
        return Field()
    m = np.array([r.m for r in rows], np.int64)
    return Field().fit(m[:, 3 + LABELS:], m[:, 0], m[:, 1], m[:, 2], m[:, 3:3 + LABELS].astype(float))


def find_spans(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: ``doc_id``, ``base`` and ``added``, arrays of ``(kind, start, end)`` in code points, end exclusive.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  ``base``
    holds the spans of the patterns in order of start, then kind; ``added`` those of the
    field, whose kinds are ``like_email``, ``like_ip``, ``like_card`` and
    ``like_phone``.  Null, empty and blank texts have none.  Each input row is
    judged by itself, also where rows or ids repeat; a null doc_id stays null.
    An empty table gives no rows, and without any mention nothing is added.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_field(docs, max_train))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, added = [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for graph, some in _graphs(b, "text"):
                for i, spans in some:
                    base[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
                for i, s, k, e in shared.value.added(graph):
                    added[i].append({"kind": f"like_{KINDS[k]}", "start": s, "end": e})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))],
                                             names=["doc_id", "base", "added"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.mapInArrow(lean(run), f"doc_id long, base {kind}, added {kind}")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of the spans of ``find_spans``."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat(
            s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")

    order = {k: i for i, k in enumerate([*KINDS, *(f"like_{k}" for k in KINDS)])}
    place = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    every = F.concat("base", "added")
    ordered = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(
        s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined(ordered).alias("spans"))
