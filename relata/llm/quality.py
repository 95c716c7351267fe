"""Quality classifier: random-indexing word vectors, a two-layer numpy network, calibrated probabilities.

* Words are hashed into ``BUCKETS`` fixed entries.  Each entry has a sparse
  random index vector; its context vector is the sum of the index vectors of
  its neighbours (two on either side) over every document of the corpus.
* An entry's word vector is its index vector plus its normalised, centred
  context vector.  A document is the mean of its words' vectors, their spread
  around that mean and the logarithm of their number.
* A two-layer network (tanh, sigmoid) is trained on a bounded sample of
  labelled documents; a temperature fitted on a tenth of them calibrates the
  probabilities.

Both passes over the corpus run in Spark tasks; the driver holds the context
matrix (``BUCKETS * DIM`` numbers) and at most ``MAX_TRAIN`` pooled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.llm.common import dense_sum, free_name, lean, text_bytes

#: Word entries and dimensions: the vectors are 16,384 x 64, whatever the corpus.
BUCKETS = 1 << 14
DIM = 64
NONZERO = 2
WINDOW = 2
#: At most this many labelled documents train the network, lowest id hash first.
MAX_TRAIN = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3
CHUNK_CACHE = 200_000
PIECE = 1 << 16

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _entry(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) % BUCKETS


class _Chunks(dict):
    """White-space separated chunk -> its entries as packed int32; each task has its own, emptied when full.

    A word gives its lower-case form; a run of capitals and a run of
    punctuation give an entry each.
    """

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CHUNK_CACHE:
            self.clear()
        ids = []
        for t in _TOKEN.findall(chunk.decode("utf-8", "replace")):
            ids.append(_entry(t.lower()))
            if len(t) > 1 and t.isupper():
                ids.append(_entry("\x00capitals"))
        packed = self[chunk] = np.array(ids, np.int32).tobytes()
        return packed


_REPEAT = np.array([_entry("\x00repeat")], np.int32).tobytes()


def word_entries(raw: bytes | None, chunks: _Chunks) -> np.ndarray:
    """The entries of a whole text in order (empty for null); a chunk equal to the one before adds an entry for that."""
    packed = [chunks[c] for c in raw.split()] if raw else []
    for i in [i for i, (a, b) in enumerate(zip(packed, packed[1:]), 1) if a == b]:
        packed[i] += _REPEAT
    return np.frombuffer(b"".join(packed), np.int32)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero components of each entry's index vector."""
    rng = np.random.default_rng(20240601)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return at.astype(np.int64), rng.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.int64)


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all entries, summed over every document."""
    at, sign = index_vectors()
    width, chunks = BUCKETS * DIM, _Chunks()  # travels empty to each task

    def add(batch: pa.RecordBatch, acc: np.ndarray) -> None:
        gap = np.full(WINDOW, -1, np.int32)
        parts = [x for raw in text_bytes(batch, text) for x in (word_entries(raw, chunks), gap)]
        ids = np.concatenate(parts or [gap]).astype(np.int64)
        for lo in range(0, len(ids), 1 << 20):
            x = ids[lo:lo + (1 << 20) + WINDOW]
            for o in range(1, WINDOW + 1):
                a, b = x[:-o], x[o:]
                here = min(len(a), 1 << 20)
                a, b = a[:here], b[:here]
                ok = (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                for u, v in ((a, b), (b, a)):
                    for j in range(NONZERO):
                        k = u * DIM + at[v, j]
                        s = sign[v, j]
                        acc += np.bincount(k[s > 0], minlength=width) - np.bincount(k[s < 0], minlength=width)

    return dense_sum(docs.select(text), add, width).reshape(BUCKETS, DIM)


def word_vectors(context: np.ndarray) -> np.ndarray:
    at, sign = index_vectors()
    v = np.zeros((BUCKETS, DIM))
    v[np.arange(BUCKETS)[:, None], at] = sign / np.sqrt(NONZERO)
    c = context.astype(float)
    size = np.linalg.norm(c, axis=1, keepdims=True)
    c = np.divide(c, size, out=np.zeros_like(c), where=size > 0)
    used = size[:, 0] > 0
    if used.any():
        c[used] -= c[used].mean(axis=0)
    return (v + c).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean of the word vectors, spread around it, log of the number of words."""
    total, square = np.zeros(DIM), 0.0
    for lo in range(0, len(ids), PIECE):
        rows = vectors[ids[lo:lo + PIECE]]
        total += rows.sum(axis=0, dtype=np.float64)
        square += float(np.einsum("ij,ij->", rows, rows, dtype=np.float64))
    n = max(len(ids), 1)
    mean = total / n
    return np.concatenate([mean, [max(square / n - float(mean @ mean), 0.0), np.log1p(len(ids))]])


@dataclass
class QualityModel:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray) -> QualityModel:
    """Adam on cross entropy; one row in ten is kept for the temperature. Seeded: equal samples give equal models."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    if not len(x):
        return QualityModel(vectors, np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - shift) / scale
    cal = np.arange(len(z)) % 10 == 9
    fit = np.flatnonzero(~cal)
    p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(fit)
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for lo in range(0, len(order), 256):
            i = order[lo:lo + 256]
            h = np.tanh(z[i] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    model = QualityModel(vectors, shift, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if cal.any():
        logit, want = model.logits(x[cal]), y[cal]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logit / t) - want * logit / t) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def training_rows(labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One ``(doc_id, quality)`` per labelled document outside the held-out fifth, at most ``max_train``.

    Rows with a null id or a label that is not 0 or 1 are left out; of several
    labels for a document the smallest counts.
    """
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
            .filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out("doc_id"))
            .groupBy("doc_id").agg(F.min("quality").alias("quality"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> QualityModel:
    """Word vectors from all of ``docs``; the network from the bounded labelled sample."""
    vectors = word_vectors(context_vectors(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, sent = _Chunks(), set()  # a task pools a document once
        for b in (big.slice(at, 512) for big in batches for at in range(0, big.num_rows, 512)):
            new = [i not in sent and not sent.add(i) for i in b.column(0).to_pylist()]
            b = b.filter(pa.array(new, pa.bool_()))
            rows = [pooled(word_entries(raw, chunks), shared.value) for raw in text_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    # a document has one text, that of the smallest hash, however many rows repeat its id
    one = texts.join(F.broadcast(training_rows(labels, max_train)), "doc_id").groupBy("doc_id", "quality").agg(F.min("h").alias("h"))
    sample = texts.join(F.broadcast(one), ["doc_id", "h"]).select("doc_id", "quality", "text")
    pools = sample.mapInArrow(lean(pool), "doc_id long, quality int, x array<double>")
    got = pools.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("x").alias("x")).collect()
    got.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r.doc_id)), r.doc_id, r.x))
    x = np.array([r.x for r in got]).reshape(len(got), DIM + 2)
    return _fit_network(x, np.array([float(r.quality) for r in got]), vectors)


def score(docs: DataFrame, model: QualityModel, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 in ``column`` (0 to 1; empty and null texts too)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if column in docs.columns:
        docs = docs.drop(F.col(f"`{column}`"))
    # numbered names inside, since a caller's may hold dots
    names, plain = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at_text = plain[names.index(text)]
    numbered = docs.toDF(*plain)
    schema = T.StructType([*numbered.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, chunks = shared.value, _Chunks()
        for b in (big.slice(at, 512) for big in batches for at in range(0, big.num_rows, 512)):
            x = [pooled(word_entries(raw, chunks), m.vectors) for raw in text_bytes(b, at_text)]
            s = m.scores(np.array(x)) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "score"])

    return numbered.mapInArrow(lean(run), schema).toDF(*names, column)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``; only the text enters a score.

    Null and empty texts are scored like a text without words, repeated rows
    get equal scores, and a null doc_id counts as not held out.  Without any
    labelled document every score is 0.5.
    """
    model = fit_quality(docs, labels, max_train)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents whose score reaches ``threshold``; all columns kept."""
    name = free_name(docs, "quality_score")
    return score(docs, fit_quality(docs, labels, max_train), name).filter(F.col(name) >= threshold).drop(name)
