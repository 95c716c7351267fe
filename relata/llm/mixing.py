"""Soft-membership mixing: domain posteriors from a labelled table, document rates by projected gradient.

DataFrame operations only.

1. A naive Bayes classifier over hashed words is counted from a bounded sample
   of the labelled documents; its weights are ``FEATURES`` rows, which every
   task gets.  Each document's posterior over the domains uses the mean word
   score, sharpened by at most ``SHARPNESS`` words, so memberships stay soft.
2. With ``m`` the tokens of a document, ``p`` its posterior and ``T`` the
   present domain totals, rates ``x >= least`` minimise
   ``sum_d (sum_i m_i p_id x_i - t_d)^2 / T_d`` by projected gradient from
   ``x = 1``, in the metric that weighs documents by their tokens.  There the
   largest curvature is exactly 1, so the step is 1.  Each step is one
   distributed sum of as many numbers as there are domains.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.llm.common import checkpoint, free_name

#: Rows of the word table that every task gets.
FEATURES = 4096
#: At most this many labelled documents are counted, lowest id hash first.
MAX_TRAIN = 20_000
SHARPNESS = 8
ROUNDS = 100
#: The fit ends at this loss per token, or when a step lowers the loss by less than this part.
TOLERANCE = 1e-12
STALL = 1e-4


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != "")


def _feature(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FEATURES))


def _known(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash that tells texts of one id apart, and the words; nulls are empty texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), _words(text).alias("words"))


def word_weights(docs: DataFrame, labelled: DataFrame, domains: list[str], max_train: int = MAX_TRAIN) -> tuple[DataFrame, list[float]]:
    """``FEATURES`` rows of log word probabilities ``w0, w1, ...`` per domain, and the log priors.

    ``labelled`` holds ``(doc_id, domain)``; null ids and other domains are
    left out, and of several domains of a document the first in order counts.
    """
    sample = (labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
              .filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
              .groupBy("doc_id").agg(F.min("domain").alias("domain"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = _known(docs).join(F.broadcast(sample), "doc_id").select("domain", F.explode_outer("words").alias("word"))
    counts = checkpoint(rows.filter("word IS NOT NULL").groupBy(_feature(F.col("word")).alias("feature")).agg(
        *(F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains))))
    total = counts.agg(*(F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(domains)))).first()
    have = dict(sample.groupBy("domain").count().collect())
    every = sum(have.values()) + len(domains)
    full = counts.sparkSession.range(FEATURES).withColumnRenamed("id", "feature").join(counts, "feature", "left")
    weights = full.select("feature", *(
        F.log((F.coalesce(F.col(f"c{i}"), F.lit(0)) + 0.5) / F.lit(float(total[i]) + 0.5 * FEATURES)).alias(f"w{i}")
        for i in range(len(domains))))
    return weights, [((have.get(d, 0) + 1) / every) for d in domains]


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[float]) -> DataFrame:
    """Distinct ``(doc_id, h)`` with ``n`` words, ``copies`` of the row and posteriors ``p0, p1, ...``.

    Words are scored and summed where they are read; only one row per document
    is shuffled.  A document without words has the priors.
    """
    k = len(priors)
    words = _known(docs).select("doc_id", "h", F.size("words").alias("n"), F.explode_outer("words").alias("word"))
    scored = words.select("doc_id", "h", "n", _feature(F.col("word")).alias("feature")).join(F.broadcast(weights), "feature", "left")
    sums = scored.groupBy("doc_id", "h", "n").agg(F.count("*").alias("hits"), *(F.avg(f"w{i}").alias(f"s{i}") for i in range(k)))
    sharp = F.least(F.col("n"), F.lit(SHARPNESS))
    logs = [F.log(F.lit(priors[i])) + sharp * F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(k)]
    top = F.greatest(*logs) if k > 1 else logs[0]
    sums = sums.select("doc_id", "h", "n", (F.col("hits") / F.greatest(F.col("n"), F.lit(1))).cast("long").alias("copies"),
                       *(F.exp(x - top).alias(f"e{i}") for i, x in enumerate(logs)))
    norm = reduce(lambda a, b: a + b, (F.col(f"e{i}") for i in range(k)))
    return sums.select("doc_id", "h", "n", "copies", *((F.col(f"e{i}") / norm).alias(f"p{i}") for i in range(k)))


def fit_rates(members: DataFrame, weights: list[float], least: float = 0.0, total: float | None = None) -> DataFrame:
    """``members`` with the column ``rate``; see the module's text.

    ``total`` is the number of tokens wanted; by default the smallest at which
    no domain has to shrink.  A domain that no document belongs to cannot be
    filled and is left out of the fit.
    """
    k = len(weights)
    members = checkpoint(members)
    mass = F.col("n").cast("double") * F.col("copies")

    def totals(df: DataFrame, rate: Column) -> list[float]:
        r = df.agg(*(F.coalesce(F.sum(mass * F.col(f"p{i}") * rate), F.lit(0.0)) for i in range(k))).first()
        return [float(v) for v in r]

    now = totals(members, F.lit(1.0))
    share = [w / sum(weights) for w in weights]
    if total is None:
        total = max((t / s for t, s in zip(now, share) if s > 0), default=0.0)
    fitted = members.withColumn("rate", F.greatest(F.lit(1.0), F.lit(float(least))))
    if not any(now):
        return fitted
    last = math.inf
    for step in range(1, ROUNDS + 1):
        got = totals(fitted, F.col("rate"))
        pull = [(g - s * total) / t if t > 0 else 0.0 for g, s, t in zip(got, share, now)]
        loss = sum(p * p * t for p, t in zip(pull, now))
        if loss <= TOLERANCE * total or last - loss <= STALL * loss:
            break
        last = loss
        move = reduce(lambda a, b: a + b, (F.col(f"p{i}") * F.lit(p) for i, p in enumerate(pull)))
        fitted = fitted.withColumn("rate", F.greatest(F.col("rate") - move, F.lit(float(least))))
        if step % 10 == 0:
            fitted = checkpoint(fitted)
    return checkpoint(fitted)


def mixing_rates(docs: DataFrame, labelled_docs: DataFrame, labelled: DataFrame, targets: dict[str, float],
                 least: float = 0.0, total: float | None = None) -> DataFrame:
    """Distinct ``(doc_id, h, n, copies, p0.., rate)`` of ``docs`` for the target weights of the domains.

    ``labelled_docs`` (``doc_id``, ``text``) holds the texts of ``labelled``.
    """
    domains = sorted(targets)
    weights, priors = word_weights(labelled_docs, labelled, domains)
    return fit_rates(posteriors(docs, checkpoint(weights), priors), [float(targets[d]) for d in domains], least, total)


def rates_by_row(docs: DataFrame, labelled_docs: DataFrame, labelled: DataFrame, targets: dict[str, float],
                 least: float = 0.0, total: float | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, domain, rate, p_<domain> ...``.

    Null and empty texts have no tokens and the prior memberships; repeated
    rows come back as often as they occur, with equal rates; a null doc_id
    stays null.  ``domain`` is the most likely one (the first, if tied).
    """
    domains = sorted(targets)
    rates = mixing_rates(docs, labelled_docs, labelled, targets, least, total)
    top = F.greatest(*(F.col(f"p{i}") for i in range(len(domains)))) if len(domains) > 1 else F.col("p0")
    domain = F.coalesce(*(F.when(F.col(f"p{i}") == top, F.lit(d)) for i, d in enumerate(domains)))
    out = rates.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)))))
    return out.select("doc_id", F.col("n").cast("long").alias("n_tokens"), domain.alias("domain"), "rate",
                      *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)))


def mix(docs: DataFrame, labelled_docs: DataFrame, labelled: DataFrame, targets: dict[str, float],
        least: float = 0.0, total: float | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part always, one more by a hash of id and text.

    With ``least=1`` every document stays and small domains are repeated.
    """
    rates = mixing_rates(docs, labelled_docs, labelled, targets, least, total)
    draw = F.pmod(F.xxhash64("doc_id", "h", F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times, key, mark = free_name(docs, "times"), free_name(docs, "mix_id"), free_name(docs, "mix_h")
    rates = rates.select(F.col("doc_id").alias(key), F.col("h").alias(mark), F.floor(F.col("rate") + draw).cast("int").alias(times))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = docs["doc_id"].cast("long").eqNullSafe(rates[key]) & (F.xxhash64(text) == rates[mark])
    return (docs.join(rates, on).filter(F.col(times) > 0)
            .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns)))
