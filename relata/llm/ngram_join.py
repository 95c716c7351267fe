"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Documents with the same set of word n-grams form one class, so copies are
never paired.  The n-grams of a class are ordered rarest first by a count
table over the whole corpus (hashed into a fixed number of counters); two
classes whose similarity reaches the threshold share an n-gram among their
first ``n - ceil(t * n) + 1``.  Classes are joined on those, cut by

* the length filter (sizes within the threshold of each other),
* the positional filter (what can still be shared after this position),
* the suffix filter (parity bits of all n-grams bound the difference; then the
  whole prefixes must share what the suffixes cannot make up),

and what is left is verified with the whole sets, each pair once.  Pairs are
tried in two rounds: first each class against one hub of its list (the class
whose rarest n-gram is least rare, which is what copies of one original have
in common), then, exactly, every pair that the first round left in different
components.  A group of near copies therefore costs links in proportion to its
size, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import checkpoint, components, dense_sum, free_name, lean, split_words

#: The n-gram frequency table has 2^23 counters, one byte each (eight steps to a doubling): 8 MB for
#: every task, whatever the corpus.  The order they give is a heuristic; results do not depend on it.
COUNTERS_BITS = 23
#: Bits of the filter that tells which documents' sets are needed: 128 kB for every task.
FILTER_BITS = 20

_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_64 = (1 << 64) - 1
_PARITY = ("s0", "s1", "s2", "s3")


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(batch: pa.RecordBatch, k: int, column: str = "text") -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word k-grams, of the whole sequence where it has fewer words.

    Words are runs without ASCII white space, A-Z lower-cased (``bytes.lower``
    changes no other character).
    """
    words, index, counts = split_words(batch, column)
    hashes = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in words], np.uint64)
    at = 0
    for count in counts.tolist():
        w = hashes[index[at:at + count]]
        at += count
        n = min(k, count)
        if not n:
            yield np.empty(0, np.uint64)
            continue
        h = np.full(count - n + 1, np.uint64(n))
        for i in range(n):
            add, times = np.uint64(_M[i % 3] * (i + 1) & _64), np.uint64(_M[(i + 1) % 3] + 2 * i & _64)
            h += _spread(w[i:count - n + 1 + i] + add) * times
        yield np.unique(_spread(h))


def _fingerprint(grams: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_spread(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _digests(docs: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Per row: set size, fingerprint, parity bits, count of the rarest n-gram, rare-first prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(64 - COUNTERS_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                yield digest(b.slice(at, 512))

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        seen, out = shared.value, []
        for g in gram_sets(b, k):
            n = len(g)
            if not n:
                out.append((0, 0, 0, [0, 0, 0, 0], 0, g.view(np.int64)))
                continue
            c = seen[g >> shift]
            order = np.argsort(c, kind="stable")[:n - (percent * n + 99) // 100 + 1]
            parity = np.bincount((g & np.uint64(255)).astype(np.int64), minlength=256) & 1
            sig = np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()
            out.append((n, *_fingerprint(g), sig, int(c[order[0]]), g[order].view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array([r[i] for r in out], pa.int64()) for i in (0, 1, 2)),
             *(pa.array([r[3][i] for r in out], pa.int64()) for i in range(4)),
             pa.array([r[4] for r in out], pa.int64()), pa.array([r[5] for r in out], pa.list_(pa.int64()))],
            names=["doc_id", "n", "f1", "f2", "s0", "s1", "s2", "s3", "rare", "prefix"])

    return docs.mapInArrow(
        lean(run), "doc_id long, n long, f1 long, f2 long, s0 long, s1 long, s2 long, s3 long, rare long, prefix array<long>")


def _gram_counts(docs: DataFrame, k: int) -> np.ndarray:
    shift = np.uint64(64 - COUNTERS_BITS)

    def add(batch: pa.RecordBatch, acc: np.ndarray) -> None:
        for g in gram_sets(batch, k):  # two bytes a counter: a task's count stops at 65,535, the sums go on
            at = g >> shift
            acc[at] += acc[at] < 65_535

    def steps(sums: np.ndarray) -> np.ndarray:
        return np.minimum(8 * np.log2(1.0 + sums), 255)

    return dense_sum(docs.select("text"), add, 1 << COUNTERS_BITS, 1 << 16, np.uint16, steps, np.uint8)


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Whole sets ``(cid, mark, grams)`` of the documents ``cid`` in ``ids``, and of few others.

    A fixed-size bit filter of the ids keeps other texts out of the shuffle;
    the joins that follow are exact.  A task sends repeated rows once.
    """
    def note(batch: pa.RecordBatch, acc: np.ndarray) -> None:
        acc[_slot(batch.column(0).to_numpy(zero_copy_only=False), FILTER_BITS)] = 1

    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(dense_sum(ids, note, 1 << FILTER_BITS, task_type=np.int8) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, sent = np.unpackbits(bits.value).astype(bool), set()
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            b = b.filter(pa.array(filt[_slot(b.column(0).to_numpy(zero_copy_only=False), FILTER_BITS)], pa.bool_()))
            for at in range(0, b.num_rows, 256):
                c, rows = b.slice(at, 256), []
                for i, g in zip(c.column(0).to_pylist(), gram_sets(c, k)):
                    mark = _fingerprint(g)[0]
                    if (i, mark) not in sent:
                        sent.add((i, mark))
                        rows.append((i, mark, g.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["cid", "mark", "grams"])

    return docs.mapInArrow(lean(run), "cid long, mark long, grams array<long>")


def _need(na, nb, percent: int):
    """Shared n-grams that sets of these sizes need at least."""
    return F.ceil((na + nb) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _could_link(a: str, b: str, percent: int):
    """Length, positional and suffix filter on two postings of one n-gram."""
    na, nb, pa_, pb = (F.col(f"{x}.{y}") for x, y in ((a, "n"), (b, "n"), (a, "pos"), (b, "pos")))
    need = _need(na, nb, percent)
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)), F.lit(0))
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
            & (F.least(na - pa_, nb - pb) >= need)
            & (differ <= na + nb - need * 2))


def _with_prefix(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough.

    The n-grams after the prefix that ends first in the global order can meet
    at most themselves, so a pair that needs ``need`` shared n-grams shares at
    least ``need - max(n - prefix)`` of them within the prefixes.
    """
    sides = classes.select(F.col("cid"), F.col("f1"), "n", "prefix")
    both = (pairs.join(sides.toDF("a", "ma", "na", "xa"), ["a", "ma"]).join(sides.toDF("b", "mb", "nb", "xb"), ["b", "mb"]))
    after = F.greatest(F.col("na") - F.size("xa"), F.col("nb") - F.size("xb"))
    return both.filter(F.size(F.array_intersect("xa", "xb")) >= _need(F.col("na"), F.col("nb"), percent) - after).select("a", "ma", "b", "mb")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose whole sets reach the threshold, with the size of what they share.

    ``ma`` and ``mb`` in ``pairs`` tell a class from others of the same id.
    """
    sets = _sets_of(docs, pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), k)
    both = (pairs.join(sets.toDF("a", "ma", "ga"), ["a", "ma"]).join(sets.toDF("b", "mb", "gb"), ["b", "mb"]))
    shared = both.select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"),
                         F.size(F.array_intersect("ga", "gb")).alias("shared"))
    return shared.filter(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent).distinct()


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Link documents whose sets of word ``k``-grams have Jaccard similarity >= ``percent`` %.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Returns

    * per input row ``(doc_id, n_shingles, class_id, component_id)``: the size
      of its set, the smallest doc_id with the same set and the smallest doc_id
      reachable by links (itself included);
    * the verified links between classes ``(a, b, na, nb, shared)``.

    Null and blank texts have an empty set: they link with nothing, not even
    with each other.  Equal sets are one class.  Repeated rows come back as
    often as they occur; rows with equal doc_id and different texts are judged
    each by its own text.  A row without doc_id takes its component from the
    other rows of its class (null if there are none).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = checkpoint(_digests(docs, k, percent, _gram_counts(docs, k)))
    first = [F.first(c).alias(c) for c in ("n", *_PARITY, "rare", "prefix")]
    classes = checkpoint(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2")
                         .agg(F.min("doc_id").alias("cid"), *first))
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent))).cast("int")  # linked sizes lie in one band or two adjacent ones
    lists = classes.select("cid", "n", band.alias("band"), F.posexplode("prefix").alias("pos", "gram"))
    common = lists.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram")
    posts = checkpoint(lists.join(common, "gram", "left_semi"))
    around = posts.select("gram", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    met = around.groupBy("gram", "band").agg(F.count("*").alias("c")).filter("c > 1").select("gram", "band")
    posts = checkpoint(posts.join(met, ["gram", "band"], "left_semi").drop("band", "n")
                       .join(classes.select("cid", F.col("f1").alias("mark"), "n", "rare", *_PARITY), "cid"))

    def pairs_of(df: DataFrame) -> DataFrame:
        first = F.col("p.cid") < F.col("q.cid")
        return df.select(*(F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (
            ("p.cid", "q.cid", "a"), ("p.mark", "q.mark", "ma"), ("q.cid", "p.cid", "b"), ("q.mark", "p.mark", "mb")))).distinct()

    best = F.max(F.struct("rare", -F.col("cid"), "cid", "mark", "n", "pos", *_PARITY)).alias("h")
    hubs = checkpoint(posts.groupBy("gram").agg(best).select("gram", "h.*"))
    near = _could_link("p", "q", percent)
    tried = pairs_of(posts.alias("p").join(hubs.alias("q"), "gram").filter(F.col("p.cid") != F.col("q.cid")).filter(near))
    tried = checkpoint(_with_prefix(tried, classes, percent))
    links = checkpoint(_verified(tried, docs, k, percent))

    label = components(links)
    named = posts.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    of_hub = hubs.select("gram", "cid").join(label.withColumnRenamed("node", "cid"), "cid", "left").select(
        "gram", F.coalesce("label", "cid").alias("hub"))
    named = named.join(of_hub, "gram")
    apart = named.filter("label <> hub")
    mixed = checkpoint(named.join(apart.select("gram").distinct(), "gram", "left_semi"))
    rest = (mixed.filter("label <> hub").alias("p").join(mixed.alias("q"), "gram")
            .filter((F.col("p.label") != F.col("q.label")) & ((F.col("q.label") == F.col("q.hub")) | (F.col("p.cid") < F.col("q.cid"))))
            .filter(near))
    rest = checkpoint(_with_prefix(pairs_of(rest).join(tried, ["a", "ma", "b", "mb"], "left_anti"), classes, percent))
    more = checkpoint(_verified(rest, docs, k, percent))
    links = links.union(more)
    label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more.select("a", "b")))

    placed = (classes.select("f1", "f2", "cid").join(label.withColumnRenamed("node", "cid"), "cid", "left")
              .select("f1", "f2", "cid", F.coalesce("label", "cid").alias("component")))
    empty = F.col("n") == 0
    out = rows.select("doc_id", "n", "f1", "f2").join(placed, ["f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("cid")).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    return out, links


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, repeats: bool = True) -> DataFrame:
    """One row of each group of near copies, the first by (doc_id, hash of the text); all columns kept.

    Rows are judged each by its own text, whatever their doc_id: rows without
    one come last in their group.  Rows equal in doc_id and text to the one
    that stays also stay, unless ``repeats`` is false.  Rows without words are
    nobody's copy and stay.
    """
    mark, ident, times = (free_name(docs, x) for x in ("__mark", "__ident", "__times"))
    text = docs["text"].cast("string")
    marked = docs.withColumns({mark: F.when(text.rlike(r"[^ \t\n\x0B\f\r]"), F.xxhash64(text)), ident: docs["doc_id"].cast("long")})
    words = marked.filter(F.col(mark).isNotNull())
    # the hash of the text is the row's id in the join, so that no two texts share one
    found, _ = ngram_join(words.select(F.col(mark).alias("doc_id"), text.alias("text")), k, percent)
    place = found.select(F.col("doc_id").alias("mark"), "component_id").distinct()
    rows = words.groupBy(F.col(mark).alias("mark"), F.col(ident).alias("ident")).agg(F.count("*").alias("times"))
    of_text = rows.groupBy("mark").agg(F.min(F.struct(F.col("ident").isNull().alias("none"), "ident", "times")).alias("r"))
    first = of_text.join(place, "mark").groupBy("component_id").agg(F.min(F.struct("r.none", "r.ident", "mark", "r.times")).alias("w"))
    first = checkpoint(first.select(F.col("w.mark").alias("mark"), F.col("w.ident").alias("ident"), F.col("w.times").alias(times)))

    of = [free_name(marked, x) for x in ("__of_mark", "__of_ident")]
    met = (F.col(mark) == F.col(of[0])) & F.col(ident).eqNullSafe(F.col(of[1]))
    kept = marked.join(first.toDF(*of, times), met, "left").filter(F.col(mark).isNull() | F.col(times).isNotNull())
    if not repeats and not first.filter(F.col(times) > 1).isEmpty():
        repeated = kept.filter(F.col(times) > 1).dropDuplicates([mark, ident])  # combined before the shuffle
        kept = kept.filter(F.col(times).isNull() | (F.col(times) == 1)).union(repeated)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
