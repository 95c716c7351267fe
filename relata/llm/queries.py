"""Registered queries of this subpackage: one thin query for each operator.

Each runs its operator with production parameters over its whole table.
``ORACLES`` holds DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


# ---------------------------------------------------------------- 10: n-gram Jaccard join
@register("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.ngram_join import ngram_join

    out, _ = ngram_join(table(spark, sf, "documents"), k=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id", "class_id")


# ---------------------------------------------------------------- 1: token counts
@register("op1_token_counts")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.token_counts import token_counts

    return token_counts(table(spark, sf, "documents"), rule="most")


# ---------------------------------------------------------------- 2: exact top-k search
@register("op2_exact_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.topk import exact_topk

    return exact_topk(table(spark, sf, "embeddings"), every=100, k=10)


# ---------------------------------------------------------------- 4: approximate nearest neighbours
@register("op4_ann_projection")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.ann import nearest

    return nearest(table(spark, sf, "embeddings"), every=50, k=5)


# ---------------------------------------------------------------- 5: mixing sources to target weights
#: Domains are languages: the labelled documents' ``lang`` is what a text tells about its source.
TARGETS = {"en": 0.5, "de": 0.175, "fr": 0.175, "es": 0.15}


def labelled_domains(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, domain)`` of the labelled documents."""
    return (table(spark, sf, "documents").select("doc_id", F.col("lang").alias("domain"))
            .join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi"))


@register("op5_soft_mixing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.mixing import rates_by_row

    docs = table(spark, sf, "documents")
    return rates_by_row(docs, docs, labelled_domains(spark, sf), TARGETS)


# ---------------------------------------------------------------- 6: quality classifier
@register("op6_quality_classifier")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.quality import quality_scores

    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


# ---------------------------------------------------------------- 7: packing
@register("op7_concat_and_cut")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.packing import pack

    return pack(table(spark, sf, "documents")).drop("ids")


# ---------------------------------------------------------------- 8: sharding
@register("op8_bounded_ring")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.sharding import shard_rows

    return shard_rows(table(spark, sf, "documents"), shards=24)


# ---------------------------------------------------------------- 9: URL filters
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@register("op9_url_filter", """
WITH rules(r_verdict, r_host, r_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
f AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host) + length(r_path)) AS rule,
    arg_max(r_verdict, length(r_host) + length(r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON u.host = f.host AND u.path = f.path
""")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.url_filter import judge, rules_frame

    return judge(table(spark, sf, "pages"), rules_frame(spark, URL_RULES))


# ---------------------------------------------------------------- 3: HTML extraction
@register("op3_tag_path_ratios")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.html_text import extract

    return extract(table(spark, sf, "pages"))


# ---------------------------------------------------------------- 11: personal data
@register("op11_skip_chain_pii")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.pii_crf import digests, find_spans

    return digests(find_spans(table(spark, sf, "documents")))


# ---------------------------------------------------------------- 12: filter interaction audit
@register("op12_filter_audit", """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copy
  FROM d),
l AS (SELECT doc_id AS id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
b AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN copy THEN 16 ELSE 0 END AS bits
  FROM w LEFT JOIN l ON w.doc_id = l.id),
c AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM b GROUP BY part, bits),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM x p, x q, x r, x s, x u
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5),
g AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS f,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INTEGER AS before
  FROM o, range(1, 6) r(step))
SELECT part, filter_order, step,
  CAST(sum(CASE WHEN bits & (f | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN bits & f <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN bits & f <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN bits = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN bits & f <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN bits & f <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN bits & f <> 0 THEN n * 120 // bit_count(bits) ELSE 0 END) AS BIGINT) AS shapley
FROM c, g GROUP BY part, filter_order, step
""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.filter_audit import audit

    return audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


# ---------------------------------------------------------------- 13: centroid clustering
def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain Lloyd rounds, each centroid compared with each vector."""
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS cluster, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), x) <= {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT r, cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i} c)
  GROUP BY r)""")
        if i < rounds:
            parts.append(f"""
s{i} AS (
  SELECT cluster, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(j) GROUP BY cluster, j),
c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.x, c{i}.x) AS x
  FROM c{i} LEFT JOIN (SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY j) AS x FROM s{i} GROUP BY cluster) m USING (cluster))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (cluster)"""


@register("op13_ptolemaic_clusters", _cluster_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from relata.llm.ptolemaic import cluster

    return cluster(table(spark, sf, "embeddings"))
