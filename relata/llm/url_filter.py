"""URL filters by host-suffix and path-prefix expressions.

A rule is a host and the beginning of a path, with a verdict.  Each distinct
(host, path) is expanded into the expressions that could be rules: every
suffix of the host that starts at a label, with every path prefix of a length
that some rule has.  Expressions and rules are equi-joined on a short hash
prefix, confirmed by the full digest, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the hexadecimal digest that the join uses.
SHORT = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` rules as a table; larger rule sets come as a table of their own."""
    from relata.llm.common import rows_frame

    return rows_frame(spark, rules, "verdict string, host string, path string")


def _host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def _path(url):
    """From there up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict``.

    ``pages`` needs ``page_id`` and ``url``; other columns are ignored.  A rule
    fits its host and all subdomains where the path begins with the rule's.
    Of the rules that fit, the longest (host and path together) wins; of
    equally long ones the longer host, then ``block``.  Without one, ``rule``
    is null and the verdict ``default``.  A null url or one without ``://``
    has an empty host and path; rules with a null or empty host, or a null
    path, fit nothing.  Repeated rows come back as often as they occur.
    """
    pages = pages.select("page_id", _host(F.col("url").cast("string")).alias("host"), _path(F.col("url").cast("string")).alias("path"))
    rules = rules.filter("host <> '' AND path IS NOT NULL").select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"),
        F.sha2(F.concat("host", F.lit("\x00"), "path"), 256).alias("digest"))
    rules = rules.withColumn("short", F.substring("digest", 1, SHORT))
    lengths = [r[0] for r in rules.select(F.char_length("r_path")).distinct().collect()]  # few, whatever the number of rules
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = [F.when(F.char_length("path") >= n, F.expr(f"left(path, {int(n)})")) for n in sorted(lengths)]
    prefixes = F.filter(F.array(*cuts, F.lit(None).cast("string")), lambda p: p.isNotNull())
    urls = pages.filter("host <> ''").select("host", "path").distinct()
    tries = urls.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    tries = tries.withColumn("x_digest", F.sha2(F.concat("suffix", F.lit("\x00"), "prefix"), 256))
    fits = tries.join(rules, F.substring("x_digest", 1, SHORT) == F.col("short")).filter(F.col("x_digest") == F.col("digest"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        (F.char_length("r_host") + F.char_length("r_path")).alias("long"), F.char_length("r_host").alias("host_long"),
        (F.col("r_verdict") == "block").alias("blocks"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("w"))
    return pages.join(best.select("host", "path", "w.rule", "w.verdict"), ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
