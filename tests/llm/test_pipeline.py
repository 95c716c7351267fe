"""Registered queries against their SQL, and the pipeline stage by stage against brute force."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from helpers import documents  # noqa: E402
from test_ngram_join import brute  # noqa: E402
from test_operators import check_pack  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from oracle_check import rows_of  # noqa: E402
from relata.llm import queries, quality  # noqa: E402
from relata.llm.common import table  # noqa: E402
from relata.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 4


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
        held[name] = (before, docs)
    before, after = held["quality"]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(before, table(spark, SF, "labels")).collect()}
    kept = {r.doc_id for r in after.collect()}
    assert kept == {i for i, p in scores.items() if p}
    good = [i for i in labels if labels[i] == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)

    before, after = held["near_duplicates"]
    components, _ = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {c for _, _, c in components}

    before, after = held["mixing"]
    rows = [r.doc_id for r in after.collect()]
    assert set(rows) == {r.doc_id for r in before.collect()} and len(rows) > len(set(rows))

    before, after = held["packing"]
    check_pack([(r.doc_id, r.text) for r in before.collect()], after.collect(), 2048)


def test_stages_take_odd_rows(spark):
    odd = documents(spark).withColumn("x.y", F.lit(7))  # a name that must be quoted
    for docs in (odd, odd.limit(0)):
        given = {(r.doc_id, r.text) for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            rows = out.collect()
            if name == "packing":
                assert sorted({r.doc_id for r in rows}, key=str) == sorted({i for i, _ in given}, key=str)
                assert sum(r.start == 0 for r in rows) == docs.count()
                continue
            assert out.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= given
            assert all(r["x.y"] == 7 for r in rows)
            if name == "mixing":
                assert {(r.doc_id, r.text) for r in rows} == given
            if name == "near_duplicates":  # copies 1 and 2, 7 and 8, and the repeated row go
                assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 3, 4, 5, 6, 7, 9, 10, None] if given else [], key=str)

