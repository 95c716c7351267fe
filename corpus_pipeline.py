"""The corpus pipeline: each stage is one operator of ``relata.llm`` over what the stage before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame.  All but the last return the columns of
documents.  ``run`` writes each stage as Parquet into the shared folder of
``spark.checkpoint.dir`` and reads it back as the next stage's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from relata.llm.common import table
from relata.llm.mixing import mix
from relata.llm.ngram_join import one_of_each_group
from relata.llm.packing import pack
from relata.llm.quality import keep_good
from relata.llm.queries import TARGETS, labelled_domains
from relata.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: the documents it rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates on five-word shingles at 0.8: of each group one row stays, the first by doc_id."""
    return one_of_each_group(docs, k=5, percent=80, repeats=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix languages to the target weights: every document stays, documents of scarce languages come again."""
    return mix(docs, table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS, least=1.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2,048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: No stage but the last could be written in SQL (a trained network, a fit over iterations): tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
