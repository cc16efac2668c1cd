"""From documents to a training mix, in five stages.

Each stage takes all documents its predecessor kept and returns the ones it keeps, with the columns of ``documents``; the
last adds how often the mix takes each document.  Results are written as Parquet and read again between stages.

1. language_id: documents without letters, or whose language is recognised with a score below LEAST_SCORE, go.
2. near_duplicates: one document of each component of the n-gram Jaccard join stays, that of the least id.
3. decontaminate: documents that hold a benchmark item, whole or slightly edited, go.
4. secrets: found secrets are masked inside the texts; every document stays, ``n_chars`` follows the text.
5. mix: sources are brought to their target weights; documents the mix does not take go.

Nulls, empty texts, repeated rows, empty tables and extra columns are handled as each operator states; a document without
a text goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mootlake.llm import decontaminate, langid, mixing, ngram_join, secrets
from mootlake.session import stage_table

LEAST_SCORE = 0.3
# The stages learn from tables and use hashes that SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = langid.train(langid.sample(docs.where(langid.remainder("doc_id", 4) != 2)))
    return langid.known(docs, field, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
