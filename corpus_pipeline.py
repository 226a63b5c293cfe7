"""A corpus pipeline of five stages, each one operator: language ID, near-duplicate removal, secret
redaction, mixing to target weights, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Rows with nulls, empty
texts, repeats and extra columns get the results that the operators define; an empty table passes
through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import forest, language, mixing, pieces, secrets
from quillspark.llm.shared import gone_at_exit, shared_folder, table
from quillspark.ship import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents most of whose words belong to none of the labelled languages, or that have none."""
    ship(spark)
    return language.kept(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the least doc_id, of each group of near copies."""
    ship(spark)
    return forest.kept(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets found in texts by [SECRET]; keeps every document."""
    ship(spark)
    return secrets.redacted(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by probabilities raked to source, language and topic targets."""
    ship(spark)
    return mixing.kept(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the checks of each document."""
    ship(spark)
    return pieces.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing_weights", mixing_weights),
    ("sentencepiece", encoding),
]

#: language mixtures, MinHash and merges can't be expressed in SQL; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; what lies between them goes to the folder that all executors share."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)  # the result reads what the last but one stage wrote
    jvm = spark.sparkContext._jvm
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # its successor is written, so nothing reads it again
            old = jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return STAGES[-1][1](spark, docs, sf_dir)
