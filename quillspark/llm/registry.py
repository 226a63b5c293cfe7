"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import chunks, forest, hashing, language, mixing, pieces, quality, secrets, toxicity, urls
from quillspark.llm.shared import table


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.groups(table(spark, sf_dir, "documents"))


def op9_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fingerprints(table(spark, sf_dir, "documents"), **chunks.FINE)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.search(table(spark, sf_dir, "embeddings"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.screen(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_url_rules": op5_url_rules,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op6_quality": op6_quality,
    "op1_fingerprints": op1_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op9_mixing_weights": op9_mixing_weights,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language_mixture": op4_language_mixture,
}

SQL: dict[str, str] = {"op9_mixing_weights": mixing.sql()}
