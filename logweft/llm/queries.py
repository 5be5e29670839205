"""The queries of these operators over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweft.llm import (
    decontaminate,
    embedding_whitening,
    fingerprints,
    fixity,
    language,
    mixing,
    neardup,
    quality,
    quality_rules,
    source_divergence,
    substrings,
    token_counts,
    url_filter,
)
from logweft.llm.oracle import ORACLE
from logweft.llm.tables import table

__all__ = ["ORACLE", "QUERIES"]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, against a replica in which about one record in 85 is damaged or lost."""
    records = fixity.archive(table(spark, sf_dir, "pages"))
    found = fixity.audit(records, fixity.damaged(records))
    return found.fillna(0, ["left_length", "right_length"])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.report(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_url_filter,
        op3_fingerprints,
        op4_token_counts,
        op5_substring_dedup,
        op6_quality,
        op7_fixity,
        op8_language,
        op9_near_dedup,
        op10_mixing,
        op11_quality_rules,
        op12_embedding_whitening,
        op13_source_divergence,
    )
}
