"""The training-data pipeline: documents to a mix, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweft.llm import decontaminate, language, mixing, neardup, substrings
from logweft.llm.stage import release, written
from logweft.llm.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; texts without letters and texts unlike any go."""
    return language.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.kept(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that occur elsewhere; documents left empty go."""
    return substrings.cleaned(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix in training order, with the words taken of each and their places."""
    return mixing.mixed(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark", drop_benchmark_copies),
    ("mix", mix_sources),
]

#: Language ID and near copies cannot be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again.

    A stage's table goes when the next one is written, the last one's when the application ends.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        release(*before)
        before = [docs]
    return docs
