"""What the groups are about: exceptions, hours, loggers, threads, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweft.functions.levels import level_bar
from logweft.functions.text import exception_signature, strip
from logweft.functions.times import time_bucket

# The name and the text of each dimension.
DIMENSIONS = {
    "exception": lambda: exception_signature(
        F.col("stacktrace"), F.col("message_body"), F.col("message")
    ),
    "time": lambda: time_bucket(F.col("timestamp")),
    "logger": lambda: strip(F.col("logger")),
    "thread": lambda: strip(F.col("thread")),
}
TOP = 5


def dashboard(groups: DataFrame, *dimensions: str) -> DataFrame:
    """Groups and occurrences per value of each dimension, in one pass and shuffle."""
    pairs = [
        F.struct(F.lit(name).alias("dimension"), DIMENSIONS[name]().alias("value"))
        for name in dimensions or DIMENSIONS
    ]
    return (
        groups.select("count", F.explode(F.array(*pairs)).alias("pair"))
        .select("count", "pair.dimension", "pair.value")
        .where(F.col("value") != "")
        .groupBy("dimension", "value")
        .agg(F.count("*").alias("group_count"), F.sum("count").alias("occurrence_count"))
    )


def _summary_order() -> list:
    return [F.desc("occurrence_count"), F.desc("group_count"), F.asc("value")]


def sort_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy("dimension", *_summary_order())


def top_summary(summary: DataFrame, top: int = TOP) -> DataFrame:
    """The first values of each dimension, with their rank."""
    ranked = Window.partitionBy("dimension").orderBy(*_summary_order())
    return summary.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)


def distinct_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("dimension").agg(F.count("*").alias("distinct_values"))


def level_bars(counts: DataFrame) -> DataFrame:
    """The level table with a bar relative to the most frequent level."""
    peak = counts.agg(F.max("n")).scalar()
    return counts.where("n > 0").select("level", "n", level_bar(F.col("n"), peak).alias("bar"))
