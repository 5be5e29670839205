"""Which layout fits the logs: candidates scored on the first lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logweft.functions.layout import UnsupportedLayoutError, compile_layout
from logweft.sources.logs import sample_lines


def _regex_or_none(pattern: str) -> str | None:
    try:
        return compile_layout(pattern).regex
    except UnsupportedLayoutError:
        return None


@F.pandas_udf(StringType())
def layout_regex(patterns: pd.Series) -> pd.Series:
    """The regex of each layout, NULL if it is not supported."""
    return patterns.map(_regex_or_none)


def score_patterns(candidates: DataFrame, lines: DataFrame, limit: int = 50) -> DataFrame:
    """Lines each candidate matches among the first ``limit`` of ``lines``.

    Configurations repeat patterns, so every distinct pattern is tried once. ``candidates``
    is read twice and should be staged.
    """
    sampled = sample_lines(lines, limit).agg(F.collect_list(F.concat("value", F.lit("\n"))).alias("lines"))
    matching = F.filter("lines", lambda line: F.rlike(line, F.col("regex")))
    tried = (
        candidates.select("pattern")
        .distinct()
        .withColumn("regex", layout_regex("pattern"))
        .withColumn("lines", sampled.scalar())
        .select(
            "pattern",
            F.when(F.col("regex").isNull(), 0).otherwise(F.size(matching)).cast("bigint").alias("matches"),
            F.size("lines").cast("bigint").alias("checked"),
        )
    )
    score = F.when(F.col("checked") > 0, F.col("matches") / F.col("checked")).otherwise(F.lit(0.0))
    return candidates.join(tried, "pattern").withColumn("score", score)


def best_pattern(scored: DataFrame) -> DataFrame:
    """The best candidate over all configurations, the first one wins ties."""
    return scored.orderBy(F.desc("matches"), F.desc("score"), "config", "ordinal").limit(1)


def best_per_config(scored: DataFrame) -> DataFrame:
    """The best candidate of every configuration."""
    rank = F.struct("matches", "score", -F.col("ordinal"))
    return scored.groupBy("config").agg(F.max_by(F.struct(*scored.columns), rank).alias("best")).select(
        "best.*"
    )
