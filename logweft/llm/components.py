"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.llm.stage import release, written


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): the least id that it is connected with.

    Labels go along the links and then jump to their label's label, until none changes; the
    rounds grow with the logarithm of the longest path. Each round is a written table.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other"))
    both = written(both.union(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct())
    labels = written(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("root")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("near"))
        moved = labels.join(seen, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = moved.join(jump, "root").select("id", "old", F.least("root", "next").alias("root"))
        table = written(moved)
        changed = not table.where("old <> root").isEmpty()
        release(labels)
        labels = table.select("id", "root")
        if not changed:
            release(both)
            return labels
        labels.written_at = table.written_at
