"""Joins of many rows with a table of one counted row per key, where a key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds one in so many of all rows is common, so at most so many are.
LARGE = 4096


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, whose column ``count`` says how many of the ``total`` rows have the key.

    Common keys are broadcast, so their rows stay where they are; no other key is large.
    ``table`` is read twice and should be written.
    """
    common = F.col(count) * LARGE >= total
    large = F.broadcast(table.where(common))
    rest = rows.join(large.select(key), key, "left_anti").join(table.where(~common), key)
    return rows.join(large, key).unionByName(rest)
