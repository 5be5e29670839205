"""Running numbers over groups of any size.

A window over a whole group would put the group into one task. Here a group is
cut into buckets of bounded size: rows are numbered inside their bucket, and a
second window over one row per bucket adds what earlier buckets hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(
    df: DataFrame,
    group: list[str],
    bucket: str,
    order: list[str],
    amount: Column,
    name: str,
) -> DataFrame:
    """Add the sum of ``amount`` over the earlier rows of the same group.

    Buckets must follow the order: every row of a lower bucket comes first.
    """
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*group, bucket)
        .agg(F.sum(amount).alias("_held"))
        .select(*group, bucket, F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset"))
    )
    before_me = F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        df.withColumn("_inside", F.coalesce(before_me, F.lit(0)))
        .join(offsets, [*group, bucket])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside")
    )
