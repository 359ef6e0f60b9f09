"""Running totals over large ordered groups, without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str | Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the total of ``value`` over the rows of the group that come earlier.

    Rows are ordered by ``bucket`` and, inside it, by ``order``. Only a bucket is ever sorted in
    one task: totals of buckets are summed first (with map-side partial sums), their own running
    total is taken per group, and each row adds what precedes it within its bucket. So a group
    that holds most rows is spread over as many tasks as it has buckets. ``group`` and
    ``bucket`` must not be null, and ``df`` must give the same rows each time it is read.
    """
    keys = [*group, bucket]
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("__held"))
        .select(*keys, F.coalesce(F.sum("__held").over(across), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(starts, keys)
        .withColumn(out, F.col("__before") + F.col("__inside"))
        .drop("__before", "__inside")
    )
