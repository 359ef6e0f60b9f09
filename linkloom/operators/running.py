"""Numbering rows inside large ordered groups, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.storage import written


def numbered(rows: DataFrame, key: str, stretch: Column, order: list[str], out: str = "nth") -> DataFrame:
    """Adds ``out``: a row's number from 0 among those of its ``key``, by ``stretch`` and then ``order``.

    Only a stretch of a group is ever sorted in one task: stretches are counted first, with
    partial counts, and each row adds the rows of earlier stretches to its place in its own.
    ``rows`` must give the same rows each time it is read.
    """
    dealt = rows.withColumn("__stretch", stretch)
    across = Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(key, "__stretch").agg(F.count("*").alias("__n")).select(key, "__stretch", F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, "__stretch").orderBy(*order)) - 1
    return dealt.withColumn("__inside", inside).join(before, [key, "__stretch"]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__stretch", "__before", "__inside")


def numbered_by_range(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: a row's number from 0 in ``order`` over all rows.

    Rows are range-partitioned and stored; one count per partition gives each its offset, so no
    task sorts more than its range. Ties in ``order`` are settled anyhow.
    """
    kept = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return kept.withColumn("__inside", place).join(offsets, "__part").withColumn(out, (F.col("__before") + F.col("__inside")).cast("long")).drop("__part", "__before", "__inside")
