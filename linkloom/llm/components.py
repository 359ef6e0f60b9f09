"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.storage import written


def _between(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller node first, without loops."""
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (u, v), the label being the smallest node of its component.

    Each round points every node at its least neighbour, follows pointers to their roots, halving
    the way each time, and goes on with the edges between roots alone. Stars, which candidate
    edges mostly are, are gone after one round; a path of n nodes takes log2(n) steps. Tables
    stay in the shared folder; the driver only learns whether anything is left.

    Loops, null ends and repeated edges count for nothing; an empty table gives no rows; other
    columns are ignored. Nodes must be whole numbers; the order of rows plays no part.
    """
    left = written(_between(edges), "edges")
    labels = left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    first = True
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        points = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")), "labels")
        while True:
            ahead = points.select(F.col("node").alias("label"), F.col("label").alias("root"))
            # Roots point at themselves and need no lookup.
            moved = written(points.where("node <> label").join(ahead, "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("far")), "labels")
            points = moved.select("node", "label").unionByName(points.where("node = label"))
            if not moved.where("far").limit(1).count():
                break
        points = written(points, "labels")
        if first:
            labels, first = points, False
        else:
            on = points.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = written(labels.join(on, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        for end in ("u", "v"):
            left = left.join(points.select(F.col("node").alias(end), F.col("label").alias("__root")), end).withColumn(end, F.col("__root")).drop("__root")
        left = written(_between(left), "edges")
    return labels
