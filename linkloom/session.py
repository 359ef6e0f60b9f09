"""Session construction and table access shared by every part of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "linkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query assumes: UTC and adaptive execution.

    Everything else (memory, shuffle partitions, checkpoint folder) belongs to the cluster;
    keyword arguments override, with ``__`` standing for a dot.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read lazily so that filters and column pruning reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
