"""Cutting lineage in a folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) is a folder of our own set, which is
    then what ``checkpoint()`` uses as well; on a cluster executors could not see it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = os.path.join(tempfile.gettempdir(), "linkloom-checkpoints")
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Unlike a checkpoint the copy is columnar and compressed, so later steps read only the
    columns they name. The rows and their order within a file are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for paths in _open_scopes:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._linkloom_path = path
    return out


#: Plan nodes that pass on rows of a file as they are, where they came from included.
_PASSING = ("Project", "Filter", "SubqueryAlias", "GlobalLimit", "LocalLimit")


def _is_file_read(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in _PASSING:
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns


def stored_order(df: DataFrame) -> Column:
    """A whole number per row of ``df`` that grows along its rows, as stored.

    Spark deals a folder's files to tasks by size. So if ``df`` reads a Parquet folder, with
    columns or rows of it left out or columns added or not, the number is made of the task that
    wrote the file, the file's number among those of that task and the row's place in it: the
    order of a sorted table outlives being written. Files that do not all bear a task's number
    are taken in the order of their names. Otherwise it is the order in which the plan gives its
    rows.
    """
    if not _is_file_read(df):
        return F.monotonically_increasing_id()
    names = sorted({f.rpartition("/")[2] for f in df.inputFiles()}, key=unquote)
    part = lambda p: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(_metadata.file_name, '{p}', 1), '') as bigint)"), F.lit(0))
    if all(re.match("part-[0-9]+", n) for n in names):
        file = F.shiftleft(part("^part-([0-9]+)"), 43) + F.shiftleft(part("-c([0-9]+)[.]"), 33)
    else:
        place = lambda known: F.array_position(F.lit(known), F.col("_metadata.file_name"))
        file = F.shiftleft(F.greatest(place(names), place([unquote(n) for n in names])), 43)  # names are given as in a URL or plain
    return file + F.col("_metadata.row_index")


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` stored in the shared folder, bucketed and sorted by ``key``.

    Joins and aggregations on ``key`` then read it in place, without a shuffle, as often as they
    run. There are as many buckets as the session has shuffle partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"linkloom_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    for paths in _open_scopes:
        paths.append(path)
    return spark.table(name)


_open_scopes: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of tables that are written inside, for whoever knows when they have served."""
    paths: list[str] = []
    _open_scopes.append(paths)
    try:
        yield paths
    finally:
        _open_scopes[:] = [other for other in _open_scopes if other is not paths]


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes stored tables, wherever the shared folder is, and the catalog's entries of bucketed ones."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        name = path.rpartition("/")[2]
        if name.startswith("linkloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables from ``written`` that nothing yet to be computed reads."""
    for df in tables:
        remove(df.sparkSession, [df._linkloom_path])


#: What a broadcast may weigh, as rows are laid out in memory.
BROADCAST_BYTES = 96 << 20


def broadcast_if_small(df: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if it has no more than ``most_rows`` rows and ``most_bytes`` bytes; else left to a shuffled join.

    ``df`` should be a stored table, as its rows are counted and its texts and arrays measured here.
    """
    long = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind in ("string", "binary")] + [F.size(F.col(f"`{c}`")) * 32 for c, kind in df.dtypes if kind.startswith("array")]
    held = sum((F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)) for x in long), F.lit(8 + 16 * len(df.columns)).cast("long"))
    n, size = df.limit(most_rows + 1).agg(F.count("*"), F.sum(held)).first()
    return F.broadcast(df) if n <= most_rows and (size or 0) <= most_bytes else df
