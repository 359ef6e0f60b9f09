"""M3 to M5, M10, ST4: the request queue as a table of (page_id, url, seq, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.hosts import rate_key
from linkloom.functions.urls import host_of
from linkloom.operators.frontier import admitted

QUEUED, IN_FLIGHT = "queued", "in_flight"


def enqueue(queue: DataFrame, urls: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """M3: the queue with URLs (url, seq) that aren't banned, queued or in flight."""
    fresh = admitted(urls, queue, config).select("page_id", "url", "seq", F.lit(QUEUED).alias("status"))
    return queue.select("page_id", "url", "seq", "status").unionByName(fresh)


def start(queue: DataFrame, picked: DataFrame) -> DataFrame:
    """M4: picked page ids go from queued to in flight."""
    there = picked.select("page_id", F.lit(True).alias("__go"))
    status = F.when(F.col("__go") & (F.col("status") == QUEUED), IN_FLIGHT).otherwise(F.col("status"))
    return queue.join(there, "page_id", "left").select("page_id", "url", "seq", status.alias("status"))


def finish(queue: DataFrame, done: DataFrame) -> DataFrame:
    """M4: finished page ids leave, queued or in flight."""
    return queue.join(done.select("page_id"), "page_id", "left_anti")


def next_admissible(queue: DataFrame, next_times: DataFrame, now_ms: int) -> DataFrame:
    """Per limiter key whose time has come, its first queued URL; the first of all by ``seq`` is the one to pop.

    ``next_times`` has (rate_key, next_ms). One partial aggregation per key instead of a scan of
    the queue in order, so as many URLs as there are free hosts can be popped at once.
    """
    keyed = queue.where(F.col("status") == QUEUED).withColumn("__k", rate_key(host_of(F.col("url"))))
    keyed = keyed.select("page_id", "url", "seq", F.col("__k.rate_key").alias("rate_key"), F.col("__k.delay_s").alias("delay_s"))
    first = keyed.groupBy("rate_key", "delay_s").agg(F.min_by(F.struct("seq", "page_id", "url"), "seq").alias("f"))
    free = first.join(next_times, "rate_key", "left").where(F.coalesce(F.col("next_ms") <= now_ms, F.lit(True)))
    return free.select("f.page_id", "f.url", "f.seq", "rate_key", "delay_s")


def is_busy(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """The given page ids that are queued or in flight."""
    return ids.join(queue.select("page_id"), "page_id", "left_semi")


def page(pages: DataFrame, host: str, path: str) -> DataFrame:
    """One page; the filter reaches the scan."""
    return pages.where((F.col("page_id.host") == host) & (F.col("page_id.path") == path))
