"""What to crawl next."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.hosts import host_in
from linkloom.functions.urls import host_of, page_id
from linkloom.operators.running import numbered_by_range


def backoff(last_visited: Column, failed: Column) -> Column:
    """An hour after the first failure, doubled with each more, up to 2**20 hours."""
    hours = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.least(failed - 1, F.lit(20))).cast("int"))
    return last_visited + F.make_dt_interval(F.lit(0), hours.cast("int"))


def due_time(score: Column, last_visited: Column, failed: Column, config: CrawlConfig = DEFAULT) -> Column:
    """When a page may be fetched again."""
    hours = F.when(score > config.popular_score, config.recrawl_popular_hours).otherwise(config.recrawl_hours)
    return F.when(failed > 0, backoff(last_visited, failed)).otherwise(last_visited + F.make_dt_interval(F.lit(0), hours))


def is_due(score: Column, last_visited: Column, failed: Column, now: datetime, config: CrawlConfig = DEFAULT) -> Column:
    """Q6: strictly past its time."""
    return due_time(score, last_visited, failed, config) < F.lit(now).cast("timestamp_ntz")


def ranked_candidates(ranks: DataFrame, pages: DataFrame, unvisited: DataFrame, busy: DataFrame, now: datetime, config: CrawlConfig = DEFAULT) -> DataFrame:
    """Candidates above the required score that aren't busy: (id, url, score, due, reason).

    Known pages are due by their state; unvisited ids need a URL and are always due.
    """
    ready = ranks.where(F.col("score") >= config.required_score).join(busy.select("id"), "id", "left_anti")
    known = ready.join(pages.select(F.col("page_id").alias("id"), F.col("url").alias("page_url"), "last_visited", "failed"), "id", "left")
    found = known.join(unvisited.select("id", F.col("url").alias("new_url")), "id", "left")
    due = F.when(F.col("page_url").isNull(), F.lit(True)).otherwise(is_due(F.col("score"), F.col("last_visited"), F.col("failed"), now, config))
    url = F.coalesce("page_url", "new_url")
    reason = F.when(F.col("page_url").isNull(), "unvisited").when(F.col("failed") > 0, "retry").otherwise("recrawl")
    return found.where(url.isNotNull()).select("id", url.alias("url"), "score", due.alias("due"), reason.alias("reason"))


def capped(candidates: DataFrame, queue_len: int, config: CrawlConfig = DEFAULT) -> DataFrame:
    """O3: the due candidates examined before the queue is over its cap.

    The first candidate is always examined; any other is while the queue and the due ones ahead
    of it are at most the cap. With the queue within its cap that is a top-k over due rows, which
    each task cuts before anything is gathered; otherwise only the very first can pass.
    """
    order = [F.desc("score"), F.col("id")]
    if queue_len <= config.queue_cap:
        return candidates.where("due").orderBy(*order).limit(config.queue_cap + 1 - queue_len)
    return candidates.orderBy(*order).limit(1).where("due")


def with_positions(frontier: DataFrame, bounded: bool = True) -> DataFrame:
    """Queue positions from 0. At most the cap of rows are numbered by one task; unless ``bounded``, range partitions number their own."""
    if not bounded:
        return numbered_by_range(frontier, [F.desc("score"), F.col("id")], "pos")
    return frontier.withColumn("pos", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("long"))


def admitted(urls: DataFrame, queued: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """M3: URLs that aren't banned, the first by ``seq`` of each page id that isn't queued or in flight."""
    fresh = urls.where(~host_in(host_of(F.col("url")), config.banned_hosts)).withColumn("page_id", page_id(F.col("url")))
    fresh = fresh.join(queued.select("page_id"), "page_id", "left_anti")
    return fresh.groupBy("page_id").agg(F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq"))


def refreshed(ranks: DataFrame, pages: DataFrame, unvisited: DataFrame, busy: DataFrame, queue_len: int | None, now: datetime, config: CrawlConfig = DEFAULT) -> DataFrame:
    """M6: the whole refresh. Bans apply after the cap, so banned URLs use up its slots.

    ``queue_len`` None asks for all due candidates, whatever a queue would hold.
    """
    found = ranked_candidates(ranks, pages, unvisited, busy, now, config)
    picked = found.where("due") if queue_len is None else capped(found, queue_len, config)
    return with_positions(picked.where(~host_in(host_of(F.col("url")), config.banned_hosts)), bounded=queue_len is not None)
