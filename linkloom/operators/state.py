"""Page state as keyed upserts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.hosts import host_in


def upsert(pages: DataFrame, fetched: DataFrame, keep_first: tuple[str, ...] = ("url", "redirects_to")) -> DataFrame:
    """Fetched rows replace stored ones by ``page_id``; ``keep_first`` columns are written once.

    One full outer join on the key; both sides shuffle on it or, if stored bucketed by it, neither.
    """
    old, new = pages.alias("o"), fetched.alias("n")
    both = old.join(new, F.col("o.page_id") == F.col("n.page_id"), "full_outer")
    there = F.col("o.page_id").isNotNull()

    def pick(c: str):
        if c in keep_first:
            return F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.when(F.col("n.page_id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*(pick(c) for c in pages.columns))


def record_failures(pages: DataFrame, failures: DataFrame, now: datetime) -> DataFrame:
    """Failed fetches count up and stamp the page; unknown ones become pages with one failure.

    ``failures`` has ``page_id`` and ``url``; several in one batch count as many.
    """
    seen = F.lit(now).cast("timestamp_ntz")
    tally = failures.groupBy("page_id").agg(F.count("*").alias("__n"), F.min("url").alias("__url"))
    both = pages.join(tally, "page_id", "full_outer")
    hit = F.col("__n").isNotNull()
    special = {
        "url": F.coalesce("url", "__url"),
        "failed": F.coalesce("failed", F.lit(0)) + F.coalesce("__n", F.lit(0)),
        "last_visited": F.when(hit, seen).otherwise(F.col("last_visited")),
        "buttons": F.coalesce("buttons", F.array().cast(pages.schema["buttons"].dataType)) if "buttons" in pages.columns else None,
        "other_internal_links": F.coalesce("other_internal_links", F.array().cast("array<string>")) if "other_internal_links" in pages.columns else None,
    }
    return both.select(*((special[c] if special.get(c) is not None else F.col(c)).alias(c) for c in pages.columns))


def without_banned(pages: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """M9."""
    return pages.where(~host_in(F.col("page_id.host"), config.banned_hosts))


def button_occurrences(pages: DataFrame) -> DataFrame:
    """Occurrences of buttons in page order: (page_id, pos, button fields)."""
    return pages.select("page_id", F.posexplode("buttons").alias("pos", "b")).select("page_id", F.col("pos").cast("long").alias("pos"), "b.*")


def button_cache(occurrences: DataFrame) -> DataFrame:
    """A3: what is known of each image URL: the latest visit's hash and extension, ties by hash."""
    latest = F.max_by(F.struct("hash", "file_ext", "last_visited"), F.struct("last_visited", "hash", "file_ext")).alias("b")
    return occurrences.where(F.col("source").isNotNull()).groupBy("source").agg(latest).select("source", "b.*")


def new_blobs(images: DataFrame, stored: DataFrame) -> DataFrame:
    """K4: one row per content hash and extension that isn't stored yet."""
    return images.groupBy("hash", "file_ext").agg(F.min("bytes").alias("bytes")).join(stored.select("hash", "file_ext"), ["hash", "file_ext"], "left_anti")


def stats(occurrences: DataFrame) -> DataFrame:
    """K3, A11."""
    return occurrences.agg(F.count_distinct("hash").alias("buttons"))


def changed(old: DataFrame, new: DataFrame) -> bool:
    """ST5: whether two states differ, by a digest of each row so that nested columns compare."""
    digest = lambda df: df.select(F.xxhash64(*df.columns).alias("h")).groupBy("h").count()
    return digest(old).exceptAll(digest(new)).limit(1).count() > 0 or digest(new).exceptAll(digest(old)).limit(1).count() > 0
