"""Candidates to validated badges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.images import Normalizer, badge_sized, content_hash, data_uri_parts, file_ext, identity_normalizer, mime_format, re_encoded, sniffed_format
from linkloom.functions.url_join import original_images, redirect_target
from linkloom.functions.urls import proxied_image_url
from linkloom.sources.fetch import Fetcher
from linkloom.storage import written


def rotated(candidates: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """Adds ``rot``, the order of trying: of more than 100 candidates the last 50 come first."""
    n = F.count("*").over(Window.partitionBy("page"))
    return candidates.withColumn("__n", n).withColumn("rot", F.when(F.col("__n") > config.rotate_over, F.pmod(F.col("pos") + config.rotate_by, F.col("__n"))).otherwise(F.col("pos")).cast("long")).drop("__n")


def early_abort(tried: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """Pages with none valid among the first 101 tried lose all; pages with no more tries than that keep what they have."""
    per = Window.partitionBy("page")
    early = F.max(F.when(F.col("rot") <= config.early_abort_after, F.col("valid")).otherwise(False)).over(per)
    many = F.max("rot").over(per) >= config.early_abort_after
    return tried.withColumn("__ok", early | ~many).where("__ok").drop("__ok")


def in_page_order(tried: DataFrame) -> DataFrame:
    """Valid ones as an array in page order."""
    kept = tried.where("valid").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("a"))
    return kept.select("page", F.transform("a", lambda x: x["url"]).alias("urls"))


def probed(candidates: DataFrame, cache: DataFrame, now: datetime, config: CrawlConfig = DEFAULT) -> DataFrame:
    """Adds the cache's hash, extension and visit, and whether the entry is fresh enough to use."""
    known = cache.select(F.col("source").alias("url"), F.col("hash").alias("cached_hash"), F.col("file_ext").alias("cached_ext"), F.col("last_visited").alias("cached_at"))
    fresh = F.col("cached_at") + F.make_dt_interval(F.lit(0), F.lit(config.recrawl_buttons_hours)) > F.lit(now).cast("timestamp_ntz")
    return candidates.join(known, "url", "left").withColumn("hit", F.coalesce(fresh, F.lit(False)))


def image_kind(status: Column, headers: Column, body: Column, config: CrawlConfig = DEFAULT) -> Column:
    """Why an image response is refused, or ``ok``."""
    kind = headers["content-type"]
    return (
        F.when(~status.between(200, 299), "http_error").when(kind.isNull(), "no_type").when(~kind.startswith("image/"), "not_image")
        .when(F.octet_length(body) > config.max_body_bytes, "too_big").otherwise("ok")
    )


def judged(images: DataFrame, config: CrawlConfig = DEFAULT, normalizer: Normalizer = identity_normalizer) -> DataFrame:
    """Adds ``valid``, and of valid images the bytes to store, their hash and extension.

    ``images`` has ``body`` and ``format``. Bytes that aren't a badge, or that the re-encoder
    fails on, are dropped here, so that no later step carries them.
    """
    sized = (F.octet_length("body") > 0) & (F.octet_length("body") <= config.max_body_bytes) & F.coalesce(badge_sized(F.col("body"), F.col("format"), config), F.lit(False))
    made = images.withColumn("bytes", F.when(sized, re_encoded(F.col("body"), F.col("format"), normalizer)))
    valid = F.coalesce(F.octet_length("bytes") > 0, F.lit(False))
    kept = made.withColumn("valid", valid).withColumn("bytes", F.when(valid, F.col("bytes")))
    return kept.withColumn("hash", F.when(valid, content_hash(F.col("bytes")))).withColumn("file_ext", F.when(valid, file_ext(F.col("format")))).drop("body", "format")


def answered(responses: DataFrame, config: CrawlConfig = DEFAULT, normalizer: Normalizer = identity_normalizer) -> DataFrame:
    """(url, target, error, valid, bytes, hash, file_ext) of image responses.

    The format is what the leading bytes tell, whatever the header says. ``error`` marks answers
    that are as good as none: no success, no image type, or bytes of no known format.
    """
    kind = image_kind(F.col("status"), F.col("headers"), F.col("body"), config)
    told = responses.select("url", redirect_target(F.col("url"), F.col("status"), F.col("headers")["location"]).alias("target"), kind.alias("kind"), F.when(kind == "ok", F.col("body")).alias("body"))
    told = told.withColumn("format", sniffed_format(F.col("body")))
    error = F.col("kind").isin("http_error", "no_type", "not_image") | ((F.col("kind") == "ok") & F.col("format").isNull())
    return judged(told.withColumn("error", error), config, normalizer).drop("kind")


def embedded(sources: DataFrame, config: CrawlConfig = DEFAULT, normalizer: Normalizer = identity_normalizer) -> DataFrame:
    """(source, valid, bytes, hash, file_ext) of ``data:`` URIs, whose format is the one they name."""
    parts = sources.withColumn("__p", data_uri_parts(F.col("source"))).select("source", F.col("__p.body").alias("body"), mime_format(F.col("__p.mime")).alias("format"))
    return judged(parts, config, normalizer)


def downloaded(sources: DataFrame, fetcher: Fetcher, config: CrawlConfig = DEFAULT, normalizer: Normalizer = identity_normalizer) -> DataFrame:
    """Each of ``source`` asked for, by a proxy where its host needs one, and redirects followed.

    Gives (source, found_at, error, valid, bytes, hash, file_ext), ``found_at`` being the last
    URL unless it was the proxy's. At most ``max_image_redirects`` requests are made for an image;
    each round asks for what the round before was sent on to, every URL once.
    """
    way = written(sources.select("source", proxied_image_url(F.col("source")).alias("at")), "images-asked")
    done = None
    for left in range(config.max_image_redirects - 1, -1, -1):
        got = written(answered(fetcher.fetch(way.select(F.col("at").alias("url")).distinct()), config, normalizer), "images-got")
        met = way.join(got.withColumnRenamed("url", "at"), "at")
        ends = F.lit(True) if not left else F.col("target").isNull()
        found_at = F.when(F.col("source") == proxied_image_url(F.col("source")), F.col("at")).otherwise(F.col("source"))
        here = met.where(ends).select("source", found_at.alias("found_at"), "error", "valid", "bytes", "hash", "file_ext")
        done = here if done is None else done.unionByName(here)
        way = written(met.where(~ends).select("source", F.col("target").alias("at")), "images-asked")
        if not left or not way.limit(1).count():
            return done
    return done


@dataclass
class Scraped:
    """Buttons per page in order (page, buttons), and the images to be stored (hash, file_ext, bytes)."""

    buttons: DataFrame
    images: DataFrame


def scraped(candidates: DataFrame, cache: DataFrame, fetcher: Fetcher, now: datetime, config: CrawlConfig = DEFAULT, normalizer: Normalizer = identity_normalizer) -> Scraped:
    """Candidates cleaned, looked up, downloaded, judged, hashed and put in page order.

    A fresh cache entry wins and is not asked for; a downloaded image comes next; a stale entry
    serves where the download failed; the rest is dropped. A ``data:`` URI is its own download
    and leaves no source. ``Scraped.images`` holds each content once.
    """
    cleaned = rotated(candidates, config).withColumn("url", original_images(F.col("url")))
    tried = written(probed(cleaned, cache, now, config).withColumnRenamed("url", "source"), "images-tried")
    wanted = tried.where(~F.col("hit")).select("source").distinct()
    inline = F.lower(F.substring("source", 1, 5)) == "data:"
    fetched = downloaded(wanted.where(~inline), fetcher, config, normalizer)
    own = embedded(wanted.where(inline), config, normalizer).withColumn("found_at", F.lit(None).cast("string")).withColumn("error", F.lit(False))
    seen = written(fetched.unionByName(own), "images-seen")
    joined = tried.join(seen.drop("bytes").withColumn("__answered", F.lit(True)), "source", "left")
    failed = F.col("__answered").isNull() | F.col("error")
    from_cache = F.col("hit") | (failed & F.col("cached_hash").isNotNull())
    usable = from_cache | (~failed & F.coalesce("valid", F.lit(False)))
    chosen = joined.select(
        "page", "pos", "rot", F.when(from_cache, F.col("source")).otherwise(F.col("found_at")).alias("source"),
        F.when(from_cache, F.col("cached_hash")).otherwise(F.col("hash")).alias("hash"), F.when(from_cache, F.col("cached_ext")).otherwise(F.col("file_ext")).alias("file_ext"),
        F.col("href").alias("target"), F.when(from_cache, F.col("cached_at")).otherwise(F.lit(now).cast("timestamp_ntz")).alias("last_visited"), "alt", "title", F.coalesce(usable, F.lit(False)).alias("valid"),
    )
    item = F.struct("pos", "source", "hash", "file_ext", "target", "last_visited", "alt", "title")
    kept = early_abort(chosen, config).where("valid").groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("buttons"))
    return Scraped(kept, seen.where("valid").groupBy("hash", "file_ext").agg(F.min("bytes").alias("bytes")))
