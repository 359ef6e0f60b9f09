"""Fetchers. Replay from a table is the default; HTTP is opt-in."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.hosts import host_is_plain
from linkloom.functions.images import dimensions, format_of
from linkloom.functions.url_join import redirect_target
from linkloom.functions.urls import host_of, page_id
from linkloom.storage import written

FETCHED = "url string, status int, headers map<string,string>, body binary, fetched_at timestamp"


class Fetcher(Protocol):
    def fetch(self, urls: DataFrame) -> DataFrame: ...


class ReplayFetcher:
    """Responses from a stored table; URLs without one are failures."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def fetch(self, urls: DataFrame) -> DataFrame:
        return urls.select("url").join(self.responses, "url")


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def _read(response, config: CrawlConfig) -> bytes:
    """A body up to one byte over the limit; of an image that its first bytes show to be no badge, only those."""
    body = response.read(config.sniff_bytes)
    if (response.headers.get("content-type") or "").startswith("image/") and len(body) == config.sniff_bytes:
        size = dimensions(body, format_of(body))
        if size is not None and size != (config.badge_width, config.badge_height):
            return body
    return body + response.read(config.max_body_bytes + 1 - len(body))


def fetch_one(url: str, config: CrawlConfig) -> dict | None:
    """One response, redirects not followed; None for a network error."""
    import ssl

    context = None if config.verify_tls else ssl._create_unverified_context()  # noqa: S323 - opt-out
    opener = urllib.request.build_opener(_NoRedirects, urllib.request.HTTPSHandler(context=context))
    try:
        with opener.open(urllib.request.Request(url, headers={"User-Agent": config.user_agent}), timeout=config.timeout_s) as r:
            status, headers, body = r.status, r.headers, _read(r, config)
    except urllib.error.HTTPError as e:
        status, headers, body = e.code, e.headers, b""
    except (OSError, ValueError, http.client.HTTPException):
        return None
    return {"url": url, "status": status, "headers": {k.lower(): v for k, v in headers.items()}, "body": body}


class HttpFetcher:
    """Fetches inside ``mapInArrow``; partitions bound how many requests are open at once."""

    def __init__(self, config: CrawlConfig = DEFAULT):
        self.config = config

    def fetch(self, urls: DataFrame) -> DataFrame:
        config = self.config

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for u in batch["url"].to_pylist():
                    r = fetch_one(u, config)
                    if r:  # one row at a time, as a body may be large
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["url"]]), pa.array([r["status"]], pa.int32()), pa.array([list(r["headers"].items())], pa.map_(pa.string(), pa.string())),
                             pa.array([r["body"]], pa.binary()), pa.array([int(time.time() * 1e6)], pa.timestamp("us", "UTC"))],
                            ["url", "status", "headers", "body", "fetched_at"],
                        )

        return urls.select("url").repartition(config.concurrent_fetches).mapInArrow(run, FETCHED).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


def download_pages(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """S3: responses to (page_id, url), one request each and one more where a redirect stays on the page.

    Gives ``page_id`` as asked, ``url`` as answered, ``status``, ``headers``, ``body`` and
    ``fetched_at``, nulls where there was no answer. Hosts with other characters than a name's
    are not asked.
    """
    asked = urls.select("page_id", "url")
    plain = asked.where(host_is_plain(host_of(F.col("url"))))
    first = written(fetcher.fetch(plain.select("url").distinct()), "pages-got")
    target = redirect_target(F.col("url"), F.col("status"), F.col("headers")["location"])
    hops = first.select("url", target.alias("to")).where((F.col("to") != F.col("url")) & (page_id(F.col("to")) == page_id(F.col("url"))) & host_is_plain(host_of(F.col("to"))))
    hops = written(hops, "pages-hops")
    again = written(fetcher.fetch(hops.select(F.col("to").alias("url")).distinct()), "pages-again")
    moved = asked.join(hops, "url").select("page_id", F.col("to").alias("url")).join(again, "url", "left")
    direct = asked.join(hops, "url", "left_anti").join(first, "url", "left")
    columns = ["page_id", "url", "status", "headers", "body", "fetched_at"]
    return direct.select(columns).unionByName(moved.select(columns))
