"""Page responses to page rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.hosts import host_is_plain
from linkloom.functions.url_join import redirect_target
from linkloom.functions.urls import host_of, page_id


def page_kind(url: Column, status: Column, headers: Column, body: Column, target: Column, config: CrawlConfig = DEFAULT) -> Column:
    """Q1, Q2, Q3, Q5, Q8, P25: in the order in which they are looked at; ``target`` is that of ``redirect_target``."""
    kind = F.coalesce(headers["content-type"], F.lit("text/html"))
    html = kind.startswith("text/html") | kind.startswith("application/xhtml")
    return (
        F.when(~host_is_plain(host_of(url)), "bad_host").when(status.isNull(), "no_answer").when(target.isNotNull() & (target != url), "redirect").when(~status.between(200, 299), "http_error")
        .when(~html, "not_html").when(F.octet_length(body) > config.max_body_bytes, "too_big").otherwise("ok")
    )


def page_rows(responses: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """Every response with its page id, ``kind``, redirect target and decoded html.

    All kinds but ``bad_host``, ``no_answer`` and ``not_html`` are successes with ``failed`` 0
    (error pages are empty pages); those count as failures.
    """
    target = redirect_target(F.col("url"), F.col("status"), F.col("headers")["location"])
    rows = responses.withColumn("__target", target)
    rows = rows.withColumn("kind", page_kind(F.col("url"), F.col("status"), F.col("headers"), F.col("body"), F.col("__target"), config))
    return rows.select(
        "url", page_id(F.col("url")).alias("page_id"), "kind", F.when(F.col("kind") == "redirect", F.col("__target")).alias("redirects_to"),
        F.when(F.col("kind") == "ok", _lossy(F.col("body"))).alias("html"),
        F.col("fetched_at").alias("last_visited"), F.col("kind").isin("bad_host", "no_answer", "not_html").alias("is_failure"),
    )


def _lossy(body: Column) -> Column:
    """Invalid UTF-8 becomes the replacement character."""
    @F.arrow_udf("string")
    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in bodies.to_pylist()], pa.string())

    return run(body)
