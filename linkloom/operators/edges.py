"""The weighted link bag of page state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.hosts import url_host_in
from linkloom.functions.urls import is_web, page_id


def page_edges(pages: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """Internal, button and redirect edges of every page that may be followed, as a bag.

    Each page's edges are put together as one array and exploded: one pass over the pages and no
    shuffle. Multi-edges and self-links stay, as they count in the out-degree.
    """
    src = page_id(F.col("url"))
    edge = lambda url, weight, kind: F.struct(url.alias("dst_url"), weight.cast("double").alias("weight"), F.lit(kind).alias("kind"))
    inner = F.when(src["host"].isin(*config.full_weight_hosts), F.lit(1.0)).otherwise(F.lit(config.internal_weight))
    none = F.array().cast("array<struct<dst_url:string,weight:double,kind:string>>")
    linked = F.filter("buttons", lambda b: b["target"].isNotNull())
    every = F.concat(
        F.coalesce(F.transform("other_internal_links", lambda u: edge(u, inner, "internal")), none),
        F.coalesce(F.transform(linked, lambda b: edge(b["target"], F.lit(config.button_weight), "button")), none),
        F.when(is_web(F.col("redirects_to")), F.array(edge(F.col("redirects_to"), F.lit(config.redirect_weight), "redirect"))).otherwise(none),
    )
    followed = pages.where(~url_host_in(F.col("url"), config.no_follow_hosts))
    rows = followed.select(src.alias("src"), F.explode(every).alias("e"))
    return rows.select("src", page_id(F.col("e.dst_url")).alias("dst"), "e.weight", "e.dst_url", "e.kind")


def unvisited_urls(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """One URL to fetch for each target that isn't a page yet (the greatest, for a fixed choice)."""
    return edges.join(pages.select(F.col("page_id").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.max("dst_url").alias("url"))


def out_degree(edges: DataFrame) -> DataFrame:
    """A1: all links, repeats and self-links included."""
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    """A10: inbound links that aren't self-links."""
    return edges.where(F.col("src") != F.col("dst")).groupBy("dst").agg(F.count("*").alias("n_in"))


def replace_edges(edges: DataFrame, changed_pages: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """Edges with those of re-crawled pages rebuilt from their present state."""
    fresh = page_edges(changed_pages, config)
    gone = changed_pages.select(page_id(F.col("url")).alias("src")).distinct()
    return edges.join(gone, "src", "left_anti").unionByName(fresh)
