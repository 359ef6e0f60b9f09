"""Everything that is derived from page state at start."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.urls import page_id
from linkloom.operators import edges, frontier, rank, state
from linkloom.storage import checkpointed


@dataclass
class RuntimeState:
    pages: DataFrame
    edges: DataFrame
    ranks: DataFrame
    cache: DataFrame
    unvisited: DataFrame


def initial(pages: DataFrame, config: CrawlConfig = DEFAULT) -> RuntimeState:
    """Banned pages dropped, edges and cache rebuilt, and the initial rank iterations run."""
    kept = state.without_banned(pages, config)
    links = checkpointed(edges.page_edges(kept, config))
    ids = rank.nodes_of(links, kept)
    ranks = rank.pagerank(links, config.initial_iterations, ids, config=config)
    return RuntimeState(kept, links, checkpointed(ranks), state.button_cache(state.button_occurrences(kept)), edges.unvisited_urls(links, kept))


def next_urls(runtime: RuntimeState, busy: DataFrame, queue_len: int, now: datetime, config: CrawlConfig = DEFAULT) -> DataFrame:
    """M6 from runtime state: refreshed ranks, which it keeps, then the frontier; with no page at all, the start URL."""
    ranks = checkpointed(rank.pagerank(runtime.edges, config.refresh_iterations, rank.nodes_of(runtime.edges, runtime.pages), runtime.ranks, config))
    runtime.ranks = ranks
    unvisited = runtime.unvisited.select(F.col("dst").alias("id"), "url")
    found = frontier.refreshed(ranks, runtime.pages, unvisited, busy.select(F.col("page_id").alias("id")), queue_len, now, config)
    if config.start_url is None or runtime.pages.limit(1).count():
        return found
    seed = runtime.pages.sparkSession.range(1).select(page_id(F.lit(config.start_url)).alias("id"), F.lit(config.start_url).alias("url"), F.lit(1.0).alias("score"), F.lit(True).alias("due"), F.lit("start").alias("reason"), F.lit(0).cast("long").alias("pos"))
    return found.unionByName(seed)
