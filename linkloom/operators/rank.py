"""The leaky weighted PageRank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.storage import bucketed, checkpointed, discard, written

#: Hubs, with one id each, up to which their scores are broadcast.
BROADCAST_HUBS = 100_000


def collapsed(edges: DataFrame) -> DataFrame:
    """The bag as (src, dst, w, n): weights summed and links counted per pair of nodes."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))


def nodes_of(edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """G1: every known id: crawled pages and both ends of edges."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    if pages is not None:
        ids = ids.union(pages.select(F.col("page_id").alias("id")))
    return ids.distinct()


@dataclass
class Shares:
    """What each node gives to those that it links, (src, dst, share), stored for every step.

    ``plain`` is bucketed by source. The links of ``hubs`` (ids with many) would make one bucket
    that no reader splits, so they lie apart in ``crowded``, dealt by their targets, if there are
    ``any``.
    """

    plain: DataFrame
    crowded: DataFrame | None
    hubs: DataFrame | None
    any: bool
    few: bool


def prepared(pairs: DataFrame, config: CrawlConfig = DEFAULT) -> Shares:
    """Shares of collapsed pairs: weights over the source's out-degree.

    The out-degree counts all links but self-links carry no rank.
    """
    degree = written(pairs.groupBy("src").agg(F.sum("n").alias("out_degree"), F.count("*").alias("targets")), "degree")
    hubs = degree.where(F.col("targets") > config.hub_links).select(F.col("src").alias("id"))
    shares = pairs.where(F.col("src") != F.col("dst")).join(degree, "src").select("src", "dst", (F.col("w") / F.col("out_degree")).alias("share"), (F.col("targets") > config.hub_links).alias("hub"))
    n = hubs.limit(BROADCAST_HUBS + 1).count()
    if not n:
        return Shares(bucketed(shares.drop("hub"), "src", "shares"), None, None, False, True)
    crowded = written(shares.where("hub").drop("hub").repartition("dst"), "shares-of-hubs")
    return Shares(bucketed(shares.where(~F.col("hub")).drop("hub"), "src", "shares"), crowded, written(hubs, "hubs"), True, n <= BROADCAST_HUBS)


def step(ids: DataFrame, shares: Shares, ranks: DataFrame, damping: float) -> DataFrame:
    """One Jacobi iteration: (1 - d) + d * sum(score * share)."""
    given = ranks.select(F.col("id").alias("src"), "score")
    sent = lambda links, scores: links.join(scores, "src").select(F.col("dst").alias("id"), (F.col("score") * F.col("share")).alias("part"))
    parts = sent(shares.plain, given)
    if shares.any:
        of_hubs = given.join(shares.hubs.select(F.col("id").alias("src")), "src")
        parts = parts.unionByName(sent(shares.crowded, F.broadcast(of_hubs) if shares.few else of_hubs))
    heard = parts.groupBy("id").agg(F.sum("part").alias("s"))
    return ids.join(heard, "id", "left").select("id", (F.lit(1 - damping) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("score"))


def pagerank(edges: DataFrame, iterations: int, ids: DataFrame | None = None, start: DataFrame | None = None, config: CrawlConfig = DEFAULT) -> DataFrame:
    """(id, score) after ``iterations`` steps from 1.0, or from the scores of ``start`` where it has them.

    The edges are read once: their collapsed pairs are stored, and degrees, shares and ids come
    from those. Shares are stored bucketed by source and ids by id, so that a step shuffles
    partial sums but never the edges; hubs' links are spread by target. Ranks are stored every
    ``checkpoint_every`` steps, in the folder that executors share, so that neither lineage nor a
    lost executor makes the loop start over. A node's sum is taken partially before its shuffle,
    so targets of many links don't gather either.
    """
    pairs = written(collapsed(edges), "pairs")
    shares = prepared(pairs, config)
    ids = bucketed(nodes_of(pairs) if ids is None else ids, "id", "ids")
    discard(pairs)
    ranks = ids.select("id", F.lit(1.0).alias("score"))
    if start is not None:
        ranks = ids.join(start.select("id", F.col("score").alias("__s")), "id", "left").select("id", F.coalesce("__s", F.lit(1.0)).alias("score"))
    for i in range(iterations):
        ranks = step(ids, shares, ranks, config.damping)
        if (i + 1) % config.checkpoint_every == 0 and i + 1 < iterations:
            ranks = checkpointed(ranks)
    return ranks


def sorted_ranks(ranks: DataFrame) -> DataFrame:
    """By score descending, ties by id."""
    return ranks.orderBy(F.desc("score"), "id")


def top_scores(ranks: DataFrame, n_in: DataFrame, n: int) -> DataFrame:
    """The lines ``id: score (inbound links)`` of the n best; ids are text here."""
    best = ranks.orderBy(F.desc("score"), "id").limit(n)
    lines = best.join(n_in, "id", "left").orderBy(F.desc("score"), "id")
    return lines.select(F.format_string("%s: %.6f (%d)", F.col("id"), F.col("score"), F.coalesce("n_in", F.lit(0))).alias("line"))
