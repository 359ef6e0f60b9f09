"""Small graphs and states."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.config import CrawlConfig
from linkloom.operators import edges, frontier, rank, state
from linkloom.schemas import PAGES
from linkloom.storage import written

NOW = datetime(2024, 1, 1)


def by_hand(links, steps, d=0.85):
    nodes = {n for s, t, _ in links for n in (s, t)}
    degree = {n: sum(s == n for s, *_ in links) for n in nodes}
    score = dict.fromkeys(nodes, 1.0)
    for _ in range(steps):
        score = {n: (1 - d) + d * sum(score[s] / degree[s] * w for s, t, w in links if t == n and s != n) for n in nodes}
    return score


@pytest.mark.parametrize("seed", range(3))
def test_rank_matches_plain_python(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice([1.0, 0.1, 0.02])) for _ in range(30)]
    got = {r.id: r.score for r in rank.pagerank(spark.createDataFrame(links, "src string, dst string, weight double"), 7).collect()}
    assert got == pytest.approx(by_hand(links, 7))


def test_hubs_lie_apart(spark):
    """Ranks are the same however few links make a hub; hubs' links are in no bucket."""
    rng = random.Random(7)
    links = [(f"n{rng.randrange(3)}", f"n{rng.randrange(40)}", 1.0) for _ in range(150)] + [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", 0.1) for _ in range(60)]
    df = spark.createDataFrame(links, "src string, dst string, weight double")
    want = by_hand(links, 6)
    for most in (1, 10, 10**6):
        config = CrawlConfig(hub_links=most)
        assert {r.id: r.score for r in rank.pagerank(df, 6, config=config).collect()} == pytest.approx(want)
    shares = rank.prepared(written(rank.collapsed(df), "test"), CrawlConfig(hub_links=10))
    assert shares.any and shares.few and {r.id for r in shares.hubs.collect()} == {"n0", "n1", "n2"}
    assert shares.plain.where("src in ('n0', 'n1', 'n2')").count() == 0 < shares.crowded.count()


def test_thresholds(spark):
    """One internal link gives 0.15255, crawlable; three give 0.15085, not."""
    one = [("a", "b", 0.02)]
    three = [("a", t, 0.02) for t in "bcd"]
    for links, score in ((one, 0.15255), (three, 0.15085)):
        got = {r.id: r.score for r in rank.pagerank(spark.createDataFrame(links, "src string, dst string, weight double"), 3).collect()}
        assert got["b"] == pytest.approx(score)


def pages(spark, rows):
    full = [(u, tuple(i), t, f, b, o, r) for u, i, t, f, b, o, r in rows]
    return spark.createDataFrame(full, PAGES)


def button(target):
    return ("http://i/x.gif", "h", "gif", target, NOW, None, None, None)


def test_edges(spark):
    state_ = pages(spark, [
        ("http://a/", ("a", ""), NOW, 0, [button("http://b/"), button("http://b/"), button(None)], ["http://a/x", "http://a/x/"], "http://c/"),
        ("http://web.archive.org/y", ("web.archive.org", "y"), NOW, 0, [button("http://b/")], [], None),
        ("http://capstasher.neocities.org/z", ("capstasher.neocities.org", "z"), NOW, 0, [], ["http://capstasher.neocities.org/q"], "mailto:x"),
    ])
    got = sorted((r.src.host, r.dst.host, r.dst.path, r.weight, r.kind) for r in edges.page_edges(state_).collect())
    assert got == [
        ("a", "a", "x", 0.02, "internal"), ("a", "a", "x", 0.02, "internal"), ("a", "b", "", 1.0, "button"), ("a", "b", "", 1.0, "button"), ("a", "c", "", 0.1, "redirect"),
        ("capstasher.neocities.org", "capstasher.neocities.org", "q", 1.0, "internal"),
    ]
    assert {(r.dst.host, r.url) for r in edges.unvisited_urls(edges.page_edges(state_), state_).collect()} == {("a", "http://a/x/"), ("b", "http://b/"), ("c", "http://c/"), ("capstasher.neocities.org", "http://capstasher.neocities.org/q")}


def test_due_and_backoff(spark):
    rows = [
        (0.19, NOW - timedelta(hours=720), 0, False), (0.19, NOW - timedelta(hours=720, seconds=1), 0, True), (0.21, NOW - timedelta(hours=25), 0, True), (0.2, NOW - timedelta(hours=25), 0, False),
        (0.3, NOW - timedelta(hours=3), 3, False), (0.3, NOW - timedelta(hours=5), 3, True), (0.3, NOW - timedelta(days=900), 60, False),
    ]
    df = spark.createDataFrame(rows, "score double, last_visited timestamp_ntz, failed long, want boolean")
    assert all(r.got == r.want for r in df.select("want", frontier.is_due(F.col("score"), F.col("last_visited"), F.col("failed"), NOW).alias("got")).collect())


@pytest.mark.parametrize("queue_len", [0, 9_997, 9_999, 10_000, 10_001])
def test_cap(spark, queue_len):
    rng = random.Random(queue_len)
    rows = [(f"p{i:03}", f"http://p{i}/", 1.0 - i / 1000, rng.random() < 0.5) for i in range(60)]
    want, ahead = [], 0
    for i, (_, url, _, due) in enumerate(rows):
        if i and queue_len + ahead > 10_000:
            break
        if due:
            want.append(url)
            ahead += 1
    df = spark.createDataFrame(rows, "id string, url string, score double, due boolean")
    assert [r.url for r in frontier.with_positions(frontier.capped(df, queue_len)).orderBy("pos").collect()] == want


def test_bans_apply_after_the_cap(spark):
    """T10."""
    ranks = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7)], "id string, score double")
    none = spark.createDataFrame([], "page_id string, url string, last_visited timestamp_ntz, failed long")
    urls = spark.createDataFrame([("a", "http://x.prlog.ru/"), ("b", "http://b/"), ("c", "http://c/")], "id string, url string")
    busy = spark.createDataFrame([], "id string")
    got = frontier.refreshed(ranks, none, urls, busy, 9_999, NOW, CrawlConfig())
    assert [r.url for r in got.collect()] == ["http://b/"]


def test_frontier_without_a_queue_is_whole(spark):
    """More due candidates than the cap: all of them, numbered by score and id over several partitions."""
    ids = spark.range(10_500).select(F.format_string("p%05d", "id").alias("id"), (F.lit(1.0) - F.floor(F.col("id") % 100) / 1000).alias("score"))
    known = spark.createDataFrame([], "page_id string, url string, last_visited timestamp_ntz, failed long")
    found = ids.select("id", F.concat(F.lit("http://"), "id", F.lit("/")).alias("url"))
    got = frontier.refreshed(ids, known, found, spark.createDataFrame([], "id string"), None, NOW, CrawlConfig())
    want = [r.id for r in ids.orderBy(F.desc("score"), "id").collect()]
    assert [(r.pos, r.id) for r in got.orderBy("pos").collect()] == list(enumerate(want))


def test_upsert_and_failures(spark):
    old = pages(spark, [("http://a/", ("a", ""), NOW - timedelta(days=3), 4, [button("http://b/")], [], "http://r/")])
    new = pages(spark, [("https://a", ("a", ""), NOW, 0, [], ["http://a/i"], "http://other/"), ("http://n/", ("n", ""), NOW, 0, [], [], None)])
    merged = {r.page_id.host: r for r in state.upsert(old, new).collect()}
    a = merged["a"]
    assert (a.url, a.redirects_to, a.failed, a.buttons, a.other_internal_links) == ("http://a/", "http://r/", 0, [], ["http://a/i"])  # T7, T8
    fails = spark.createDataFrame([(("a", ""), "http://a/"), (("z", ""), "http://z/")], "page_id struct<host:string,path:string>, url string")
    after = {r.page_id.host: r for r in state.record_failures(old, fails, NOW).collect()}
    assert (after["a"].failed, after["a"].last_visited, len(after["a"].buttons)) == (5, NOW, 1)
    assert (after["z"].failed, after["z"].buttons, after["z"].url) == (1, [], "http://z/")
    assert state.changed(old, new) and not state.changed(old, old)


def test_banned_targets_stay(spark):
    """Banned pages go, banned targets stay."""
    state_ = pages(spark, [("http://x.prlog.ru/", ("x.prlog.ru", ""), NOW, 0, [], [], None), ("http://a/", ("a", ""), NOW, 0, [button("http://prlog.ru/")], [], None)])
    kept = state.without_banned(state_)
    assert [r.page_id.host for r in kept.collect()] == ["a"]
    assert edges.page_edges(kept).first().dst.host == "prlog.ru"
