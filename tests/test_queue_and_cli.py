"""M3 to M5, M10, S2, M6, P11 and the command line."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom import cli
from linkloom.config import CrawlConfig
from linkloom.functions.url_join import original_image, original_images
from linkloom.operators import initial, queue
from linkloom.schemas import PAGES
from linkloom.sources import files

NOW = datetime(2024, 1, 1)
QUEUE = "page_id struct<host:string,path:string>, url string, seq long, status string"


def test_queue(spark):
    empty = spark.createDataFrame([], QUEUE)
    urls = spark.createDataFrame([("http://a.example/x/", 2), ("http://www.a.example/x", 1), ("http://prlog.ru/", 3), ("http://b.example/", 4), ("http://c.example/", 5)], "url string, seq long")
    q = queue.enqueue(empty, urls)
    assert sorted((r.url, r.status) for r in q.collect()) == [("http://b.example/", "queued"), ("http://c.example/", "queued"), ("http://www.a.example/x", "queued")]
    times = spark.createDataFrame([("a.example", 500), ("b.example", 2000)], "rate_key string, next_ms long")
    free = queue.next_admissible(q.withColumn("url", F.replace("url", F.lit("example"), F.lit("example"))), times, 1000)
    assert {r.rate_key for r in free.collect()} == {"a.example", "c.example"}
    q = queue.start(q, q.where("seq = 1"))
    assert q.where("status = 'in_flight'").count() == 1
    assert queue.enqueue(q, urls).count() == q.count()
    ids = q.select("page_id")
    assert queue.is_busy(q, ids).count() == 3
    assert queue.finish(q, ids.where("page_id.host = 'a.example'")).count() == 2


def page(url, host, path, buttons=(), internal=(), redirect=None, failed=0):
    made = [("http://i/x.gif", "h" * 32, "gif", t, NOW, None, "alt", None) for t in buttons]
    return (url, (host, path), NOW - timedelta(days=40), failed, made, list(internal), redirect)


def test_initial_state_and_refresh(spark):
    rows = [page("http://a/", "a", "", ["http://b/", "http://c/"], ["http://a/x"]), page("http://b/", "b", "", ["http://a/"]), page("http://dvd-rank.com/", "dvd-rank.com", "", ["http://a/"])]
    runtime = initial.initial(spark.createDataFrame(rows, PAGES), CrawlConfig(initial_iterations=5))
    assert {r.page_id.host for r in runtime.pages.collect()} == {"a", "b"}
    assert runtime.cache.count() == 1 and {r.url for r in runtime.unvisited.collect()} == {"http://c/", "http://a/x"}
    busy = spark.createDataFrame([(("b", ""),)], "page_id struct<host:string,path:string>")
    got = [(r.url, r.reason) for r in initial.next_urls(runtime, busy, 0, NOW).orderBy("pos").collect()]
    assert got[0] == ("http://a/", "recrawl") and ("http://c/", "unvisited") in got and all(u != "http://b/" for u, _ in got)


def test_start_url(spark):
    none = spark.createDataFrame([], PAGES)
    config = CrawlConfig(initial_iterations=1, refresh_iterations=1, start_url="http://start.example/")
    busy = spark.createDataFrame([], "page_id struct<host:string,path:string>")
    assert [r.url for r in initial.next_urls(initial.initial(none, config), busy, 0, NOW, config).collect()] == ["http://start.example/"]


@pytest.mark.parametrize(("url", "want"), [("https://h/_next/image?url=%2Fa.png&w=1", "https://h/a.png"), ("https://h/_next/image?w=1", "https://h/_next/image?w=1"), ("https://h/a?url=x", "https://h/a?url=x")])
def test_original_image(spark, url, want):
    assert original_image(url) == want
    assert spark.createDataFrame([(url,)], "u string").select(original_images(F.col("u"))).first()[0] == want


def test_command_line(spark, tmp_path):
    state = str(tmp_path / "state.json")
    files.write_state(spark.createDataFrame([page("http://a/", "a", "", ["http://b/"])], PAGES), state)
    cli.main(["snapshot", state, str(tmp_path)])
    assert json.loads((tmp_path / "index.json").read_text())["pages"] == ["a", "b"]
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "orphan.gif").write_bytes(b"x")
    cli.main(["gc", state, str(tmp_path / "blobs")])
    assert (tmp_path / "blobs" / "orphan.gif").exists()
    cli.main(["gc", state, str(tmp_path / "blobs"), "--apply"])
    assert not (tmp_path / "blobs" / "orphan.gif").exists()
