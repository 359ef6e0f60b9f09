"""I9, S3 to S5, ST0 to ST2, ST6, M5: the crawl end to end over stored responses."""

import base64
import json
import os
from datetime import datetime, timedelta

import pytest
from test_images import bmp, gif, png

from linkloom import cli
from linkloom.config import CrawlConfig
from linkloom.schemas import PAGES, RESPONSES
from linkloom.sources.blobs import BlobTable
from linkloom.sources.fetch import ReplayFetcher, download_pages
from linkloom.streaming.crawl import Crawler, apply_batch

NOW = datetime(2024, 1, 1)
HTML, GIF = {"content-type": "text/html; charset=utf-8"}, {"content-type": "image/gif"}


def digest(body):
    import hashlib

    return hashlib.sha256(body).hexdigest()[:32]


INLINE, PROXIED, OPTIMISED, MOVED, STORED = gif() + b"inline", gif() + b"proxied", png() + b"optimised", bmp() + b"moved", gif() + b"stored"
START = f"""<a href="http://b.example/"><img src="data:image/gif;base64,{base64.b64encode(INLINE).decode()}" alt="inline"></a>
<a href="/in?%72ef=1&q=a%20b">in</a><img src="http://i.imgur.com/x.gif"><img src="/_next/image?url=%2Fo.png&w=96"><img src="/m1.bmp"><img src="/loop1.gif"><img src="/big.gif"><img src="/page.gif"><img src="/gone.gif">
<a href="http://prlog.ru/x"><img src="/m1.bmp?2"></a>"""
RESPONSES_AT = [
    ("http://a.example/", 200, HTML, START.encode()),
    ("https://proxy.duckduckgo.com/iu/?u=http%3A%2F%2Fi.imgur.com%2Fx.gif", 200, {"content-type": "image/x-anything"}, PROXIED),
    ("http://a.example/o.png", 200, {"content-type": "image/png"}, OPTIMISED),
    ("http://a.example/m1.bmp", 302, {"location": "m2.bmp"}, b""), ("http://a.example/m2.bmp", 301, {"location": "//cdn.example/m3.bmp"}, b""), ("http://cdn.example/m3.bmp", 200, {"content-type": "image/bmp"}, MOVED),
    ("http://a.example/m1.bmp?2", 302, {"location": "/m1.bmp"}, b""),
    ("http://a.example/loop1.gif", 302, {"location": "/loop2.gif"}, b""), ("http://a.example/loop2.gif", 302, {"location": "/loop1.gif"}, b""),
    ("http://a.example/big.gif", 200, GIF, gif(89, 31)), ("http://a.example/page.gif", 200, HTML, gif()),
    ("http://b.example/", 301, {"location": "http://www.b.example/"}, b""), ("http://www.b.example/", 200, HTML, b'<a href="http://c.example/">c</a>'),
    ("http://a.example/in?q=a+b", 302, {"location": "/elsewhere"}, b""),
]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame([(*r, NOW) for r in RESPONSES_AT], RESPONSES)


def test_pages_are_asked_once_more_on_the_same_page(spark, answers):
    asked = spark.createDataFrame([(("b.example", ""), "http://b.example/"), (("a.example", "in"), "http://a.example/in?q=a+b"), (("x_y", ""), "http://x_y/"), (("no.example", ""), "http://no.example/")], "page_id struct<host:string,path:string>, url string")
    got = {r.page_id.host: (r.url, r.status) for r in download_pages(asked, ReplayFetcher(answers)).collect()}
    assert got == {"b.example": ("http://www.b.example/", 200), "a.example": ("http://a.example/in?q=a+b", 302), "x_y": ("http://x_y/", None), "no.example": ("http://no.example/", None)}


def test_crawl_end_to_end(spark, answers, tmp_path):
    blobs = BlobTable(spark, str(tmp_path / "images"))
    blobs.add(spark.createDataFrame([("0" * 32, "gif", b"unlinked"), (digest(STORED), "gif", STORED)], "hash string, file_ext string, bytes binary"))
    old = ("http://old.example/", ("old.example", ""), NOW - timedelta(hours=1), 0, [("http://old.example/s.gif", digest(STORED), "gif", "http://a.example/", NOW, None, None, None)], ["http://a.example/in"], None)
    saves, exports = [], []
    config = CrawlConfig(initial_iterations=3, refresh_iterations=2, save_period_s=3, required_score=0.0, gc_period_s=5)
    crawler = Crawler(ReplayFetcher(answers), blobs, saves.append, exports.append, config, dump=str(tmp_path / "debug"))
    at = [NOW]

    def wait(seconds):
        at[0] += timedelta(seconds=seconds)

    crawler.start(spark.createDataFrame([old], PAGES), at[0])
    assert len(exports) == 1 and not saves
    first = {r.url for r in crawler.queue.collect()}
    assert first == {"http://a.example/", "http://a.example/in"}
    assert crawler.turn(at[0]) == 1  # one host, one request
    assert crawler.turn(at[0]) == 0  # until its time has come
    crawler.run(lambda: at[0], wait, periods=3)

    pages = {(r.page_id.host, r.page_id.path): r for r in crawler.runtime.pages.collect()}
    buttons = [(b.source, b.hash, b.file_ext, b.target, b.alt) for b in pages["a.example", ""].buttons]
    assert buttons == [
        (None, digest(INLINE), "gif", "http://b.example/", "inline"),
        ("http://i.imgur.com/x.gif", digest(PROXIED), "gif", None, None),
        ("http://a.example/o.png", digest(OPTIMISED), "png", None, None),
        ("http://cdn.example/m3.bmp", digest(MOVED), "bmp", None, None),
    ]  # the loop, the wrong size, the wrong type, the missing one and three hops are left out
    assert pages["a.example", ""].other_internal_links == ["http://a.example/in?q=a+b"]
    assert pages["b.example", ""].other_internal_links == [] and pages["b.example", ""].url == "http://www.b.example/"
    assert pages["a.example", "in"].failed >= 1  # the URL without its query has no answer
    assert {r.filename for r in blobs.names().collect()} == {f"{digest(b)}.{e}" for b, e in ((INLINE, "gif"), (PROXIED, "gif"), (OPTIMISED, "png"), (MOVED, "bmp"), (STORED, "gif"))}
    assert 1 <= len(saves) <= 3 and len(exports) == 1 + len(saves)
    assert ("prlog.ru", "x") not in pages
    assert (tmp_path / "debug" / "queue").exists() and (tmp_path / "debug" / "pagerank").exists()
    assert crawler.queue.where("status = 'in_flight'").count() == 0
    left = [p for p in crawler.stored if os.path.exists(p.removeprefix("file:"))]
    assert len(left) == len(crawler.stored) <= 8  # tables of earlier turns are gone


def test_last_response_of_a_page_counts(spark):
    """Two URLs of one page in a batch: the later one, then the greater URL; reruns agree."""
    empty = spark.createDataFrame([], "source string, hash string, file_ext string, last_visited timestamp_ntz")
    none = ReplayFetcher(spark.createDataFrame([], RESPONSES))
    rows = [("http://p.example/", 200, HTML, b"<a href=/one>", NOW), ("http://www.p.example/", 200, HTML, b"<a href=/two>", NOW), ("http://www.p.example/", 200, HTML, b"<a href=/old>", NOW - timedelta(1)), ("http://q.example/", None, None, None, None)]
    for order in (rows, rows[::-1]):
        got = apply_batch(spark.createDataFrame([], PAGES), empty, spark.createDataFrame(order, RESPONSES), none, NOW).pages.collect()
        assert {(r.url, tuple(r.other_internal_links), r.failed) for r in got} == {("http://www.p.example/", ("http://www.p.example/two",), 0), ("http://q.example/", (), 1)}


def test_missing_images_are_restored(spark, answers, tmp_path):
    """A missing image is downloaded again and kept under both hashes; the index is written anew."""
    page = ("http://a.example/", ("a.example", ""), NOW, 0, [("http://a.example/m1.bmp", "f" * 32, "bmp", None, NOW, None, None, None)], [], None)
    state = str(tmp_path / "in.json")
    from linkloom.sources import files

    files.write_state(spark.createDataFrame([page], PAGES), state)
    answers.write.parquet(str(tmp_path / "responses"))
    cli.main(["fix-images", state, str(tmp_path), "--responses", str(tmp_path / "responses")])
    assert {r.filename for r in BlobTable(spark, str(tmp_path / "images")).names().collect()} == {f"{'f' * 32}.bmp", f"{digest(MOVED)}.bmp"}
    saved = json.loads((tmp_path / "state.json").read_text())["pages"]["a.example"]["buttons"][0]["hash"]
    assert saved == digest(MOVED)  # re-keyed to the hash of the bytes that are stored
    assert json.loads((tmp_path / "index.json").read_text())["buttons"] == [saved]


def test_command_line_crawl(spark, answers, tmp_path):
    from linkloom.sources import files

    files.write_state(spark.createDataFrame([], PAGES), str(tmp_path / "in.json"))
    answers.write.parquet(str(tmp_path / "responses"))
    cli.main(["crawl", str(tmp_path / "in.json"), str(tmp_path), "--responses", str(tmp_path / "responses"), "--start-url", "http://a.example/", "--periods", "1", "--period", "1"])
    assert len(json.loads((tmp_path / "state.json").read_text())["pages"]["a.example"]["buttons"]) == 4
