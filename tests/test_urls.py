"""Literal cases."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import hosts, images, urls
from linkloom.functions.url_join import join

IDS = [
    ("http://h/index.html", "h", "index.html"),
    ("http://h/a/index.html", "h", "a"),
    ("http://h/a/index.html/", "h", "a/index.html"),
    ("http://www.www.x/", "x", ""),
    ("https://X.example:8080/A//b/?q#f", "x.example", "A//b"),
    ("http://user:pw@h.example/p", "h.example", "p"),
    ("http://h//two", "h", "two"),
    ("http://1.2.3.4/x/", "1.2.3.4", "x"),
    ("http://[::1]:80/x", "[::1]", "x"),
    ("data:text/plain,hi", "", "text/plain,hi"),
    ("http://é.example/ü", "é.example", "ü"),
]

CLEANED = [
    ("http://h/?ref=a", "http://h/"),
    ("http://h/?si=", "http://h/"),
    ("http://h/?a=1&ref=2", "http://h/?a=1"),
    ("http://h/?", "http://h/"),
    ("http://h/?a", "http://h/?a="),
    ("http://h/?refx=1&si=2&b=3#f", "http://h/?refx=1&b=3"),
    ("https://www.youtube.com/watch?list=a&v=Q1&si=x", "https://www.youtube.com/watch?v=Q1"),
    ("https://www.youtube.com/watch?list=a", "https://www.youtube.com/watch?list=a"),
    ("https://youtu.be/Q1?si=x", "https://www.youtube.com/watch?v=Q1"),
    ("http://h:80/p", "http://h/p"),
    ("http://h:443/p#f", "http://h/p"),
    ("http://h:8080/p", "http://h:8080/p"),
]

DELAYS = [
    ("a.b.neocities.org", "neocities.org", 1), ("web.archive.org", "web.archive.org", 10), ("x.web.archive.org", "web.archive.org", 10), ("archive.org", "archive.org", 1),
    ("x.co.uk", "co.uk", 1), ("jcink.net", "jcink.net", 10), ("a.jcink.net", "jcink.net", 10), ("localhost", "localhost", 1), ("1.2.3.4", "3.4", 1),
]


def test_page_ids(spark):
    rows = spark.createDataFrame([(u,) for u, *_ in IDS], "u string").select("u", urls.page_id(F.col("u")).alias("k")).collect()
    assert [(r.u, r.k.host, r.k.path) for r in rows] == IDS


def test_page_id_text_round_trip(spark):
    rows = spark.createDataFrame([(u,) for u, *_ in IDS[:7]], "u string").select(urls.page_id(F.col("u")).alias("k"))
    text = rows.select("k", urls.page_id_text(F.col("k.host"), F.col("k.path")).alias("t")).select("k", urls.page_id_parse(F.col("t")).alias("p"))
    assert all(r.k == r.p for r in text.collect())


def test_page_id_order_is_by_parts(spark):
    """T14."""
    rows = spark.createDataFrame([("a", "b"), ("a-b", "")], "host string, path string").orderBy(F.struct("host", "path")).collect()
    assert [tuple(r) for r in rows] == [("a", "b"), ("a-b", "")]


def test_clean_up(spark):
    rows = spark.createDataFrame([(u,) for u, _ in CLEANED], "u string").select("u", urls.clean_page_url(F.col("u")).alias("c")).collect()
    assert [(r.u, r.c) for r in rows] == CLEANED


def test_delays(spark):
    rows = spark.createDataFrame([(h,) for h, *_ in DELAYS], "h string").select("h", hosts.rate_key(F.col("h")).alias("k")).collect()
    assert [(r.h, r.k.rate_key, r.k.delay_s) for r in rows] == DELAYS


def test_hosts(spark):
    rows = spark.createDataFrame([("a.x.org",), ("x.org",), ("ax.org",), ("1.2.3.4",)], "h string").select(
        hosts.host_in(F.col("h"), ["x.org"]).alias("a"), hosts.url_host_in(F.concat(F.lit("http://"), F.col("h")), ["x.org", "1.2.3.4"]).alias("b"), hosts.shorten_host(F.col("h")).alias("c")
    )
    assert [tuple(r) for r in rows.collect()] == [(True, True, "x.org"), (True, True, None), (False, False, None), (False, False, "2.3.4")]


@pytest.mark.parametrize(
    ("base", "reference", "want"),
    [
        ("http://h/a/b", "c", "http://h/a/c"), ("http://h/a/b?q#f", "", "http://h/a/b?q"), ("http://h/a/b", "../../x/./y", "http://h/x/y"), ("http://h/a/", "/é b", "http://h/%C3%A9%20b"),
        ("https://h/a", "//X.org:443/p", "https://x.org/p"), ("http://h/a", "HTTP://Y.org:8080", "http://y.org:8080/"), ("http://h/a", "?q=1", "http://h/a?q=1"), ("http://h/a?x", "#f", "http://h/a?x#f"),
        ("http://h/a", "mailto:me", "mailto:me"), ("http://h/a", "http://", None), ("http://h/a", "http://h:99999/", None), (None, "rel", None), ("http://h/a", " \tb\n", "http://h/b"),
        ("http://h/a/b", "..\\c", "http://h/c"), ("http://h/", "data:image/gif;base64,AA", "data:image/gif;base64,AA"), ("http://h/x/", "..", "http://h/"), ("http://h/x/y", "http:z", "http://h/x/z"),
        ("http://h/", "http://bücher.example/", "http://xn--bcher-kva.example/"),
    ],
)
def test_join(base, reference, want):
    assert join(base, reference) == want


@given(st.text(max_size=30))
def test_join_is_stable(text):
    once = join("http://h.example/a/b", text)
    assert once is None or join(None, once) == once or not once.startswith("http")


def test_image_hosts(spark):
    cases = {"http://i.imgur.com/a.gif": "https://proxy.duckduckgo.com/iu/?u=http%3A%2F%2Fi.imgur.com%2Fa.gif", "http://oi5.tinypic.com/a": "https://web.archive.org/web/0if_/http://oi5.tinypic.com/a", "http://ok/a": "http://ok/a"}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.proxied_image_url(F.col("u")).alias("p")).collect()
    assert {r.u: r.p for r in rows} == cases


def test_hash_is_sixteen_bytes(spark):
    """T12."""
    assert spark.sql("select cast('x' as binary) b").select(images.content_hash(F.col("b"))).first()[0] == "2d711642b726b04401627ca9fbac32f5"
