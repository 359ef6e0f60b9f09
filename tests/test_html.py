"""Extraction rules on literal pages; responses."""

import random
import time
from datetime import datetime

from linkloom.operators.html_links import _Found, _Parser, _plain, extract
from linkloom.operators.responses import page_rows

PAGE = """<html><body>
<a href="/first"><img src="/a.gif" alt="A" title=""></a><a href="https://t.example/?ref=1"><img src="/a.gif" alt="second"></a>
<a href="http://b.example/"><img src="b.png" width="88" height="31"></a>
<img src="c.gif" width="88px"><img src="d.gif" width="90"><img src="e.svg"><img src="f.ico"><img src="data:image/gif;base64,AA"><img>
<a href="http://h.example/p/same.gif"><img src="same.gif"></a>
<a href="#top">x</a><a href="mailto:x">m</a><a href=" /space">s</a><a href="/">root</a><a href="/in1?ref=2">i</a><a href="/in1">again</a><a href="http://other.example/">o</a>
<a href="/outer">outer<a href="/inner">nested<img src="n.gif"></a></a><a href="/dup" href="/never">d</a>
</body></html>"""


def test_rules(spark):
    pages = spark.createDataFrame([(1, "http://h.example/p/", PAGE)], "page int, url string, html string")
    candidates, internal = extract(pages)
    got = {r.url: (r.alt, r.title, r.href) for r in candidates.collect()}
    assert got == {
        "http://h.example/a.gif": ("A", None, "https://t.example/"),  # first image, last anchor (T18)
        "http://h.example/p/b.png": (None, None, "http://b.example/"),
        "http://h.example/p/c.gif": (None, None, None),  # an unreadable width passes (T17)
        "data:image/gif;base64,AA": (None, None, None),
        "http://h.example/p/": (None, None, None),  # no source: the page itself
        "http://h.example/p/same.gif": (None, None, None),  # linked to itself
        "http://h.example/p/n.gif": (None, None, "http://h.example/inner"),
    }
    assert internal.first().links == ["http://h.example/first", "http://h.example/p/same.gif", "http://h.example/", "http://h.example/in1", "http://h.example/outer", "http://h.example/dup"]


def test_caps(spark):
    hrefs = "".join(f'<a href="/l{i}">x</a>' for i in range(12))
    long = ["/" + "x" * (256 - len("http://h.example/") + extra) for extra in (0, 1)]
    html = f'<a href="{long[1]}">no</a><a href="{long[0]}">yes</a>{hrefs}'
    _, internal = extract(spark.createDataFrame([(1, "http://h.example/", html), (2, "not a url", "<a href=/x>"), (3, None, None)], "page int, url string, html string"))
    rows = {r.page: r.links for r in internal.collect()}
    assert rows == {1: ["http://h.example" + long[0], *(f"http://h.example/l{i}" for i in range(7))]}


def test_many_badges_of_one_page(spark):
    """An anchor brings its own image's URL, not all images of its page along, which took the square of their number."""
    n = 12_000
    html = "".join(f'<a href="http://t{i}.example/"><img src="i{i}.gif" alt="{"a" * 100}"></a>' for i in range(n)) + '<a href="/in">x</a>'
    began = time.monotonic()
    candidates, internal = extract(spark.createDataFrame([(1, "http://h.example/", html)], "page int, url string, html string"))
    got = {r.pos: (r.url, r.href) for r in candidates.collect()}
    assert got == {i: (f"http://h.example/i{i}.gif", f"http://t{i}.example/") for i in range(n)}
    assert internal.first().links == ["http://h.example/in"]
    assert time.monotonic() - began < 60


def test_plain_pages_are_read_as_by_the_parser():
    rng, plain = random.Random(5), 0
    bits = ["<a ", "<img ", "</a>", "</a x>", "<A HREF=", "href=", "src=", '"', "'", "/x", ">", "/>", " ", "y", "&amp;", "<template>", "</template>", "<noscript>", "<!--", "-->", 'alt="q"', "<script>", "</script>", "<image src=a>"]
    bits += ['<img src="i.gif" alt>', '<a href="/p">', "<a href=p>", '<a href="p"/>', "<a href=p/>", "<img src=i SRC=j>", "\xa0", "<title>", "</A\t>"] * 3
    for _ in range(5000):
        html = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        quick, full = _Found("http://s.example/d/"), _Found("http://s.example/d/")
        parser = _Parser(full)
        parser.feed(html)
        parser.close()
        if _plain(html, quick):
            plain += 1
            assert (quick.imgs, quick.anchors) == (full.imgs, full.anchors), html
    assert plain > 200


def test_responses(spark):
    now = datetime(2024, 1, 1)
    html = {"content-type": "text/html"}
    rows = [
        ("http://a/", 200, html, b"<p>\xff", now), ("http://b/", 200, {"content-type": "image/png"}, b"", now), ("http://c/", 301, {"location": "http://c/x"}, b"", now), ("http://d/", 301, {"location": "http://d/"}, b"", now),
        ("http://e/", 404, html, b"x", now), ("http://f/", 200, html, b"x" * (10 * 1024 * 1024 + 1), now), ("http://g/", 200, {}, b"<p>", now), ("http://h_i/", 200, html, b"", now),
    ]
    out = {r.url: r for r in page_rows(spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body binary, fetched_at timestamp_ntz")).collect()}
    kinds = {u: r.kind for u, r in out.items()}
    assert kinds == {"http://a/": "ok", "http://b/": "not_html", "http://c/": "redirect", "http://d/": "http_error", "http://e/": "http_error", "http://f/": "too_big", "http://g/": "ok", "http://h_i/": "bad_host"}
    assert out["http://a/"].html == "<p>�" and out["http://c/"].redirects_to == "http://c/x"
    assert {u for u, r in out.items() if r.is_failure} == {"http://b/", "http://h_i/"}  # T7


def test_relative_redirects(spark):
    """Locations are resolved against the URL that was asked; one that leads back to it is none."""
    now = datetime(2024, 1, 1)
    cases = [("http://a/x/y", "/new", "http://a/new"), ("http://b/x/y", "z?q", "http://b/x/z?q"), ("http://c/x", "//o/a/../b", "http://o/b"), ("http://d/x", "?p=2", "http://d/x?p=2"), ("http://e/x", "x", None), ("http://f/x", "", None)]
    rows = [(u, 302, {"location": to}, b"", now) for u, to, _ in cases] + [("http://g/", 200, {"location": "/no"}, b"", now), ("http://h/", 302, {}, b"", now)]
    out = {r.url: r for r in page_rows(spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body binary, fetched_at timestamp_ntz")).collect()}
    assert {u: out[u].redirects_to for u, _, _ in cases} == {u: want for u, _, want in cases}
    assert out["http://e/x"].kind == "http_error" and out["http://g/"].kind == "ok" and out["http://h/"].kind == "http_error"
