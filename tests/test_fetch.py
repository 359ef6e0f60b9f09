"""The HTTP fetcher against a server on this machine."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from test_images import gif

from linkloom.config import CrawlConfig
from linkloom.sources.fetch import HttpFetcher, fetch_one

BIG = gif(200, 31) + b"x" * 50_000


class _Site(BaseHTTPRequestHandler):
    def do_GET(self):
        status, kind, body = {"/": (200, "text/html", b"<p>hello" + b"y" * 9000), "/ok.gif": (200, "image/gif", gif() + b"z" * 5000), "/big.gif": (200, "image/gif", BIG), "/moved": (302, None, b""), "/long": (200, "text/html", b"w" * 30_000)}.get(self.path, (404, "text/plain", b"no"))
        self.send_response(status)
        if kind:
            self.send_header("Content-Type", kind)
        if status == 302:
            self.send_header("Location", "/ok.gif")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        try:
            self.wfile.write(body)
        except ConnectionError:
            pass

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_one_request(site):
    config = CrawlConfig(max_body_bytes=20_000, timeout_s=5)
    assert fetch_one(f"{site}/", config)["body"].startswith(b"<p>hello")
    moved = fetch_one(f"{site}/moved", config)
    assert (moved["status"], moved["headers"]["location"]) == (302, "/ok.gif")  # not followed here
    assert fetch_one(f"{site}/none", config)["status"] == 404
    assert len(fetch_one(f"{site}/ok.gif", config)["body"]) == len(gif()) + 5000
    assert len(fetch_one(f"{site}/big.gif", config)["body"]) == config.sniff_bytes  # its first bytes say that it is no badge
    assert len(fetch_one(f"{site}/long", config)["body"]) == config.max_body_bytes + 1  # enough to tell that it is too big
    assert fetch_one("http://127.0.0.1:1/", config) is None and fetch_one("nonsense", config) is None


def test_fetcher(spark, site):
    urls = spark.createDataFrame([(f"{site}/",), (f"{site}/ok.gif",), ("http://127.0.0.1:1/",)], "url string")
    got = {r.url: (r.status, r.headers["content-type"], r.fetched_at is not None) for r in HttpFetcher(CrawlConfig(concurrent_fetches=4, timeout_s=5)).fetch(urls).collect()}
    assert got == {f"{site}/": (200, "text/html", True), f"{site}/ok.gif": (200, "image/gif", True)}
