"""The index, exports, state files, garbage collection, streaming."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.config import CrawlConfig
from linkloom.operators import maintenance, snapshot, state
from linkloom.plans.fixtures import spark_view
from linkloom.schemas import PAGES
from linkloom.sources import files
from linkloom.sources.fetch import ReplayFetcher
from linkloom.storage import broadcast_if_small
from linkloom.streaming import crawl, limiter

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 1, 1, 10, 30)


@pytest.mark.parametrize("chunk", [7, 65536])
def test_index_invariants(spark, tmp_path, chunk):
    occ, hops = spark_view(spark, SF, "button_occ"), spark_view(spark, SF, "redirects")
    tables = snapshot.snapshot(occ, hops, CrawlConfig(chunk_links=chunk))
    assert all(len(r.links) <= chunk for r in tables["page_links"].collect())
    files.write_snapshot(tables, str(tmp_path), {})
    data = json.loads((tmp_path / "index.json").read_text())
    assert decode((tmp_path / "index.cbor").read_bytes())[0] == data
    total = occ.count()
    for name in ("pages", "buttons", "texts"):
        assert len(set(data[name])) == len(data[name])
    assert data["buttons"] == sorted(data["buttons"]) and data["texts"] == sorted(data["texts"])
    aligned = [data[n] for n in ("links", "link_buttons", "link_button_alts", "link_button_titles", "link_button_filenames")]
    assert all(len({len(x) for x in row}) == 1 for row in zip(*aligned))
    assert sum(map(len, data["links"])) == total == sum(map(len, data["button_backlinks"]))
    forward = sorted((p, d, b) for p, (ls, bs) in enumerate(zip(data["links"], data["link_buttons"])) for d, b in zip(ls, bs) if d is not None)
    backward = sorted((s, p, b) for p, (ls, bs) in enumerate(zip(data["backlinks"], data["backlink_buttons"])) for s, b in zip(ls, bs))
    assert forward == backward
    assert len(data["links"]) == len(data["pages"]) and len(data["button_names"]) == len(data["button_file_exts"]) == len(data["buttons"])


def test_one_hop_only(spark):
    """Chains of redirects are followed once."""
    occ = spark.createDataFrame([("a", "", 0, "h", "gif", None, "http://b/", None, None, NOW)], "host string, path string, pos long, hash string, file_ext string, source string, target string, alt string, title string, last_visited timestamp_ntz")
    hops = spark.createDataFrame([("a", "", "b", ""), ("b", "", "c", ""), ("c", "", "d", "")], "host string, path string, to_host string, to_path string")
    r = snapshot.resolved(occ, hops).first()
    assert (r.src.host, r.dst.host) == ("b", "c")


def test_export_files(spark, tmp_path):
    occ, hops = spark_view(spark, SF, "button_occ").limit(300), spark_view(spark, SF, "redirects")
    files.write_snapshot(snapshot.snapshot(occ, hops), str(tmp_path), state.stats(occ).first().asDict())
    assert json.loads((tmp_path / "stats.json").read_text())["buttons"] == occ.select("hash").distinct().count()
    data = json.loads((tmp_path / "index.json").read_text())
    raw = (tmp_path / "index.cbor").read_bytes()
    assert decode(raw)[0] == data


def decode(raw, at=0):
    major, low = raw[at] >> 5, raw[at] & 31
    at += 1
    if low >= 24 and major != 7:
        size = 1 << low - 24
        low, at = int.from_bytes(raw[at : at + size], "big"), at + size
    if major == 0:
        return low, at
    if major == 1:
        return -1 - low, at
    if major == 3:
        return raw[at : at + low].decode(), at + low
    if major in (4, 5):
        out = []
        for _ in range(low * (major - 3)):
            v, at = decode(raw, at)
            out.append(v)
        return (out if major == 4 else dict(zip(out[::2], out[1::2]))), at
    return {20: False, 21: True, 22: None}[low], at


def test_cbor_numbers():
    for n in (0, 23, 24, 255, 256, 65536, 1 << 40, -1, -500):
        assert decode(files.cbor(n))[0] == n


def test_state_round_trip(spark, tmp_path):
    rows = [
        ("http://a/", ("a", ""), NOW, 2, [("http://i/x.gif", "h1", "gif", None, NOW, ("http://old/", NOW), "alt", None), (None, "h2", "png", "http://t/", NOW, None, None, "ti")], ["http://a/é"], None),
        ("http://b/p", ("b", "p"), NOW, 0, [], [], "http://c/"),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    path = str(tmp_path / "state.json")
    files.write_state(pages, path)
    text = json.loads(open(path).read())["pages"]
    assert "failed" not in text["b/p"] and text["a"]["failed"] == 2 and text["a"]["buttons"][0]["target"] is None and "title" not in text["a"]["buttons"][0]
    back = files.read_state(spark, path)
    assert not state.changed(pages, back.select(pages.columns))
    (tmp_path / "old.json").write_text('{"pages": {"x/y/": {"url": "http://x/y", "last_visited": "2024-01-01T10:30:00.123456789Z", "buttons": []}}}')
    old = files.read_state(spark, str(tmp_path / "old.json")).first()
    assert (tuple(old.page_id), old.failed, old.other_internal_links, old.redirects_to) == (("x", "y"), 0, [], None)


def test_blobs_and_gc(spark, tmp_path):
    for name in ("h1.gif", "h2.png", "lost.gif"):
        (tmp_path / name).write_bytes(name.encode())
    occ = spark.createDataFrame([("h1", "gif"), ("h2", "png")], "hash string, file_ext string")
    gone = [r.filename for r in maintenance.unlinked(files.blob_names(spark, str(tmp_path)), occ).collect()]
    assert gone == ["lost.gif"]
    assert maintenance.delete_files(spark, str(tmp_path), gone) == 1
    assert (tmp_path / "lost.gif").exists()
    maintenance.delete_files(spark, str(tmp_path), gone, apply=True)
    assert not (tmp_path / "lost.gif").exists()
    stored, mapping = maintenance.reencode(files.blobs(spark, str(tmp_path)), lambda b, f: b + b"!" if f == "gif" else b)
    assert stored.count() == 2 and {r.old_hash for r in mapping.collect()} == {"h1", "h2"}


def test_crawl_stream(spark, tmp_path):
    """Responses arrive as files; pages, links and failures reach the state."""
    html = b'<a href="/in">x</a><a href="http://t.example/"><img src="/b.gif" alt="B"></a>'
    kind = {"content-type": "text/html"}
    fetched = [("http://h.example/", 200, kind, html, NOW), ("http://e.example/", 404, kind, b"", NOW), ("http://n.example/", 200, {"content-type": "text/plain"}, b"", NOW), ("http://r.example/", 301, {"location": "http://s.example/"}, b"", NOW)]
    schema = "url string, status int, headers map<string,string>, body binary, fetched_at timestamp_ntz"
    from test_images import gif

    images = spark.createDataFrame([("http://h.example/b.gif", 200, {"content-type": "image/gif"}, gif(), NOW)], schema)
    cache = spark.createDataFrame([], "source string, hash string, file_ext string, last_visited timestamp_ntz")
    spark.createDataFrame(fetched, schema).write.parquet(str(tmp_path / "in"))
    held = {"pages": spark.createDataFrame([], PAGES), "saves": 0}

    def save(df):
        held.update(pages=df, saves=held["saves"] + 1)

    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    crawl.run_stream(source, lambda: held["pages"], save, lambda p, b: crawl.apply_batch(p, cache, b, ReplayFetcher(images), NOW).pages, str(tmp_path / "cp")).awaitTermination()
    got = {r.page_id.host: r for r in held["pages"].collect()}
    page = got["h.example"]
    assert page.other_internal_links == ["http://h.example/in"] and page.buttons[0].target == "http://t.example/" and page.buttons[0].alt == "B" and len(page.buttons[0].hash) == 32
    assert (got["e.example"].failed, got["n.example"].failed, got["r.example"].redirects_to) == (0, 1, "http://s.example/")
    assert held["saves"] == 1


def test_positions_of_dense_index(spark):
    df = spark.range(5000).select(F.format_string("k%05d", F.col("id") % 3000).alias("k"))
    rows = [tuple(r) for r in snapshot.dense_index(df, "k").orderBy("idx").collect()]
    assert rows == [(f"k{i:05}", i) for i in range(3000)]


def test_state_folder(spark, tmp_path):
    """State as a Parquet folder: written twice, read back, ordered by id."""
    rows = [(f"http://h{i}/", (f"h{i}", ""), NOW, i, [], [], None) for i in range(50)]
    pages, path = spark.createDataFrame(rows, PAGES), str(tmp_path / "state")
    files.write_state(pages.limit(3), path)
    files.write_state(pages, path)
    back = files.read_state(spark, path)
    assert not state.changed(pages, back.select(pages.columns))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["state"]


def test_limiter_jumps():
    """Bisection against the fold request by request."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        times = np.sort(rng.integers(0, 20_000, rng.integers(0, 60)))
        delays = np.full(len(times), rng.integers(1, 11))
        start = next_ms = int(rng.integers(-5000, 10_000))
        want = []
        for t, d in zip(times, delays):
            want.append(t >= next_ms)
            next_ms = t + 1000 * d if t >= next_ms else next_ms
        got, after = limiter.admit(times, delays, start)
        assert got.tolist() == want and after == next_ms


def test_pages_of_a_common_image(spark):
    rows = [(f"h{i % 500}", "", "common") for i in range(1000)] + [("h1", "x", "rare")]
    occ = spark.createDataFrame(rows, "host string, path string, hash string")
    got = maintenance.pages_of_hash(occ, CrawlConfig(chunk_links=60)).collect()
    assert sorted((p.host, p.path) for r in got if r.hash == "common" for p in r.pages) == sorted({(h, p) for h, p, x in rows if x == "common"})
    assert len([r for r in got if r.hash == "common"]) == 9 and max(len(r.pages) for r in got) < 120


def test_broadcast_counts_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "UnresolvedHint" in df._jdf.queryExecution().logical().toString()
    small = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert hinted(broadcast_if_small(small, 10)) and not hinted(broadcast_if_small(small, 9)) and not hinted(broadcast_if_small(small, 10, 9_000))
