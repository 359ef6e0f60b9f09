"""Image bytes and the candidate pipeline."""

import base64
import struct
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linkloom.functions import images
from linkloom.operators import image_candidates
from linkloom.sources.fetch import ReplayFetcher

NOW = datetime(2024, 1, 1)


def gif(w=88, h=31):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"\0\0\0;"


def png(w=88, h=31):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


def bmp(w=88, h=31):
    return b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, w, h) + b"\0" * 8


def jpeg(w=88, h=31):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, h, w) + b"\0" * 10


def webp(w=88, h=31):
    return b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0" * 4 + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")


def webp_lossless(w=88, h=31):
    return b"RIFF\0\0\0\0WEBPVP8L" + struct.pack("<I", 10) + b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14)


def avif(w=88, h=31):
    return b"\0\0\0\x1cftypavif" + b"\0" * 16 + b"\0\0\0\x14ispe\0\0\0\0" + struct.pack(">II", w, h)


MAKERS = {"gif": gif, "png": png, "bmp": bmp, "jpeg": jpeg, "webp": webp, "avif": avif}


def test_sizes_and_formats(spark):
    rows = [(name, make(w, h), (w, h) == (88, 31)) for name, make in [*MAKERS.items(), ("webp", webp_lossless)] for w, h in ((88, 31), (31, 88), (88, 32))]
    rows += [("gif", gif()[:8], None), ("png", b"\x89PNG", None), ("jpeg", b"\xff\xd8\xff", None)]
    out = spark.createDataFrame(rows, "format string, body binary, want boolean").select("format", "want", images.badge_sized(F.col("body"), F.col("format")).alias("got"), images.sniffed_format(F.col("body")).alias("s"), F.octet_length("body").alias("n")).collect()
    assert all(r.got == r.want for r in out)
    assert all(r.s == r.format for r in out if r.n > 12)


def test_data_uri(spark):
    raw = gif()
    cases = [
        (f"data:image/gif;base64,{base64.b64encode(raw).decode()}", ("image/gif", raw)), ("data:,a%20b+c", ("text/plain", b"a b+c")), ("data:text/html;charset=x,<p>", ("text/html", b"<p>")),
        ("data:image/gif;base64,@@", None), ("data:nocomma", None), ("http://h/a,b", None),
    ]
    out = spark.createDataFrame([(u,) for u, _ in cases], "u string").select(images.data_uri_parts(F.col("u")).alias("p")).collect()
    assert [None if r.p is None else (r.p.mime, bytes(r.p.body)) for r in out] == [w for _, w in cases]
    kind, body = cases[0][1]
    assert images.dimensions(body, "gif") == (88, 31) and kind == "image/gif"


def candidates(spark, n, valid_at):
    return spark.createDataFrame([("p", i, f"http://h/{i}.gif", f"http://t/{i}") for i in range(n)], "page string, pos long, url string, href string").withColumn("valid", F.col("pos").isin(*valid_at) if valid_at else F.lit(False))


def test_rotation_and_abort(spark):
    """With rotated index 100 the only valid one is found; at 101 everything is dropped."""
    for n, first in ((100, 0), (101, 51), (150, 100)):
        rot = image_candidates.rotated(candidates(spark, n, []))
        assert rot.where("rot = 0").first().pos == first
    for rot_index, kept in ((99, 1), (100, 1), (101, 0)):
        n = 150
        pos = (rot_index - 50) % n
        tried = image_candidates.early_abort(image_candidates.rotated(candidates(spark, n, [pos])))
        assert tried.where("valid").count() == kept


def test_scraped(spark):
    cands = candidates(spark, 6, []).drop("valid").withColumn("alt", F.lit("a")).withColumn("title", F.lit(None).cast("string"))
    cache = [("http://h/0.gif", "old0", "gif", NOW - timedelta(hours=10)), ("http://h/1.gif", "old1", "gif", NOW - timedelta(hours=200)), ("http://h/2.gif", "old2", "gif", NOW - timedelta(hours=200))]
    cache = spark.createDataFrame(cache, "source string, hash string, file_ext string, last_visited timestamp_ntz")
    answers = [("http://h/1.gif", 200, {"content-type": "image/gif"}, gif(), NOW), ("http://h/3.gif", 200, {"content-type": "image/gif"}, gif(1, 1), NOW), ("http://h/4.gif", 404, {"content-type": "image/gif"}, gif(), NOW)]
    answers = spark.createDataFrame(answers, "url string, status int, headers map<string,string>, body binary, fetched_at timestamp_ntz")
    buttons = image_candidates.scraped(cands, cache, ReplayFetcher(answers), NOW).buttons.first().buttons
    assert [(b.pos, b.hash[:4]) for b in buttons] == [(0, "old0"), (1, buttons[1].hash[:4]), (2, "old2")]
    assert len(buttons[1].hash) == 32 and buttons[1].last_visited == NOW and buttons[2].last_visited == NOW - timedelta(hours=200)
