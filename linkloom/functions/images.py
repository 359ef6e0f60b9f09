"""Image bytes: formats, dimensions, hashes and data URIs."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig

# Accepted media types, extensions and leading bytes.
MIME_FORMATS = {
    "image/png": "png", "image/jpeg": "jpeg", "image/jpg": "jpeg", "image/gif": "gif", "image/webp": "webp",
    "image/avif": "avif", "image/bmp": "bmp", "image/x-ms-bmp": "bmp",
}
EXTENSIONS = {"png": "png", "jpeg": "jpg", "gif": "gif", "webp": "webp", "avif": "avif", "bmp": "bmp"}
MAGIC = (("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif"), ("424D", "bmp"))


def mime_format(mime: Column) -> Column:
    """The format of a media type without its parameters; null for others."""
    bare = F.trim(F.substring_index(mime, ";", 1))
    pairs = [F.lit(x) for kv in MIME_FORMATS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), bare)


def file_ext(image_format: Column) -> Column:
    """P18."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), image_format)


def sniffed_format(body: Column) -> Column:
    """The format that the leading bytes tell."""
    head = F.hex(F.substring(body, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    out = out.when(F.substring(head, 9, 16).isin("6674797061766966", "6674797061766973"), "avif")
    for magic, name in MAGIC:
        out = out.when(head.startswith(magic), name)
    return out


def format_of(data: bytes) -> str | None:
    """P15 of bytes at hand."""
    head = data[:12].hex().upper()
    if head.startswith("52494646") and head[16:24] == "57454250":
        return "webp"
    if head[8:24] in ("6674797061766966", "6674797061766973"):
        return "avif"
    return next((name for magic, name in MAGIC if head.startswith(magic)), None)


def content_hash(body: Column) -> Column:
    """The first 16 bytes of SHA-256, in hexadecimal."""
    return F.substring(F.sha2(body, 256), 1, 32)


def dimensions(data: bytes, image_format: str | None) -> tuple[int, int] | None:
    """Width and height from the header; None if it can't be told."""
    try:
        if image_format == "png":
            return struct.unpack(">II", data[16:24]) if data[12:16] == b"IHDR" else None
        if image_format == "gif":
            return struct.unpack("<HH", data[6:10])
        if image_format == "bmp":
            if struct.unpack("<I", data[14:18])[0] == 12:
                return struct.unpack("<HH", data[18:22])
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if image_format == "jpeg":
            return _jpeg(data)
        if image_format == "webp":
            return _webp(data)
        if image_format == "avif":
            at = data.find(b"ispe")
            return struct.unpack(">II", data[at + 8 : at + 16]) if at >= 0 else None
    except struct.error:
        pass
    return None


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None


def _webp(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def badge_sized(body: Column, image_format: Column, config: CrawlConfig = DEFAULT) -> Column:
    """Whether an image is 88 by 31; null where the header doesn't tell. Formats with a fixed
    header are compared natively; only JPEG, WebP and AVIF headers are walked in Python."""
    w, h = config.badge_width, config.badge_height
    at = lambda start, n: F.hex(F.substring(body, start, n))
    gif, png, bmp = struct.pack("<HH", w, h).hex().upper(), struct.pack(">II", w, h).hex().upper(), [struct.pack("<ii", w, up).hex().upper() for up in (h, -h)]  # from the top down, heights are negative

    @F.arrow_udf("boolean")
    def walked(bodies: pa.Array, formats: pa.Array) -> pa.Array:
        found = (dimensions(b or b"", f) for b, f in zip(bodies.to_pylist(), formats.to_pylist(), strict=True))
        return pa.array([None if d is None else d == (w, h) for d in found], pa.bool_())

    long_enough = lambda n: F.octet_length(body) >= n
    return (
        F.when(image_format == "gif", F.when(long_enough(10), at(7, 4) == gif))
        .when(image_format == "png", F.when(long_enough(24), at(17, 8) == png))
        .when((image_format == "bmp") & long_enough(26) & (at(15, 4) != "0C000000"), at(19, 8).isin(bmp))
        .otherwise(walked(body, image_format))
    )


def decode_data_uri(uri: str) -> tuple[str, bytes] | None:
    """Media type and bytes of a ``data:`` URI; None if it isn't one or doesn't decode."""
    if not uri.lower().startswith("data:") or "," not in uri:
        return None
    head, _, body = uri[5:].partition(",")
    media, _, coding = head.rpartition(";") if ";" in head else (head, "", "")
    raw = _percent_decoded(body.partition("#")[0])
    if coding == "base64":
        try:
            raw = base64.b64decode(raw, validate=True)
        except ValueError:
            return None
    return media or "text/plain", raw


def _percent_decoded(text: str) -> bytes:
    out, data, at = bytearray(), text.encode(), 0
    while at < len(data):
        pair = data[at + 1 : at + 3]
        if data[at] == 0x25 and len(pair) == 2 and all(c in b"0123456789abcdefABCDEF" for c in pair):
            out.append(int(pair, 16))
            at += 3
        else:
            out.append(data[at])
            at += 1
    return bytes(out)


def data_uri_parts(uri: Column) -> Column:
    """S5 as a column: struct of ``mime`` and ``body``, null where it doesn't decode."""

    @F.arrow_udf("struct<mime: string, body: binary>")
    def decoded(uris: pa.Array) -> pa.Array:
        found = (decode_data_uri(u) if u else None for u in uris.to_pylist())
        return pa.array([None if f is None else {"mime": f[0], "body": f[1]} for f in found], pa.struct([("mime", pa.string()), ("body", pa.binary())]))

    return decoded(uri)


Normalizer = Callable[[bytes, str], bytes]


def identity_normalizer(data: bytes, image_format: str) -> bytes:
    """Bytes as received. Re-encoding differs between encoder versions, so it is left to the caller."""
    return data


def re_encoded(body: Column, image_format: Column, normalizer: Normalizer = identity_normalizer) -> Column:
    """A pluggable re-encoder; images it fails on become null."""
    if normalizer is identity_normalizer:
        return body

    @F.arrow_udf("binary")
    def run(bodies: pa.Array, formats: pa.Array) -> pa.Array:
        out = []
        for b, f in zip(bodies.to_pylist(), formats.to_pylist(), strict=True):
            try:
                out.append(None if b is None else normalizer(b, f))
            except Exception:  # noqa: BLE001 - a broken image is dropped, not the job
                out.append(None)
        return pa.array(out, pa.binary())

    return run(body, image_format)
