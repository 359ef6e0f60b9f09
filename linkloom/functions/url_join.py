"""Resolving and normalising URLs as browsers do: the part that native expressions can't do.

A hand-written subset of the URL standard for the special schemes (http, https, ws, wss, ftp,
file) and opaque ones such as ``data:``.
"""

from __future__ import annotations

import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Default ports and the characters that each part percent-encodes.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21", "file": ""}
PATH_ENCODED = frozenset(" \"#<>?^`{}")
QUERY_ENCODED = frozenset(" \"#<>'")
FRAGMENT_ENCODED = frozenset(" \"<>`")
BAD_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)", re.S)


def encoded(text: str, marked: frozenset[str]) -> str:
    out = []
    for c in text:
        if c in marked or ord(c) < 0x20 or ord(c) > 0x7E:
            out.append("".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")))
        else:
            out.append(c)
    return "".join(out)


def _host(text: str) -> str | None:
    if text.startswith("["):
        return text.lower() if text.endswith("]") else None
    text = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)
    try:
        text = text.encode("ascii").decode().lower() if text.isascii() else text.lower().encode("idna").decode()
    except UnicodeError:
        return None
    return None if not text or BAD_HOST.search(text) else text


def _segments(path: str, base: list[str]) -> list[str]:
    out = list(base)
    parts = path.split("/")
    for i, part in enumerate(parts):
        low, last = part.lower().replace("%2e", "."), i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(encoded(part, PATH_ENCODED))
    return out


def join(base: str | None, reference: str) -> str | None:
    """``reference`` against an already normalised ``base``; None if it isn't a URL."""
    text = re.sub(r"[\t\n\r]", "", reference.strip("".join(map(chr, range(0x21)))))
    body, hash_, fragment = text.partition("#")
    tail = f"#{encoded(fragment, FRAGMENT_ENCODED)}" if hash_ else ""
    found = SCHEME.match(body)
    scheme, rest = (found[1].lower(), found[2]) if found else (None, body)
    old = SCHEME.match(base) if base else None
    base_scheme = old[1].lower() if old else None
    if scheme and scheme not in DEFAULT_PORTS:
        return f"{scheme}:{encoded(rest, frozenset())}{tail}"
    if not scheme and base_scheme not in DEFAULT_PORTS:
        return f"{base.partition('#')[0]}{tail}" if base_scheme and not body else None
    kind = scheme or base_scheme
    rest, question, query = rest.partition("?")
    rest = rest.replace("\\", "/")
    asked = f"?{encoded(query, QUERY_ENCODED)}" if question else ""
    absolute = scheme is not None and (scheme != base_scheme or rest.startswith("//"))
    if absolute or (rest.startswith("//") and kind != "file"):
        rest = rest.lstrip("/")
        authority, slash, path = rest.partition("/")
        user, at, place = authority.rpartition("@")
        if place.startswith("["):
            name, _, port = place.partition("]")
            name, port = name + "]", port.lstrip(":")
        else:
            name, _, port = place.partition(":")
        host = _host(name)
        if host is None or (port and (not port.isascii() or not port.isdigit() or int(port) > 65535)):
            return None
        shown = f":{int(port)}" if port and str(int(port)) != DEFAULT_PORTS[kind] else ""
        path = "/".join(_segments(path, []))
        return f"{kind}://{user + '@' if at else ''}{host}{shown}/{path}{asked}{tail}"
    origin, base_path, base_query = re.match(r"([^:]+:(?://[^/?#]*)?)([^?#]*)(\?[^#]*)?", base).group(1, 2, 3)
    if not rest and not question:
        return f"{origin}{base_path}{base_query or ''}{tail}"
    if not rest:
        return f"{origin}{base_path}{asked}{tail}"
    stem = [] if rest.startswith("/") else base_path.lstrip("/").split("/")[:-1]
    path = "/".join(_segments(rest[1:] if rest.startswith("/") else rest, stem))
    return f"{origin}/{path}{asked}{tail}"


def original_image(url: str) -> str:
    """The image that an image-optimising endpoint was given, else the URL itself."""
    found = re.match(r"[a-z]+://[^/?#]*/_next/image\?([^#]*)", url)
    for pair in found[1].split("&") if found else ():
        name, _, value = pair.partition("=")
        if unquote_plus(name) == "url":
            return join(url, unquote_plus(value)) or url
    return url


def original_images(url: Column) -> Column:
    @F.arrow_udf("string")
    def run(urls: pa.Array) -> pa.Array:
        return pa.array([None if u is None else original_image(u) for u in urls.to_pylist()], pa.string())

    return F.when(url.contains("/_next/image"), run(url)).otherwise(url)


def redirect_target(url: Column, status: Column, location: Column) -> Column:
    """Where a 3xx response leads, resolved against its URL; null if nowhere. Only such rows are resolved."""
    leads = status.between(300, 399) & location.rlike(r"^[\x20-\x7E\t]*$")
    return F.get(joined(F.when(leads, url), F.when(leads, F.array(location))), F.lit(0))


def joined(base: Column, references: Column) -> Column:
    """An array of references resolved against one base each row; null where one isn't a URL."""

    @F.arrow_udf("array<string>")
    def run(bases: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for b, refs in zip(bases.to_pylist(), lists.to_pylist(), strict=True):
            own = join(None, b) if b else None
            out.append(None if refs is None else [None if r is None else join(own, r) for r in refs])
        return pa.array(out, pa.list_(pa.string()))

    return run(base, references)
