"""URL expressions over normalised absolute URLs: page ids, clean-up, proxies. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig

#: scheme, authority without user and port, path, query, fragment
URL_PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PATTERN, group)


def scheme_of(url: Column) -> Column:
    return F.lower(url_part(url, 1))


def host_of(url: Column) -> Column:
    """Lower-case host without port or user; empty where there is none."""
    return F.lower(url_part(url, 2))


def path_of(url: Column) -> Column:
    return url_part(url, 4)


def page_id(url: Column) -> Column:
    """The lossy page key. Leading ``www.`` repeats go, then slashes and ``/index.html`` in that order."""
    host = F.regexp_replace(host_of(url), r"^(www\.)+", "")
    path = F.regexp_replace(path_of(url), r"^/+", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index\.html)+$", ""), r"/+$", "")
    return F.struct(host.alias("host"), path.alias("path"))


def page_id_text(host: Column, path: Column) -> Column:
    """``host`` or ``host/path``."""
    return F.when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))


def page_id_parse(text: Column) -> Column:
    """Trailing slashes trimmed, split at the first slash."""
    trimmed = F.regexp_replace(text, r"/+$", "")
    return F.struct(F.substring_index(trimmed, "/", 1).alias("host"), F.regexp_extract(trimmed, r"^[^/]*/(.*)$", 1).alias("path"))


def source_filename(source: Column) -> Column:
    """The last path segment up to its first dot; null for a null source, may be empty."""
    path = F.regexp_replace(path_of(source), r"/+$", "")
    return F.when(source.isNotNull(), F.substring_index(F.substring_index(path, "/", -1), ".", 1))


def form_decoded(text: Column) -> Column:
    """A name or value of a form-encoded query: plus signs are spaces, percent signs before no digits stand for themselves."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def drop_tracking(query: Column, config: CrawlConfig = DEFAULT) -> Column:
    """Pairs of a query, decoded and encoded anew as forms are, without those of a tracking parameter; empty ones vanish."""
    names = [F.lit(p) for p in config.tracking_params]
    part = lambda p, i: form_decoded(F.regexp_extract(p, "^([^=]*)=?(.*)$", i))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(part(p, 1).alias("name"), part(p, 2).alias("value")))
    kept = F.filter(pairs, lambda p: ~p["name"].isin(*names))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")


def query_encoded(text: Column) -> Column:
    """Text as a URL's query holds it: only what a query can't hold is percent-encoded."""
    # Fixed value: the characters that stand for themselves there.
    fits = r"[!$-&(-;=?-~]"
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(fits), c).when(c == " ", F.lit("%20")).otherwise(F.url_encode(c))), "")


def clean_page_url(url: Column, config: CrawlConfig = DEFAULT) -> Column:
    """Tracking parameters, video links, fragment and explicit 80/443 ports cleaned up."""
    scheme, host, port, path = scheme_of(url), url_part(url, 2), url_part(url, 3), path_of(url)
    asked = url_part(url, 5)
    query = F.when(asked == "", asked).otherwise(drop_tracking(asked, config))  # most have none, and pairs are costly
    video = query_encoded(form_decoded(F.regexp_extract(query, r"(?:^|&)v=([^&]*)", 1)))
    has_video = query.rlike(r"(?:^|&)v=")
    watch = (host == "www.youtube.com") & (path == "/watch") & has_video
    query = F.when(watch, F.concat(F.lit("v="), video)).otherwise(query)
    short = host == "youtu.be"
    kept_port = F.when((port == "") | port.isin("80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    usual = F.concat(scheme, F.lit("://"), host, kept_port, path, tail)
    brief = F.concat(F.lit("https://www.youtube.com/watch?v="), F.url_encode(F.regexp_extract(path, r"^/([^/]*)", 1)))
    return F.when(scheme.isin("http", "https"), F.when(short, brief).otherwise(usual)).otherwise(F.regexp_replace(url, "#.*$", ""))


def proxied_image_url(url: Column) -> Column:
    """Hosts that block or are gone are asked for through a proxy or an archive."""
    host = host_of(url)
    # The hosts and the two prefixes.
    dead = host.rlike(r"^o?i.*\.tinypic\.com$") | host.rlike(r"^img.*\.imageshack\.us$") | host.endswith(".postimg.org") | host.endswith(".nickpic.host")
    return (
        F.when(host.isin("i.imgur.com", "imgur.com"), F.concat(F.lit("https://proxy.duckduckgo.com/iu/?u="), F.url_encode(url)))
        .when(dead, F.concat(F.lit("https://web.archive.org/web/0if_/"), url))
        .otherwise(url)
    )


def is_web(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?:"), F.lit(False))
