"""Pages to candidate badges and internal links.

Python only tokenises and resolves URLs; every rule is a native expression over the tokens.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.url_join import join
from linkloom.functions.urls import clean_page_url, host_of, path_of, scheme_of

TOKENS = (
    "struct<base: string,"
    "imgs: array<struct<pos:bigint,url:string,alt:string,title:string,width:string,height:string>>,"
    "anchors: array<struct<pos:bigint,raw:string,url:string,img_url:string>>>"
)
_IMG = ("pos", "url", "alt", "title", "width", "height")
_ANCHOR = ("pos", "raw", "url", "img_url")

#: A tag, without its ``<``, that every reader takes alike: attributes apart by white space, quoted or of plain characters.
_TAG = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`/]+(?=[ \t\n\r\f>])))?)*)[ \t\n\r\f]*(/?)>""")
_ATTRIBUTE = re.compile(r"""[ \t\n\r\f]+([a-zA-Z][-a-zA-Z0-9_]*)(?:=("[^"]*"|'[^']*'|[^ \t\n\r\f]+))?""")
#: Elements whose content may be no markup, by this or a later version of the parser.
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext", *HTMLParser.CDATA_CONTENT_ELEMENTS))


class _Found:
    """Images and anchors in page order; an anchor ends where the next one starts, and the first of repeated attributes counts."""

    def __init__(self, base: str | None):
        self.base, self.imgs, self.anchors, self.open, self.hidden = base, [], [], None, False
        self.joined: dict[str, str | None] = {}

    def join(self, reference: str) -> str | None:
        if reference not in self.joined:
            self.joined[reference] = join(self.base, reference)
        return self.joined[reference]

    def made(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple | None:
        """What a start tag stands for: its kind and the values that are kept of it."""
        if tag == "template":
            return (tag,)
        if tag not in ("img", "image", "a"):
            return None
        own = dict(reversed([(k, v or "") for k, v in attrs]))
        if tag == "a":
            raw = own.get("href")
            return ("a", raw, None if raw is None else self.join(raw))
        return ("img", self.join(own.get("src", "")), *(own.get(k) for k in ("alt", "title", "width", "height")))

    def start(self, made: tuple | None) -> None:
        if self.hidden or made is None:
            return
        if made[0] == "a":
            self.open = [*made[1:], None]  # the image's URL is added once
            self.anchors.append(self.open)
            self.first = True
        elif made[0] == "img":
            self.imgs.append(made[1:])
            if self.open is not None and self.first:
                self.open[2], self.first = made[1], False
        else:
            self.hidden = True

    def end(self, tag: str) -> None:
        if tag == "template" and self.hidden:
            self.hidden = False
        elif tag == "a":
            self.open = None


class _Parser(HTMLParser):
    """Any markup, by the standard parser."""

    def __init__(self, found: _Found):
        super().__init__(convert_charrefs=True)
        self.found = found

    def handle_starttag(self, tag, attrs):
        self.found.start(self.found.made(tag, attrs))

    def handle_endtag(self, tag):
        self.found.end(tag)


def _plain(html: str, found: _Found) -> bool:
    """Tokens of a page of simple tags only, each different one read once; False as soon as a page isn't."""
    seen: dict[str, tuple[bool, str | tuple | None]] = {}
    parts = iter(html.split("<"))
    next(parts)
    for part in parts:
        told = seen.get(part)
        if told is None:
            tag = _TAG.match(part)
            if tag is None:
                return False
            name = tag[2].lower()
            if name in _RAW or tag[1] and (tag[3] or tag[4]) or tag[4] and name in ("a", "template"):
                return False
            if tag[1]:
                told = (True, name)
            else:
                attrs = [(k.lower(), unescape(v[1:-1] if v[:1] in ("'", '"') else v)) for k, v in _ATTRIBUTE.findall(tag[3])] if name in ("a", "img", "image") else []
                told = (False, found.made(name, attrs))
            seen[part] = told
        if told[0]:
            found.end(told[1])
        elif told[1] is not None:
            found.start(told[1])
    return True


def tokenize(html: str | None, url: str | None) -> _Found:
    base = join(None, url or "")
    found = _Found(base)
    if not _plain(html or "", found):
        found = _Found(base)
        parser = _Parser(found)
        parser.feed(html or "")
        parser.close()
    return found


def _lists(pages: list[list], names: tuple[str, ...]) -> pa.Array:
    """Lists of structs, put together by column; the first field is an item's place in its list."""
    ends = [0]
    for page in pages:
        ends.append(ends[-1] + len(page))
    columns = [[item[k] for page in pages for item in page] for k in range(len(names) - 1)]
    places = pa.array([i for page in pages for i in range(len(page))], pa.int64())
    items = pa.StructArray.from_arrays([places, *(pa.array(c, pa.string()) for c in columns)], list(names))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def tokens(html: Column, url: Column) -> Column:
    """Tokens of each page with URLs resolved."""

    @F.arrow_udf(TOKENS)
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        found = [tokenize(h.as_py(), u.as_py()) for h, u in zip(pages, urls, strict=True)]
        bases = pa.array([f.base for f in found], pa.string())
        return pa.StructArray.from_arrays([bases, _lists([f.imgs for f in found], _IMG), _lists([f.anchors for f in found], _ANCHOR)], ["base", "imgs", "anchors"])

    return run(html, url)


def size_allows(value: Column, wanted: int) -> Column:
    """Absent or unreadable sizes pass; a readable one must be the badge's."""
    digits = F.when(value.rlike(r"^\+?[0-9]+$"), F.regexp_replace(value, r"^\+?0*", ""))
    fits = (F.length(digits) < 10) | ((F.length(digits) == 10) & (digits <= "4294967295"))
    return F.coalesce(~fits | (digits == str(wanted)), F.lit(True))


def accepted_images(imgs: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """X3 to X7 over (page, pos, url, alt, title, width, height): candidates, the first of each URL."""
    fine = (
        F.col("url").isNotNull() & size_allows(F.col("width"), config.badge_width) & size_allows(F.col("height"), config.badge_height)
        & scheme_of(F.col("url")).isin("http", "https", "data") & ~path_of(F.col("url")).endswith(".svg") & ~path_of(F.col("url")).endswith(".ico")
    )
    first = F.row_number().over(Window.partitionBy("page", "url").orderBy("pos"))
    kept = imgs.where(fine).withColumn("__nth", first).where("__nth = 1").drop("__nth")
    return kept.select("page", "pos", "url", F.nullif("alt", F.lit("")).alias("alt"), F.nullif("title", F.lit("")).alias("title"))


def usable_anchors(anchors: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """X8 to X10 over (page, page_url, pos, raw, url, img_url): hrefs that may be followed, cleaned."""
    fine = F.col("raw").rlike(r"^[/.A-Za-z]") & scheme_of(F.col("url")).isin("http", "https") & (F.octet_length("url") <= config.max_href_bytes)
    return anchors.where(F.coalesce(fine, F.lit(False))).withColumn("href", clean_page_url(F.col("url"), config))


def internal_links(anchors: DataFrame, candidates: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """(page, links): the first distinct links to the same host that no badge leads to."""
    own = anchors.where((host_of(F.col("href")) == host_of(F.col("page_url"))) & (F.col("href") != F.col("page_url")))
    once = own.groupBy("page", "href").agg(F.min("pos").alias("pos"))
    taken = candidates.where(F.col("href").isNotNull()).select("page", "href").distinct()
    left = once.join(taken, ["page", "href"], "left_anti")
    order = Window.partitionBy("page").orderBy("pos")
    first = left.withColumn("n", F.row_number().over(order)).where(F.col("n") <= config.max_internal_links)
    return first.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "href"))).alias("a")).select("page", F.transform("a", lambda x: x["href"]).alias("links"))


def anchored(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates with the href of the last anchor whose first image they are."""
    pairs = anchors.where(F.col("img_url").isNotNull() & (F.col("href") != F.col("img_url")))
    last = pairs.groupBy("page", F.col("img_url").alias("url")).agg(F.max_by("href", "pos").alias("href"))
    return candidates.join(last, ["page", "url"], "left")


def extract(pages: DataFrame, config: CrawlConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """X1 to X18 over (page, url, html): candidate badges (page, pos, url, alt, title, href) and internal links (page, links)."""
    from linkloom.storage import written

    parsed = written(pages.select("page", tokens(F.col("html"), F.col("url")).alias("t")), "tokens")
    imgs = parsed.select("page", F.explode("t.imgs").alias("i")).select("page", "i.*")
    anchors = parsed.select("page", F.col("t.base").alias("page_url"), F.explode("t.anchors").alias("a")).select("page", "page_url", "a.*")
    links = usable_anchors(anchors, config)
    candidates = anchored(accepted_images(imgs, config), links)
    return candidates, internal_links(links, candidates, config)
