"""Operator 6: main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed element sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre li td th dd dt blockquote figcaption h1 h2 h3 h4 h5 h6 address summary caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form menu dialog button select option optgroup input textarea label svg canvas object audio video map".split())
CLOSES_P = BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}
#: A start tag closes an open one of these, looking no further up than the boundary.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id or role that mark what isn't the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|sidebar|side|aside|nav\w*|menu|"
    r"breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|header|comments?|disqus|replies|responses|share|sharing|social|related|recommend\w*|"
    r"subscribe|newsletter|signup|login|search|widget|tags|legal|copyright|skip|complementary|contentinfo|navigation)(?=$|[\s_-])",
    re.I,
)
#: Of those, words that inside an article mark only what consists of links.
DOUBTFUL = re.compile(r"(?:alert|side|widget|tags|legal|copyright|skip|search|replies|responses|header)", re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?=$|[\s_-])", re.I)

#: Of those, words that mark what isn't the article whatever stands beside them in a name.
NEVER = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|comments?|disqus|cookies?|newsletter|share|sharing|social|related)(?=$|[_-])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)

#: What the points of a paragraph are divided by on their way up through its ancestors.
DISCOUNTS = (1, 2, 6, 9, 12, 15)
SIBLING_SHARE, MENU_LINKS = 0.2, 0.6
MENUS = frozenset("ul ol div table section dl".split())
ARTICLES = frozenset(("article", "main"))


def unlikely(names: str) -> bool | None:
    """Whether class, id and role mark an element as no part of the article; None if only doubtful words do.

    A name counts by its last word ("article-footer" is a footer, "sidebar-content" may be content)
    or by a word that never is article; a plainly likely name beside it outweighs it.
    """
    marked, doubtful = False, False
    for name in names.split():
        if UNLIKELY.search(name):
            last = re.split(r"[_-]", name)[-1]
            if NEVER.search(name) or not LIKELY.search(last):
                doubt = bool(DOUBTFUL.fullmatch(last)) and not NEVER.search(name)
                marked, doubtful = marked or not doubt, doubtful or doubt
        elif LIKELY.search(name):
            return False
    return True if marked else None if doubtful else False


class Page:
    """Elements in page order, and blocks of text each belonging to one of them."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.bonus, self.inside = ["#root"], [-1], [False], [0.0], [False]
        self.names, self.doubtful = [""], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._read(source)

    def _open(self, tag: str, attrs: str, stack: list[int]) -> None:
        parent = stack[-1]
        names = " ".join(a or b or c for _, a, b, c in NAMED.findall(attrs)) if attrs else ""
        bad = tag in DROPPED or (tag == "header" and not self.inside[parent]) or bool(attrs and HIDDEN.search(attrs))
        mark = unlikely(names) if names and tag not in ("html", "body", "article", "main") else False
        if mark or (mark is None and not self.inside[parent]):
            bad = True
        elif names and tag == "article" and re.search(r"(?:^|[\s_-])comments?(?=$|[\s_-])", names, re.I):
            bad = True
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.doubtful.append(mark is None)
        self.inside.append(self.inside[parent] or tag in ARTICLES)
        self.dropped.append(self.dropped[parent] or bad)
        self.bonus.append(25.0 if tag in ARTICLES else 5.0 if names and LIKELY.search(names) else 0.0)
        stack.append(len(self.tags) - 1)

    def _read(self, source: str) -> None:
        stack, opened = [0], Counter()
        parts: list[str] = []
        linked, anchors, at, end = 0, 0, 0, len(source)
        last = end if "<!--" in source else source.rfind(">") + 1  # no tag ends beyond it

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text and not self.dropped[stack[-1]]:
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
                parts.clear()
            linked = 0

        def pop_to(depth: int) -> None:
            flush()
            for i in stack[depth:]:
                opened[self.tags[i]] -= 1
            del stack[depth:]

        while at < end:
            found = TAG.search(source, at, last)
            text = html.unescape(source[at : found.start() if found else end])
            if text:
                parts.append(text)
                if anchors:
                    linked += len(text.strip())
            if not found:
                break
            at = found.end()
            closing, tag, attrs = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if tag == "a":
                anchors = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            elif closing:
                if tag in BLOCK and opened[tag]:
                    depth = len(stack) - 1
                    while self.tags[stack[depth]] != tag:
                        depth -= 1
                    pop_to(depth)
                elif tag in BLOCK:
                    flush()
                elif opened[tag] and self.tags[stack[-1]] == tag:
                    pop_to(len(stack) - 1)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else end
            elif tag in BLOCK or (tag in DROPPED and tag not in VOID):
                flush()
                if tag in CLOSES_P and opened["p"]:
                    for depth in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[depth]] == "p":
                            pop_to(depth)
                            break
                if tag in IMPLIED_END:
                    ends, bounds = IMPLIED_END[tag]
                    for depth in range(len(stack) - 1, 0, -1):
                        name = self.tags[stack[depth]]
                        if name in ends:
                            pop_to(depth)
                            break
                        if name in bounds:
                            break
                if tag not in VOID:
                    self._open(tag, attrs, stack)
                    opened[tag] += 1
            elif tag not in VOID and tag not in ("span", "b", "i", "em", "strong") and attrs and not attrs.endswith("/") and HIDDEN.search(attrs):
                flush()
                self._open(tag, attrs, stack)
                opened[tag] += 1
        flush()

    def main_text(self) -> str:
        """Blocks of the best container and of siblings that belong to it, joined by one space.

        A paragraph's points go to the first element above that holds more than it: wrappers
        around a single block, unless named like an article, are part of the block. If the best
        container lies in an article, that is taken whole.
        """
        n = len(self.tags)
        score, chars, links, held, prose = [0.0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        candidate = [False] * n
        for node, text, linked in self.blocks:
            chars[node] += len(text)
            links[node] += linked
            held[node] += 1
            prose[node] |= self.tags[node] in PARAGRAPH
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            chars[up] += chars[i]
            links[up] += links[i]
            held[up] += held[i]
            prose[up] |= prose[i]
        for node, text, linked in self.blocks:
            points = 0.5 if self.tags[node] in HEADING else (1 + sum(map(text.count, ",،、")) + min(len(text) / 100, 3.0)) * (1 - linked / len(text))
            up = self.parents[node] if self.tags[node] in PARAGRAPH else node
            while up > 0 and held[up] == 1 and not self.bonus[up]:
                up = self.parents[up]
            for discount in DISCOUNTS:
                if up < 0:
                    break
                score[up] += points / discount
                candidate[up] = True
                up = self.parents[up]
        density = [links[i] / max(1, chars[i]) for i in range(n)]
        final = [(score[i] + self.bonus[i]) * (1 - density[i]) if candidate[i] else 0.0 for i in range(n)]
        best = max(range(n), key=lambda i: (final[i], -i), default=0)
        if not final[best]:
            return " ".join(t for _, t, _ in self.blocks)
        at = best
        while at > 0 and self.tags[at] not in ARTICLES:
            at = self.parents[at]
        best = at if at > 0 else best
        kept = [False] * n
        kept[best] = True
        least = final[best] * SIBLING_SHARE
        siblings = [i for i in range(1, n) if best and self.parents[i] == self.parents[best]]
        for i in siblings:
            alike = (self.tags[i], self.names[i]) == (self.tags[best], self.names[best]) and prose[i] and density[i] < 0.25
            short = self.tags[i] == "p" and density[i] < 0.25 and (chars[i] > 80 or not density[i] and chars[i] > 0)
            kept[i] = kept[i] or final[i] >= least or alike or short
        for i in reversed([i for i in siblings if i < best]):  # headings right above what is kept
            if self.tags[i] in HEADING:
                kept[i] = True
            if chars[i] and not kept[i]:
                break
        menu = [self.tags[i] in MENUS and i != best and density[i] > MENU_LINKS and (self.doubtful[i] or not self.inside[i]) for i in range(n)]
        for i in range(1, n):
            kept[i] = (kept[i] or kept[self.parents[i]]) and not menu[i] and not self.dropped[i]
        return " ".join(t for node, t, _ in self.blocks if kept[node])


def main_text(source: str) -> str:
    return Page(source).main_text()


def extracted(source: Column) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return run(F.coalesce(source.cast("string"), F.lit("")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (empty if none) and ``n_chars``.

    Paragraphs pass points for length and commas to their ancestors, a half to the second and
    less beyond, discounted by link density; the best container (the article around it, if there
    is one) is kept, with the headings above it and siblings that score a fifth of it or are of
    its kind, without menus inside them. Elements that are never article (navigation, footers,
    forms, scripts, or named as adverts, comments and the like) take no part.

    Null or empty html gives empty text; repeated rows give a row each; an empty table gives no
    rows; other columns are ignored. One pass, no shuffle; whole pages are read however long.
    """
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), extracted(F.col("html")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
