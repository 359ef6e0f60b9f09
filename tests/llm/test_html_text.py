"""Operator 6 on hand-made pages and on the page table."""

import html
import random
import re

import pytest

from linkloom.llm.html_text import extract_pages, main_text
from linkloom.session import table

LONG = "A sentence, with commas, that says enough to be counted as a paragraph of its own. " * 3

CASES = [
    ("", ""),
    ("<script>var a = '<p>no</p>';</script>", ""),
    (f"<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>x<b>y</b>\n z<br>w</article><footer>f</footer>", f"T & U {LONG.strip()} xy z w"),
    (f"<div class='sidebar'><p>{LONG}</p></div><div id=content><p>{LONG}</p><ul><li>one<li>two</ul></div><div class=comments><p>{LONG}</p></div>", f"{LONG.strip()} one two"),
    (f"<header>Site</header><main><p>{LONG}</p><form><p>{LONG}</p></form><aside>{LONG}</aside></main><div class='cookie-notice'>{LONG}</div>", LONG.strip()),
    (f"<div><div><p>{LONG}</p></div><div><p>{LONG}</p></div><div><a href=x>{LONG}</a></div></div>", f"{LONG.strip()} {LONG.strip()}"),
    (f"<div class='post has-comments'><p>{LONG}</p><div class=article-comments><p>{LONG}</p></div><div class='ad-text'>{LONG}</div></div><div class=article-footer><p>{LONG}</p></div>", LONG.strip()),
    (f"<div class='with-sidebar content'><p>{LONG}</p></div><div role=complementary><p>{LONG}</p></div>", LONG.strip()),
    (f"<h3>Menu</h3><ul><li><a href=a>one</a></ul><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div>", f"Title {LONG.strip()} {LONG.strip()}"),
    (f"<article><h2>Works</h2><p>{LONG}</p><ul><li><a href=a>First work</a><li><a href=b>Second work</a></ul><div class=tags><a href=t>tag</a></div></article>", f"Works {LONG.strip()} First work Second work"),
    (f"<article><div class='story-side'><p>{LONG}</p></div><div class=legal><p>Clause one.</p></div><div class=comments><p>{LONG}</p></div></article>", f"{LONG.strip()} Clause one."),
    (f"<article><h1>T</h1><section>{f'<p>{LONG}</p>' * 30}</section><section><p>Short end.</p></section></article>", " ".join(["T", *[LONG.strip()] * 30, "Short end."])),
    (f"<div><section><h2>A</h2>{f'<p>{LONG}</p>' * 12}</section><section><h2>B</h2><p>Few.</p></section><section><a href=x>more and more</a></section></div>", " ".join(["A", *[LONG.strip()] * 12, "B Few."])),
    ("<p>unclosed <a href='x>", "unclosed <a href='x>"),
]


@pytest.mark.parametrize("outer", ["article", "div id=content", "div", "section"])
@pytest.mark.parametrize("depth", [0, 1, 2, 3, 4])
def test_wrapped_paragraphs(outer, depth):
    """Paragraphs each in wrappers of their own are all kept, however many and deep; boilerplate goes."""
    for count in range(1, 11):
        texts = [f"Paragraph {i}, {LONG.strip()}" for i in range(count)]
        body = "".join(f"{'<div>' * depth}<p>{t}</p>{'</div>' * depth}" for t in texts)
        page = f"<nav><a href=/>Home</a></nav><div class=ad>Buy, buy, and buy.</div><{outer}>{body}</{outer.split()[0]}><div class=comments><p>{LONG}</p></div><footer>f</footer>"
        assert main_text(page) == " ".join(texts)


def plainly(tree):
    """The scoring written out slowly over (tag, class, children) trees, in which a text stands for a block of its own."""
    def blocks(node):
        for c in node[2]:
            yield from [(node, c, 0)] if isinstance(c, str) else blocks(c) if c[0] != "a" else [(node, c[2][0], len(c[2][0]))]

    def nodes(node, up=()):
        yield node, up
        for c in node[2]:
            if not isinstance(c, str) and c[0] != "a":
                yield from nodes(c, (*up, node))

    def density(node):
        own = list(blocks(node))
        return sum(n for *_, n in own) / max(1, sum(len(t) for _, t, _ in own))

    listed = list(nodes(tree))
    above = {id(n): up[::-1] for n, up in listed}
    bonus = lambda n: 25 if n[0] == "article" else 5 if n[1] == "content" else 0
    score = {}
    for node, text, linked in blocks(tree):
        points = 0.5 if node[0] == "h2" else (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        way = [node, *above[id(node)]] if node[0] not in ("p", "h2", "li") else list(above[id(node)])
        while len(way) > 1 and len(list(blocks(way[0]))) == 1 and not bonus(way[0]):
            way.pop(0)
        for n, part in zip(way, (1, 2, 6, 9, 12, 15)):
            score[id(n)] = score.get(id(n), 0) + points / part
    final = {id(n): (score[id(n)] + bonus(n)) * (1 - density(n)) if id(n) in score else 0 for n, _ in listed}
    best = max((n for n, _ in listed), key=lambda n: final[id(n)])
    if not final[id(best)]:
        return " ".join(t for _, t, _ in blocks(tree))
    best = next((n for n in (best, *above[id(best)]) if n[0] == "article"), best)
    keep = {id(best)}
    if best is not tree:
        family = [n for n in above[id(best)][0][2] if not isinstance(n, str) and n[0] != "a"]
        prose = lambda n: n[0] in ("p", "h2", "li") or any(b[0][0] in ("p", "h2", "li") for b in blocks(n))
        for n in family:
            size = sum(len(t) for _, t, _ in blocks(n))
            if final[id(n)] >= 0.2 * final[id(best)] or (n[:2] == best[:2] and prose(n) and density(n) < 0.25) or (n[0] == "p" and density(n) < 0.25 and (size > 80 or (not density(n) and size))):
                keep.add(id(n))
        for n in family[: [x is best for x in family].index(True)][::-1]:
            if n[0] == "h2":
                keep.add(id(n))
            if any(blocks(n)) and id(n) not in keep:
                break

    def shown(node, kept, inside):
        inside = inside or node[0] == "article"
        kept = kept or id(node) in keep
        if node is not best and node[0] in ("ul", "div", "section") and density(node) > 0.6 and not inside:
            kept = False
        for c in node[2]:
            if isinstance(c, str) or c[0] == "a":
                if kept:
                    yield c if isinstance(c, str) else c[2][0]
            else:
                yield from shown(c, kept, inside)

    return " ".join(shown(tree, False, False))


def test_scoring_on_random_trees():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    prose = lambda most: " ".join(word() + rng.choice(["", "", "", ","]) for _ in range(rng.randrange(1, most)))

    def grown(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.35:
            return (rng.choice(["p", "p", "p", "h2"]), "", [prose(60)])
        if kind < 0.45:
            return ("ul", "", [("li", "", [("a", "", [prose(4)])]) for _ in range(rng.randrange(1, 5))])
        if kind < 0.5:
            return ("ul", "", [("li", "", [prose(20)]) for _ in range(rng.randrange(1, 4))])
        tag = rng.choice(["div", "div", "div", "section", "section", "article"] if depth > 1 else ["div", "section"])
        return (tag, rng.choice(["", "", "", "content", "x"]), [grown(depth - 1) for _ in range(rng.randrange(1, 5))])

    def markup(node):
        if isinstance(node, str):
            return node
        return f"<{node[0]}{f' class={node[1]}' if node[1] else ''}>{''.join(map(markup, node[2]))}</{node[0]}>"

    for _ in range(600):
        tree = ("#root", "", [grown(5) for _ in range(rng.randrange(1, 5))])
        page = "".join(map(markup, tree[2]))
        assert main_text(page) == plainly(tree), page


@pytest.mark.parametrize(("page", "want"), CASES[:-1])
def test_cases(page, want):
    assert main_text(page) == want


def test_broken_markup_ends():
    for page in ["<", "<a", "<p>unclosed <a href='x", "<!-- never closed", "<script>never", "</div></p></body>", "<table><tr><td>a<td>b", "&#xD800; &bogus; &amp"]:
        main_text(page)
    main_text("<div>" * 20000 + "deep" + "</div>" * 20000)
    main_text("<a href=\"" * 20000)


def test_page_table(spark, sf):
    for r in extract_pages(table(spark, sf, "pages")).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.sub(r"<(?:/?p|/?h1|br)>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        assert r.text == " ".join(html.unescape(re.sub(r"</?b>", "", inner)).split())
        assert r.n_chars == len(r.text)


def test_nulls(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (None, None, "<p>hello there", 4)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, extract_pages(pages).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "hello there", 11)]
    assert extract_pages(pages.limit(0)).count() == 0
