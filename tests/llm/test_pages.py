"""Main text of pages: tags that are cut or badly quoted, class words, time on hostile pages, densities against a plain recursion."""

import math
import random
import time

import pytest

from graphloom.llm import html_text

LONG = ("Some words of the article stand here. " * 6).strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<main><p>one</p><p title="a hidden gem">two</p><p>three</p></main>', "one\ntwo\nthree"),
        ('<main><p>one</p><p data-info="the role=form x">two</p></main>', "one\ntwo"),
        ('<main><p title="a > b">one</p><p hidden>no</p><p aria-hidden="true">no</p></main>', "one"),
        ('<article><p>one</p><p class="ab', "one"),
        ("<article><p>one</p><a href", "one"),
        ('<article><p>a <a href="x>world</a></p><p>next</p></article>', "a world\nnext"),
        ('<article><p>a <a href="x>world</a></p><p class="k">next</p></article>', "a world\nnext"),
        ("<p>1 < 2 & 3 > 2 <3</p>", "1 < 2 & 3 > 2 <3"),
        ("<article><p>one<!-- never closed <p>no</p>", "one"),
        ("<table><tr><td>a<li>b<tr><td>c</table><p>d</p>", "a\nb\nc\nd"),
    ],
)
def test_tags(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("name", ["related-work", "side-by-side", "comment-on-results", "page with-sidebar", "no-header"])
def test_hints_are_confirmed_by_density(name):
    assert html_text.extract(f'<article><p>{LONG}</p><section class="{name}"><h2>Part</h2><p>{LONG}</p></section></article>') == f"{LONG}\nPart\n{LONG}"


def test_title_in_an_article_header():
    assert html_text.extract(f'<article><div class="article-header"><h1>Title</h1></div><p>{LONG}</p></article>') == f"Title\n{LONG}"


@pytest.mark.parametrize("name", ["sidebar", "page-sidebar", "cookieBanner", "comment-list", "reader-comments", "site-header", "ad", "ad slot-3", "acme-sidebar"])
def test_parts_that_are_no_article(name):
    links = "<p>Buy</p>" + "<a href=x>Go there</a> " * 5
    assert html_text.extract(f'<body><div id="main"><p>{LONG}</p><p>{LONG}</p></div><div class="{name}">{links}</div></body>') == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "<p></p>" * 30_000, '<a "' * 250_000, '<a href="' * 110_000, "<ul>" + "<b>" * 50_000 + "<li></li>" * 50_000, "<table><td>" + "<i>" * 50_000 + "</b>" * 50_000, "</x>" * 250_000, "<dl>" * 50_000 + "<li>" * 50_000, "<!--" * 250_000, "<p a='" * 100_000 + '"', "<script>" * 120_000, '<div class="x-ad">' * 50_000])
def test_hostile_pages_take_linear_time(page):
    begun = time.process_time()
    html_text.extract(page)
    assert time.process_time() - begun < 20


def test_long_pages_come_whole():
    parts = [f"Part {i} of a long article, with words of its own." for i in range(20_000)]
    page = "<nav><a href=x>Home</a></nav><article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"
    assert html_text.extract(page) == "\n".join(parts)
    assert html_text.extract(page[: len(page) // 2]).startswith("\n".join(parts[:9_000]))


def test_densities_against_a_plain_recursion():
    rng = random.Random(7)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.randint(1, 12)))
        name = rng.choice(("div", "section", "a", "span"))
        return name, [make(depth - 1) for _ in range(rng.randint(1, 4))]

    def html(x):
        return x if isinstance(x, str) else f"<{x[0]}>" + "".join(map(html, x[1])) + f"</{x[0]}>"

    def count(x, link=False):
        """characters, link characters, tags inside, link tags inside"""
        if isinstance(x, str):
            return len(x), len(x) * link, 0, 0
        c = lc = t = lt = 0
        for y in x[1]:
            a, b, d, e = count(y, link or not isinstance(y, str) and y[0] == "a")
            c, lc, t, lt = c + a, lc + b, t + d, lt + e
            if not isinstance(y, str):
                t, lt = t + 1, lt + (y[0] == "a")
        return c, lc, t, lt

    def density(x, link, body):
        c, lc, t, lt = count(x, link)
        if not c:
            return 0.0
        t = max(1, t)
        inside = math.log(max(1, lc) / max(1, c - lc) * c + body[1] / max(1, body[0]) * c + math.e)
        return c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt) + 1e-9) / math.log(inside))

    def joined(parts):
        """Texts that stand side by side are one text of the page."""
        out = []
        for y in parts:
            if isinstance(y, str) and out and isinstance(out[-1], str):
                out[-1] += y
            else:
                out.append(y if isinstance(y, str) else (y[0], joined(y[1])))
        return out

    for _ in range(30):
        tree = ("body", joined([make(4) for _ in range(3)]))
        root = html_text.parse("<body>" + "".join(map(html, tree[1])) + "</body>")
        html_text._measure(root)
        whole = count(("html", [tree]))

        def compare(node, x, link):
            assert math.isclose(node.density, density(x, link, whole), abs_tol=1e-9)
            inner = [y for y in x[1] if not isinstance(y, str)]
            nodes = [c for c in node.children if isinstance(c, html_text.Node)]
            assert len(inner) == len(nodes)
            assert math.isclose(node.sum, sum(density(y, link or y[0] == "a", whole) for y in inner), abs_tol=1e-9)
            for n, y in zip(nodes, inner, strict=True):
                compare(n, y, link or y[0] == "a")

        compare(root.children[0], tree, False)
