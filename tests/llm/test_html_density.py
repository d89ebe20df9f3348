"""Composite text density against a naive recursive version, on pages without an article element, and hostile pages."""

from __future__ import annotations

import math
import random
import time
from html.parser import HTMLParser

import pytest

from lodeline.llm import html_extract

VOIDS = {"br", "img", "hr"}


class Naive(HTMLParser):
    """Well-formed pages as nested lists ``[tag, attributes, children]``."""

    def __init__(self) -> None:
        super().__init__()
        self.root = ["#page", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOIDS:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag not in VOIDS:
            self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def counts(node, linked=False):
    """Characters, link characters, tags, link tags by plain recursion."""
    c = lc = t = lt = 0
    linked = linked or node[0] == "a"
    for k in node[2]:
        if isinstance(k, str):
            n = len(" ".join(k.split()))
            c, lc = c + n, lc + n * linked
        elif k[0] not in html_extract.DROP_TAGS:
            a, b, d, e = counts(k, linked)
            c, lc, t, lt = c + a, lc + b, t + d + 1, lt + e + (k[0] == "a")
    return c, lc, t, lt


def naive_density(node, share):
    c, lc, t, lt = counts(node)
    if not c:
        return 0.0
    base = max(math.e, math.log(c / max(c - lc, 1) * lc + share * c + math.e))
    return c / max(t, 1) * math.log(max(1.0, c / max(lc, 1) * max(t, 1) / max(lt, 1)), base)


def blocks_of(node):
    for k in node[2]:
        if not isinstance(k, str) and k[0] not in html_extract.DROP_TAGS:
            yield k
            yield from blocks_of(k)


def naive_core(page):
    """Text of the subtree with the largest sum of its children's densities (all children of containers are blocks)."""
    reader = Naive()
    reader.feed(page)
    c, lc, _, _ = counts(reader.root)
    share = lc / max(c, 1)

    def total(n):
        kids = [k for k in n[2] if not isinstance(k, str) and k[0] in html_extract.BLOCK and k[0] not in html_extract.DROP_TAGS]
        return sum(naive_density(k, share) for k in kids) if kids else naive_density(n, share)

    best = max((n for n in blocks_of(reader.root) if n[0] in html_extract.BLOCK and n[0] != "html"), key=total)

    def text(n):
        return " ".join(k if isinstance(k, str) else text(k) for k in n[2] if isinstance(k, str) or k[0] not in html_extract.DROP_TAGS)

    return text(best).split()


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(words)).capitalize() + "."


def links(rng, n):
    return "<ul>" + "".join(f"<li><a href=\"/{i}\">{prose(rng, 2)}</a></li>" for i in range(n)) + "</ul>"


def page(seed):
    """A page whose article has no element or class of its own, and the article's paragraphs."""
    rng = random.Random(seed)
    paragraphs = [prose(rng, rng.randint(40, 120)) for _ in range(rng.randint(3, 9))]
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    article = f"<div class=\"{rng.choice(['layout has-sidebar', 'col-8', 'content no-comments', 'x1', 'search-results-for-algorithms'])}\">{body}</div>"
    before = f"<div class=\"{rng.choice(['c1', 'left', 'top-links'])}\">{links(rng, rng.randint(4, 20))}</div>"
    after = f"<div>{links(rng, rng.randint(4, 30))}</div><div class=\"tiles\">" + "".join(f"<div><div><a href=\"/t{i}\">{prose(rng, 2)}</a></div><div>{prose(rng, 2)}</div></div>" for i in range(rng.randint(3, 30))) + "</div>"
    for _ in range(rng.randint(0, 3)):
        article = f"<div class=\"{rng.choice(['wrap', 'outer', 'grid'])}\">{article}</div>"
    return f"<html><body>{before}{article}{after}</body></html>", paragraphs


@pytest.mark.parametrize("seed", range(30))
def test_against_recursion(seed):
    html, paragraphs = page(seed)
    assert html_extract.main_text(html) == "\n\n".join(paragraphs)
    assert naive_core(html) == " ".join(paragraphs).split()


def test_every_density(monkeypatch):
    """The densities of all nodes are those of the recursion."""
    for seed in range(30):
        html, _ = page(seed)
        reader = Naive()
        reader.feed(html)
        c, lc, _, _ = counts(reader.root)
        root = html_extract.parse(html)
        html_extract._measure(root)
        ours = [n.density for n in html_extract._walk(root)]
        theirs = [naive_density(n, lc / c) for n in [reader.root, *blocks_of(reader.root)]]
        assert ours == pytest.approx(theirs)


def test_the_density_decides(monkeypatch):
    right = [html_extract.main_text(page(s)[0]) for s in range(30)]
    rng = random.Random(1)
    for other in (lambda *a: 1.0, lambda *a: rng.random(), lambda c, lc, t, lt, s: float(t)):
        monkeypatch.setattr(html_extract, "density", other)
        assert sum(html_extract.main_text(page(s)[0]) != right[s] for s in range(30)) >= 15


BODY = "".join(f"<p>{' '.join(f'{w}{i}' for i in range(60))}</p>" for w in ("one", "two", "three"))
TEXT = "\n\n".join(" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two", "three"))


def test_names_that_only_hold_a_boilerplate_word():
    for wrapped in (
        "<div class='layout has-sidebar'>{}</div>", "<div class='content no-comments'><article>{}</article></div>", "<section id='search-algorithms'>{}</section>",
        "<form id=aspnetForm><div class=menu><a href=x>m</a></div>{}<footer>f</footer></form>", "<div class='site-header'>Site</div>{}<div id=pageFooter>(c) me</div>", "<div hidden>gone</div><div style='display:none'>x</div>{}",
        "<ul class=mainMenu><li>a<li>b</ul><div>{}</div><div class='comment-list'><p>" + "what a text " * 400 + "</p></div>",
    ):
        assert html_extract.main_text("<html><body>" + wrapped.format(BODY) + "</body></html>") == TEXT, wrapped
    assert html_extract.main_text("<body><p title='the hidden cost'>" + "abc def " * 60 + f"</p>{BODY}</body>").endswith(TEXT)
    assert html_extract.main_text(f"<body><p class=x'>first text</p>{BODY}<p>it's</p></body>") == f"first text\n\n{TEXT}\n\nit's"
    assert html_extract.main_text(f"<body><p data-x=\"a>b\" class='c>d'>first</p>{BODY}</body>") == f"first\n\n{TEXT}"


def test_headings_and_parts_beside_the_core():
    links_ = "<div><ul><li><a href=a>x</a><li><a href=b>y</a></ul></div>"
    assert html_extract.main_text(f"<body>{links_}<div><h1>Title</h1><p>By me</p><div>{BODY}</div></div>{links_}</body>") == f"Title\n\nBy me\n\n{TEXT}"
    two = f"<body>{links_}<div>{BODY}</div><div>short</div><div>{BODY}</div>{links_}</body>"
    assert html_extract.main_text(two) == f"{TEXT}\n\nshort\n\n{TEXT}"


def test_hostile_pages_take_linear_time():
    for bad in (
        "<b>" * 170_000 + "</i>" * 120_000, "<svg>" * 200_000, "<i><div>" + "<b>" * 160_000 + "</i>" * 120_000, '<p class="' * 100_000, "<iframe>" * 125_000, "<!--" * 250_000,
        "<a b='" * 160_000, "<" * 1_000_000, "</p>" * 250_000, "<form>" * 160_000 + "x" * 300, "<table>" + "<tr><td>x" * 110_000,
    ):
        began = time.process_time()
        html_extract.main_text(bad)
        assert time.process_time() - began < 8, bad[:12]
