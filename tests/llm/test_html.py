"""Main text of pages made for the purpose, and of the given ones."""

import math
import random
import re

import pyarrow.parquet as pq
import pytest

from tallystone.llm.html_text import Page, main_text

A = "The first paragraph is long enough to be text, with commas, and it goes on for some time."
B = "A second one, with <b>bold</b> words and a <a href='/x'>link</a> in it, follows the first &amp; ends."
ARTICLE, PLAIN = f"<p>{A}</p><p>{B}</p>", f"{A}\nA second one, with bold words and a link in it, follows the first & ends."
NAV = "<ul>" + "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav>{NAV}</nav><article>{ARTICLE}</article><footer>Made by us</footer></body></html>",
        f"<body><div id='menu'>{NAV}</div><div class='content'>{ARTICLE}</div><div class='sidebar'><p>Read also this and that, please.</p></div></body>",
        f"<body>{NAV}<div><div>{ARTICLE}</div></div><div class='comments'><p>{A[::-1]}</p><p>{A[::-1]}</p></div></body>",
        f"<body><header><h2>Our site</h2></header><main>{ARTICLE}<form><input name=q><p>Subscribe now</p></form></main></body>",
        f"<body><script>var a = '<p>no</p>'</script><style>p {{}}</style><div>{ARTICLE}</div><!-- <p>not this</p> --></body>",
        f"<body><div class='cookie-notice'><p>We use cookies, which is what everybody does.</p></div><section>{ARTICLE}</section><aside>{A}</aside></body>",
        f"<body><div class='ad'>Buy this</div><div>{ARTICLE}</div><table><tr><td>{NAV}</td></tr></table></body>",
        f"<body><div id='page' class='with-sidebar'><article class='post comments-open'>{ARTICLE}</article><div class='widget-area'><p>Also read this.</p></div></div></body>",
        f"<body><div class='nav-open header-fixed'><div class='top-nav'>{NAV}</div><div class='text'>{ARTICLE}</div></div></body>",
        f"<body><article>{ARTICLE}</article><section id='comments'><article class='comment'><p>{A}</p></article></section></body>",
        f"<BODY><DIV>{ARTICLE.replace('p>', 'P>')}</DIV><NAV>{NAV}</BODY>",
    ],
)
def test_article_and_nothing_else(page):
    assert main_text(page) == PLAIN


def test_unclosed_and_crossed_tags():
    assert main_text(f"<body><article><p>{A}<p>{B}<li>One<li>Two</article>") == f"{PLAIN}\nOne\nTwo"
    assert main_text(f"<article><b><p>{A}</b></p><i>x</article>") == f"{A}\nx"


def test_white_space_and_references():
    assert main_text("<p> a\n\t b&nbsp;c &lt;d&gt; &eacute;&#233;&#xE9; </p>\n<p>\n</p><p>e<br>f</p>") == "a b c <d> ééé\ne f"


def test_comments_inside_an_article():
    assert main_text(f"<article>{ARTICLE}<div id='comments'><p>{A}</p></div></article>") == PLAIN


NAMES = "related-work recommendations search-algorithms social-history navigation cookies alert-systems article-header entry-header notices header share".split()


@pytest.mark.parametrize("around", ["article", "main"])
@pytest.mark.parametrize("name", NAMES)
def test_names_made_from_titles_stay_inside_an_article(around, name):
    for part in (f"<h2 id='{name}'>A title</h2>", f"<section id='{name}'><h2>A title</h2></section>", f"<header class='{name}'><h1>A title</h1></header>"):
        assert main_text(f"<body><nav>{NAV}</nav><{around}>{part}{ARTICLE}</{around}></body>") == f"A title\n{PLAIN}"


@pytest.mark.parametrize("part", ["<div class='ad'>Buy this</div>", "<h2 class='x'></h2><div class='post-x advertisement'><p>Buy this</p></div>", f"<div class='share-buttons'>{NAV}</div>", f"<div class='related-posts'>{NAV}</div>", f"<div id='comments'><p>{A}</p></div>"])
def test_whole_names_drop_inside_an_article(part):
    assert main_text(f"<body><article>{ARTICLE}{part}</article></body>") == PLAIN


LONG = "".join(f"<p>{A}</p>" for _ in range(4))


@pytest.mark.parametrize("frame", ["<body><nav>{nav}</nav>{x}</body>", "<body><nav>{nav}</nav><main>{x}</main></body>", "<body><nav>{nav}</nav><div>{x}</div></body>"])
@pytest.mark.parametrize(
    "parts",
    [
        f"<article>{LONG}</article><article>{ARTICLE}</article>",
        f"<article>{ARTICLE}</article><article>{LONG}</article><article>{ARTICLE}</article>",
        f"<article><div><div>{LONG}{LONG}</div></div></article><article>{ARTICLE}</article>",
        f"<article><div>{LONG}</div></article><section><p>{A} {A}</p></section>",
    ],
)
def test_parts_beside_the_core_article_stay(frame, parts):
    got = main_text(frame.format(nav=NAV, x=parts))
    assert (got.count(A), got.count("A second one")) == (parts.count(A), parts.count(B))
    assert "Entry" not in got


@pytest.mark.parametrize("frame", ["<main>{}</main>", "<div>{}</div>"])
def test_an_article_in_an_article(frame):
    inner = f"<article><div>{LONG}{LONG}</div></article>"
    got = main_text("<body>" + frame.format(f"<article><p>Its own text, of some length, stands here.</p>{inner}<p>And here.</p></article>") + "</body>")
    assert got == "\n".join(["Its own text, of some length, stands here.", *[A] * 8, "And here."])


def test_lists_of_links_beside_an_article_go():
    teaser = "<article><h3><a href='/1'>Another title of another article</a></h3></article>"
    assert main_text(f"<body><main><article>{ARTICLE}</article>{teaser}{teaser}<div>{NAV}</div></main></body>") == PLAIN


def test_empty():
    assert [main_text(x) for x in (None, "", "   ", "<p></p>", "<script>x</script>", "<!DOCTYPE html>")] == [""] * 6


def test_given_pages_keep_the_article():
    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        text = main_text(html)
        body = re.search(r"<article>(.*?)</article>", html, re.S)
        if body:
            want = re.sub(r"\s+", "", re.sub(r"<[^>]*>", "", re.sub(r"(?s)<(script|style|aside|form|nav|footer)\b.*?</\1>|<!--.*?-->|<div class=\"[^\"]*(?:ad|comment|share)[^\"]*\">.*?</div>", "", body[1])))
            import html as h

            assert re.sub(r"\s+", "", text) == re.sub(r"\s+", "", h.unescape(want))


def test_densities_by_definition():
    """On random trees, against the formula worked out anew below each node."""
    rng = random.Random(4)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["some words, ", "x", "  and  more words of it "])
        tag = rng.choice(["div", "section", "b", "a"] if depth > 1 else ["p", "b"])
        return (tag, [tree(depth - 1) for _ in range(rng.randrange(1, 5))])

    def shown(t):
        return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(shown, t[1]))}</{t[0]}>"

    def no_nested_links(t, inside=False):
        if isinstance(t, str):
            return t
        tag = "i" if t[0] == "a" and inside else t[0]
        return (tag, [no_nested_links(x, inside or tag == "a") for x in t[1]])

    def counts(t, in_link=False):  # characters, tags, those in links
        if isinstance(t, str):
            k = len("".join(t.split()))
            return k, 0, k * in_link, 0
        parts = [counts(x, in_link or t[0] == "a") for x in t[1]]
        below = [x for x in t[1] if not isinstance(x, str)]
        return sum(p[0] for p in parts), sum(p[1] for p in parts) + len(below), sum(p[2] for p in parts), sum(p[3] for p in parts) + sum(x[0] == "a" for x in below)

    def density(t, ratio, in_link):
        c, tags, lc, lt = counts(t, in_link)
        if not c:
            return 0.0
        tags, lt = max(1, tags), max(1, lt)
        base = math.log(math.log(c / max(1, c - lc) * lc + ratio * c + math.e))
        top = math.log(max(1 + 1e-9, c / max(1, lc) * tags / lt))
        return c / tags * (top / base if base > 1e-9 else top)

    for _ in range(200):
        body = no_nested_links(("body", [tree(4) for _ in range(3)]))
        page = Page(shown(body))
        _, _, got, total = page.measured([False] * len(page.tag))
        c = counts(body)
        ratio = c[2] / max(1, c[0])
        nodes = []

        def walk(t, in_link=False):
            if not isinstance(t, str):
                inside = in_link or t[0] == "a"
                nodes.append((t[0], density(t, ratio, inside), sum(density(x, ratio, inside or x[0] == "a") for x in t[1] if not isinstance(x, str))))
                for x in t[1]:
                    walk(x, inside)

        walk(body)
        assert page.tag[1:] == [x[0] for x in nodes]
        assert got[1:] == pytest.approx([x[1] for x in nodes]) and total[1:] == pytest.approx([x[2] for x in nodes])


def test_density_alone_finds_the_given_articles():
    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        assert main_text(html) == main_text(re.sub(r"(</?)(?:article|main)\b", r"\1div", html or ""))


MANY = "".join(f"<p>{A} I think so too.</p>" for _ in range(40))


@pytest.mark.parametrize("name", ["post-comments", "comment-list", "reader-replies", "comments", "disqus_thread", "comments-area", "user-remarks"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_remarks_go_however_long_they_are(name, tag):
    assert main_text(f"<body><{tag}>{ARTICLE}</{tag}><div class='{name}'>{MANY}</div></body>") == PLAIN
    assert main_text(f"<body><{tag}>{ARTICLE}<section id='{name}'>{MANY}</section></{tag}></body>") == PLAIN


def test_names_inside_an_article_drop_nothing():
    page = "<article><h1>T</h1><p>one</p><p class='related'>Related work</p><section class='search'><p>of searches</p></section><div class='social'><p>and society</p></div><section id='comment-on-results'><p>A comment</p></section><p>End.</p></article>"
    assert main_text(page) == "T\none\nRelated work\nof searches\nand society\nA comment\nEnd."


def test_short_paragraphs_beside_the_core_stay():
    inner = f"<h1>Title</h1><p>So.</p><p><b>{A} {A}<br>{A}</b></p><p>Short.</p><ul><li>One</li><li>Two</li></ul><p>End.</p>"
    want = f"Title\nSo.\n{A} {A} {A}\nShort.\nOne\nTwo\nEnd."
    for tag in ("div", "article", "section"):
        assert main_text(f"<body><nav>{NAV}</nav><{tag}>{inner}</{tag}></body>") == want
