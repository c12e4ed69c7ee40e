"""Pages whose text is told by the sums of its blocks' lengths."""

import time

import pytest

from tidelog.llm import html_extract

LONG = ("long enough text " * 20).strip()
MENU = "<ul><li><a href=1>one</a><li><a href=2>two</a></ul>"

WITHOUT_ARTICLE = [
    (f"<div><p>{LONG}</p></div><div><ul><li>Short item.</li></ul></div>", f"{LONG} Short item."),
    (f"<h1>Title</h1><p>Short intro.</p><p>{LONG}</p>", f"Title Short intro. {LONG}"),
    (f"<div><h1>T</h1></div><div>by A</div><div>now</div><div>in B</div><p>{LONG}</p>", f"T by A now in B {LONG}"),
    (f"<p>{LONG}</p><p><a href=1>Linked &amp; whole</a></p><p>{LONG}</p>", f"{LONG} Linked & whole {LONG}"),
    (f"<div><a href=1>Home</a> | <a href=2>News</a></div><div><p>{LONG}</p>{MENU}<p>End.</p></div>{MENU}<div>x</div>", f"{LONG} one two End."),
    (f"<div><p>{LONG}</p>{MENU}<p>{LONG}</p></div>", f"{LONG} one two {LONG}"),
    (f"<div><p>{LONG}</p></div><div>{MENU}</div><div><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    (f"<div><ul><li>a<ul><li>b<ul><li>c</ul></ul></ul></div><table><tr><td>d</td></tr></table><p>{LONG}</p>", f"a b c d {LONG}"),
]


@pytest.mark.parametrize("page, text", WITHOUT_ARTICLE)
def test_pages_without_article(page, text):
    assert html_extract.main_text(page) == text


ARTICLE = f"<article><h1>Head</h1><p>{LONG}</p></article>"
WITH_ARTICLE = [
    *[(f'<div class="nav">Go</div><div class="{name}">{ARTICLE}</div><div class="sidebar">Side</div>', f"Head {LONG}")
      for name in ("layout has-sidebar", "no-sidebar", "with-header", "menu-open", "page-banner", "ad-layout", "widget")],
    (f'<div class="layout no-sidebar"><p>Short.</p><p>{LONG}</p></div>', f"Short. {LONG}"),
    (f'<div class="widget"><p>{LONG}</p></div><div class="widget">Weather</div>', LONG),
    (f"<form><div>{ARTICLE}</div></form><form>Name <input></form>", f"Head {LONG}"),
    ('<svg width="1"/><article><p>Te<svg viewBox="0" />xt</p></article>', "Text"),
    ("<article><p>A<svg><title/><style/><text>icon</text></svg></p><p>B<svg><path></p><p>C</p></article>", "A B C"),
    (f"<div><p>{LONG}</p></div><article>Teaser</article><div><p>Short.</p><p>{LONG}</p></div>", f"{LONG} Teaser Short. {LONG}"),
    (f"{ARTICLE}<section id=comments><article class=comment-body>{LONG}{LONG}</article></section>", f"Head {LONG}"),
    (f"{ARTICLE}<div class=comments><article>{LONG}{LONG}</article></div>", f"Head {LONG}"),
]


#: Names on an article's own tags, and what of an article is furniture all the same.
OWN_TAGS = [
    *[(f"<article><h1>A</h1><p>{LONG}</p>{tag}<p>{LONG}</p></article>", f"A {LONG} Own words {LONG}") for tag in (
        '<h2 id="search">Own words</h2>', '<h2 id="navigation">Own words</h2>', '<h2 id="comments">Own words</h2>',
        '<section id="related-work">Own words</section>', '<h2 class="section-header">Own words</h2>',
        '<p class="hidden-gem">Own words</p>', '<p class="share-price">Own words</p>', '<p class="ad-hoc">Own words</p>',
        "<p>Own <label>words</label></p>", '<p>Own <span class="ad">words</span></p>',
    )],
    (f"<article><header><h1>A</h1></header><p>{LONG}</p><header>By</header></article>", f"A {LONG}"),
    *[(f"<article><p>{LONG}</p><div class='{name}'>Go</div></article>", LONG) for name in (
        "ad", "ad-slot", "share-buttons", "related-posts", "cookie_banner", "comment-list", "ads-2",
    )],
    (f"<header><h1>Site</h1></header><article><p>{LONG}</p></article><p class=copyright>Own</p>", LONG),
]


@pytest.mark.parametrize("page, text", OWN_TAGS)
def test_names_on_the_tags_of_an_article(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("page, text", WITH_ARTICLE)
def test_names_and_articles(page, text):
    assert html_extract.main_text(page) == text


def test_sums_decide_beside_an_article():
    weak, menu = "<p>Weak.</p>", f"<div>{MENU}</div>"
    page = f"{weak}{menu}<p>{LONG}</p>{menu}{ARTICLE}{weak}{menu}{weak}"
    assert html_extract.main_text(page) == f"{LONG} Head {LONG} Weak."


def test_deep_and_odd_pages_take_linear_time():
    pages = ["<div>a" * 50_000, "<svg><style/>" * 50_000, "<svg>" * 50_000 + "<p>x", "</b>" * 50_000, "<title>" * 50_000]
    assert [len(html_extract.main_text(page)) for page in pages] == [99_999, 0, 1, 0, 0]


@pytest.mark.parametrize("again", ["</b>", "<body>", "<svg><p>", "</p>"])
def test_many_open_elements_and_end_tags_take_linear_time(again):
    start = time.thread_time()
    html_extract.main_text("<i>" * 20_000 + again * 20_000)
    assert time.thread_time() - start < 5
