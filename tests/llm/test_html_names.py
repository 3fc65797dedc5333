"""Names of elements against the text that they hold: wrappers keep their article, small menus and adverts still go."""

import pytest

from loomstone.llm import html_extract

P = "A sentence of the article that goes on for a while, with commas, clauses and a point at its end. "
ARTICLE = f"<h1>Title</h1><p>{P * 4}</p><p>{P * 3}</p><p>{P * 5}</p>"
WANT = "\n\n".join(["Title", *((P * k).strip() for k in (4, 3, 5))])
MENU = "<div class='sidebar'><p>Other things to read that are not of the article.</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-with-sidebar'>{a}</div>",
        "<div class='has-sidebar'><div>{a}</div>{m}</div>",
        "<div class='post no-comments'>{a}</div>{m}",
        "<div id='menu-page'><div>{a}</div></div>",
        "<form action='/x' method='post'><div>{a}</div><input name='q'></form>",
        "<div class='widget'>{a}</div>",
        "<div class='sidebar-page'><article>{a}</article></div>{m}",
        "<div class='has-sidebar'><main>{a}</main></div>",
    ],
)
def test_wrappers_keep_the_article(page):
    assert html_extract.main_text("<html><body>" + page.replace("{a}", ARTICLE).replace("{m}", MENU) + "</body></html>") == WANT


def test_article_in_many_named_blocks():
    """Each block holds a small share, all of them the text."""
    blocks = [f"{k} {P * 2}".strip() for k in range(8)]
    page = "<body>" + "".join(f"<div class='elementor-widget'><p>{b}</p></div>" for b in blocks) + "</body>"
    assert html_extract.main_text(page) == "\n\n".join(blocks)
    names = "widget-a share-b promo-c social-d notice-e banner-f related-g menu-h".split()
    page = "<body>" + "".join(f"<div class='{n}'><p>{b}</p></div>" for n, b in zip(names, blocks)) + "</body>"
    assert html_extract.main_text(page) == "\n\n".join(blocks)


@pytest.mark.parametrize("bearer", ["<div class='ad'>{x}</div>", "<div id='site-menu'>{x}</div>", "<form>{x}</form>", "<div class='comments'><article>{x}</article></div>", "<div role='navigation'>{x}</div>"])
def test_small_bearers_go(bearer):
    small = bearer.replace("{x}", "<p>Buy this thing here, now or tomorrow.</p>")
    assert html_extract.main_text(f"<body>{small}<article>{ARTICLE}</article>{small}</body>") == WANT
    assert html_extract.main_text(f"<body><article>{ARTICLE}{small}</article></body>") == WANT


def test_names_in_deep_pages():
    deep = "<div class='has-sidebar'>" * 3000 + ARTICLE + "</div>" * 3000
    assert html_extract.main_text(deep) == WANT
