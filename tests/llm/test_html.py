"""Main texts: a slow direct reading of the given pages, deep nesting, and what is left of broken markup."""

import html
import os
import re
import time

import pytest

PAGES = "/root/testdata/sf0.01/pages.parquet"
BLOCK = r"</?(?:p|div|section|article|main|h[1-6]|ul|ol|li|table|thead|tbody|tr|td|th|blockquote|pre|figure|figcaption|hr|header)\b[^>]*>"


def direct(page: str) -> str:
    """The article element, by patterns: no parser, ratios or clusters."""
    page = re.sub(r"<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", "", page, flags=re.S | re.I)
    inner = re.search(r"<article\b[^>]*>(.*)</article>", page, flags=re.S | re.I)
    inner = inner[1] if inner else re.sub(r"^.*?<body\b[^>]*>", "", page, flags=re.S | re.I)
    for what in ("nav", "aside", "footer", "form"):
        inner = re.sub(rf"<{what}\b.*?</{what}\s*>", "\n\n", inner, flags=re.S | re.I)
    inner = re.sub(r"<div class=\"ad\">.*?</div>", "\n\n", inner, flags=re.S | re.I)
    blocks = re.split(BLOCK, re.sub(r"<br\s*/?>", " ", inner, flags=re.I), flags=re.I)
    blocks = [" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", x)).split()) for x in blocks]
    return "\n".join(x for x in blocks if x)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="the given tables aren't there")
def test_given_pages_with_an_article_read_directly():
    import pyarrow.parquet as pq

    from docstrata.llm.html_text import main_text

    pages = [x for x in pq.read_table(PAGES, columns=["html"]).column(0).to_pylist() if x and re.search("<article", x)]
    wrong = [k for k, x in enumerate(pages) if main_text(x) != direct(x)]
    assert pages and not wrong


@pytest.mark.parametrize("wrapper", ["has-sidebar", "with-sidebar layout", "no-comments", "page nav-open", "notice-board"])
def test_wrappers_keep_the_article(wrapper):
    from docstrata.llm.html_text import main_text

    page = f'<body><nav><a href="/">Home</a></nav><div class="{wrapper}"><article><h1>Title</h1><p>{"words of the text " * 20}</p></article></div></body>'
    assert main_text(page) == "Title\n" + ("words of the text " * 20).strip()


def test_time_is_linear_in_depth():
    from docstrata.llm.html_text import main_text

    began = time.time()
    text = main_text("<body>" + "<div>" * 20000 + "deep text" + "</div>" * 20000 + "</body>")
    assert text == "deep text" and time.time() - began < 3
    assert main_text("<div><span>" * 3000 + "x" + "</em></section>" * 3000) == "x"
    began = time.time()
    main_text("<p>text</p><!-- " + "never closed " * 1_500_000)
    assert time.time() - began < 3


WORDS = "the river runs along old walls where people met and spoke of many things that nobody wrote down until the archive opened again last year".split()
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>'
FOOT = '<footer><p>All rights reserved by the owners of this site and its many pages</p><a href="/x">Imprint</a></footer>'
SIDE = '<div class="sidebar"><h3>Latest</h3><ul>' + "".join(f'<li><a href="/{k}">Another story {k}</a></li>' for k in range(6)) + "</ul></div>"
LINKS = '<div class="links"><ul>' + "".join(f'<li><a href="/t{k}">Topic {k}</a></li>' for k in range(12)) + "</ul></div>"
NOTE = '<div class="cookie-notice"><p>We use cookies to make this site better for all of our readers</p><button>Fine</button></div>'
FORM = '<form action="/s"><label>Mail</label><input name="m"><select><option>daily</option></select></form>'


def sentences(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def story(rnd):
    """The blocks of an article as HTML, and its text."""
    title = sentences(rnd, 6)
    blocks, texts = [f"<h1>{title}</h1>"], [title]
    for k in range(rnd.randint(4, 9)):
        t = sentences(rnd, rnd.randint(12, 60))
        blocks.append(f"<p>{t[:9]}<b>{t[9:20]}</b>{t[20:]}</p>" if k % 3 else f"<p>{t}</p>")
        texts.append(t)
    return "\n".join(blocks), "\n".join(texts)


def remarks(rnd, name, n=9):
    return f'<div class="{name}"><h3>Voices</h3>' + "".join(f'<div class="one"><span>reader {k}</span><p>{sentences(rnd, rnd.randint(5, 25))}</p></div>' for k in range(n)) + "</div>"


LAYOUTS = {
    "article": lambda rnd, a: f"{MENU}<article>{a}</article>{SIDE}{FOOT}",
    "main": lambda rnd, a: f"{NOTE}{MENU}<main><div class='text'>{a}</div></main>{FOOT}",
    "no article": lambda rnd, a: f"{MENU}<div class='content'>{a}</div>{SIDE}{FOOT}",
    "nested wrappers": lambda rnd, a: f"<div id='page'><div class='wrap'>{MENU}<div class='row'><div class='col'><div class='post'>{a}</div></div>{SIDE}</div></div>{FOOT}</div>",
    "comments behind": lambda rnd, a: f"{MENU}<div class='content'>{a}{remarks(rnd, 'entry-comments')}</div>{FOOT}",
    "many comments behind": lambda rnd, a: f"{MENU}<div id='text'>{a}</div>{remarks(rnd, 'comment-list', 60)}{FOOT}",
    "comments before": lambda rnd, a: f"{MENU}{remarks(rnd, 'user-comments')}<div class='story'>{a}</div>{FOOT}",
    "link lists": lambda rnd, a: f"{MENU}{LINKS}<div class='story'>{a}</div>{LINKS}{FOOT}",
    "tables": lambda rnd, a: f"<table><tr><td>{MENU}</td><td class='story'>{a}</td><td>{LINKS}</td></tr></table>",
    "forms and adverts": lambda rnd, a: f"{MENU}<div class='story'>{a}</div><div class='google-ads'><p>Buy one and get another one for nothing today</p></div>{FORM}{FOOT}",
    "comment articles": lambda rnd, a: f"{MENU}<article class='post has-comments'>{a}</article><article class='comment'><p>{sentences(rnd, 30)}</p></article>{FOOT}",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    import random

    from docstrata.llm.html_text import main_text

    for seed in range(40):
        rnd = random.Random(f"{layout}{seed}")
        inner, text = story(rnd)
        assert main_text(f"<html><head><title>T</title><script>var a = '<p>';</script></head><body>{LAYOUTS[layout](rnd, inner)}</body></html>") == text, seed


@pytest.mark.parametrize("name", ["post comments-open", "post no-comments", "hentry has-related", "entry no-ads"])
def test_articles_whose_class_speaks_of_other_parts(name):
    from docstrata.llm.html_text import main_text

    text = [f"paragraph {k} with some words of plain text" for k in range(5)]
    assert main_text(f'<body>{MENU}<article class="{name}">' + "".join(f"<p>{t}</p>" for t in text) + "</article></body>") == "\n".join(text)


def test_open_comments_and_drawings():
    from docstrata.llm.html_text import main_text

    assert main_text("<!-- never closed <p>text</p>") == ""
    assert main_text("<article><p>some text</p><!-- open <p>more</p>") == "some text"
    assert main_text("<article><p>some text</p><svg><text>drawn</text><p>behind</p></article>") == "some text\nbehind"
    assert main_text("<article><p>some text</p><svg><foreignObject><p>drawn</p></foreignObject></svg><p>behind</p></article>") == "some text\nbehind"
