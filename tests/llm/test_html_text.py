import html
import re

import pytest

from lodebook.llm.html_text import BlockReader, main_text, main_texts, text_to_tag
from lodebook.llm.queries import op4_html_extraction

FILLER = "Enough words stand in this paragraph to look like the text of an article, and then a few more words. "


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    rows = {r.page_id: r for r in op4_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        parts = (re.sub(r"</?b>", "", x).replace("<br>", " ") for x in re.split(r"</?(?:h1|p)>", inside))
        expected = "\n\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in parts) if x)
        assert rows[p.page_id].text == expected
        assert (rows[p.page_id].n_chars, rows[p.page_id].url) == (len(expected), p.url)


OTHERS = [
    '<nav><a href="/">Home</a></nav>', f"<header><h2>Site</h2><p>{FILLER}</p></header>", f"<footer><p>{FILLER}</p></footer>",
    f"<aside><p>{FILLER}</p></aside>", f'<div class="side-bar sidebar"><p>{FILLER * 3}</p></div>', f'<div id="cookie-notice">{FILLER}</div>',
    f'<div class="advert">{FILLER}</div>', "<form><label>Name</label><input><button>Go</button></form>", f"<script>var a = '{FILLER}';</script>",
    f"<style>p {{ content: '{FILLER}' }}</style>", f'<section id="comments"><div class="comment"><p>{FILLER * 3}</p></div></section>',
    f"<!-- {FILLER} -->", f'<ul class="main-menu"><li>{FILLER}</li></ul>', f'<div class="relatedPosts"><p>{FILLER}</p></div>',
]


@pytest.mark.parametrize("other", OTHERS)
@pytest.mark.parametrize("wrap", ["article", "div", "main"])
def test_what_is_no_article(other, wrap):
    body = f"<{wrap} class=post><h1>A &amp; B</h1><p>{FILLER}<b>bold\n text</b></p><p>Short.</p><blockquote>{FILLER}</blockquote></{wrap}>"
    page = f"<html><head><title>T</title></head><body>{other}{body}{other}</body></html>"
    assert main_text(page) == "\n\n".join(["A & B", FILLER + "bold text", "Short.", FILLER.strip()])
    inside = page.replace("<p>Short.</p>", f"<p>Short.</p>{other}")
    assert main_text(inside) == main_text(page)


@pytest.mark.parametrize("start, end", [
    ('<div class="content has-sidebar">', "</div>"), ('<div class="withSidebar no-comments">', "</div>"), ('<div id="sidebar-layout"><main>', "</main></div>")])
def test_names_that_speak_of_something_else(start, end):
    assert main_text(f"<body>{start}<p>{FILLER}</p><p>Short.</p>{end}</body>") == FILLER.strip() + "\n\nShort."


def test_broken_and_odd_pages(spark):
    assert main_text("") == "" and main_text("<p></p><br>") == ""
    assert main_text("plain  &lt;text&gt;\n only") == "plain <text> only"
    assert main_text("<p>a<p>b</div></p><li>c") == "a\n\nb\n\nc"
    assert main_text("<div>" * 20000 + "deep") == "deep"
    assert main_text("<b>" * 5000 + "x<p>y") == "x\n\ny"
    long = "<article>" + "".join(f"<p>{FILLER}{k}</p>" for k in range(3000)) + "</article>"
    assert main_text(long).count("\n\n") == 2999
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (2, "u", "<p>x</p>", 3)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in main_texts(pages).collect()) == [(1, "", 0), (2, "", 0), (2, "x", 1)]
    assert main_texts(pages.limit(0)).count() == 0


def test_ratios_separate_content():
    reader = BlockReader()
    reader.feed("<ul>" + "<li><a href=x>link</a></li>" * 9 + "</ul><div>" + f"<p>{FILLER}</p>" * 5 + "</div>")
    blocks = reader.finish()
    ratios = text_to_tag(blocks)
    assert ratios.content[10:].all() and not ratios.content[:8].any()


ARTICLE = f"<article><h1>Title</h1><p>{FILLER}</p><p>Short.</p><p>{FILLER}</p></article>"
TEXT = "\n\n".join(["Title", FILLER.strip(), "Short.", FILLER.strip()])
MORE = (f'<div class="sidebar"><h2>See</h2><p>{FILLER}</p></div><form><label>Your mail</label></form><div id="cookie-notice"><p>{FILLER}</p></div>'
        f'<section id="comments"><h2>Replies</h2><article class="comment"><p>{FILLER * 9}</p></article></section>')


@pytest.mark.parametrize("start, end", [
    ('<div class="layout sidebar-left">', "</div>"), ('<div class="header-fixed">', "</div>"), ('<form id="aspnetForm" action="/x">', "</form>"),
    ('<div class="content side">', "</div>"), ('<div class="nav-open"><form><div class="search-page">', "</div></form></div>")])
@pytest.mark.parametrize("body", [ARTICLE, ARTICLE.replace("article>", "div>")])
def test_layouts_with_telling_names_keep_their_text(start, end, body):
    assert main_text(f"<body><nav><a href=/>Home</a></nav>{start}{body}{end}<footer>{FILLER}</footer></body>") == TEXT
    assert main_text(f"<body>{start}{MORE}{body}{MORE}{end}</body>") == TEXT
    assert main_text(f"<body>{MORE}{start}{body}{end}</body>") == TEXT


def test_what_is_marked_stays_out():
    assert main_text(f"<body>{ARTICLE}{MORE}</body>") == TEXT
    assert main_text("<body><form><label>Name</label><input><label>Mail</label></form></body>") == ""
    assert main_text(f"<body><article></article><div class=ad><p>{FILLER}</p></div><div id=cookie-bar><p>{FILLER * 4}</p></div></body>") == ""
    deep = '<div class="side">' * 3000
    assert main_text(f"<body>{deep}{ARTICLE}") == TEXT


def test_pages_without_telling_names_need_the_clusters():
    for k in range(40):
        links = "".join(f'<li><a href="/{n}">Topic number {n}</a></li>' for n in range(6 + k % 9))
        tail = "".join(f'<div><a href="/{n}">Read more of {n}</a></div>' for n in range(4 + k % 5))
        parts = [f"<h1>Case {k}</h1>", *(f"<p>{FILLER}{n}</p>" for n in range(3 + k % 7))]
        page = f"<html><body><div class=a{k}><ul>{links}</ul></div><div class=b{k}>{''.join(parts)}</div><div class=c{k}>{tail}</div></body></html>"
        assert main_text(page) == "\n\n".join([f"Case {k}", *(f"{FILLER}{n}" for n in range(3 + k % 7))])
        reader = BlockReader()
        reader.feed(page)
        assert "Topic number 1" in "\n\n".join(b.text for b in reader.finish() if not b.aside)
