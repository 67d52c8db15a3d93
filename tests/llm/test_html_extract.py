import re
import time
from html import unescape

import pytest

from tidemark.llm.html_extract import extract, main_text

BODY = "<h1>A title here.</h1><p>First paragraph, with words; and more of them to read on.</p><p>Sh.</p><p>The last one has a <a href='x'>link</a> inside, and ends.</p>"
TEXT = "A title here. First paragraph, with words; and more of them to read on. Sh. The last one has a link inside, and ends."
MENU = "<ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(12)) + "</ul>"


def plain_article(html):
    """The text of the article element with every tag read as nothing, block tags as a space."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r"</?(?:p|h1|br|div|li|ul)\b[^>]*>", " ", inner)
    return " ".join(unescape(re.sub(r"<[^>]*>", "", inner)).split())


@pytest.mark.parametrize("page", [
    f"<html><body><nav>{MENU}</nav><div class='ad'>Buy now, it is cheap.</div><article>{BODY}</article><footer>&copy; us.</footer></body></html>",
    f"<body><div id='main-menu'>{MENU}</div><div class='page'><div class='post'>{BODY}</div><div class='comments'><p>Nice text, I think. Thanks a lot for it!</p></div></div><div class=footer>c 2020, all rights.</div>",
    f"<header><p>The Daily News, since 1900.</p></header><main>{BODY}<form><p>Leave your mail, please.</p><input></form></main><aside><p>Read also this, and that.</p></aside>",
    f"<table><tr><td>{MENU}<td><div>{BODY}</div></table><div class='cookie-notice'>We use cookies, you know.</div>",
    f"<div>{MENU}</div><div><div>{BODY}</div></div><div>{MENU}</div>",
    f"<article><header><h1>A title here.</h1><span>By me, today.</span></header>{BODY[len('<h1>A title here.</h1>'):]}<section class='comments'><p>First!</p></section></article>",
    f"<script>var x = '<p>no</p>'</script><style>p {{}}</style><!-- <p>no</p> --><article>{BODY}</article><script>if (a < b) {{",
])
def test_templates(page):
    assert main_text(page) == TEXT


def test_pages_of_several_articles_and_misleading_names():
    halves = BODY.split("<p>Sh.</p>")
    two = f"<nav>{MENU}</nav><main><article>{halves[0]}<p>Sh.</p></article><div class='ad'>Buy now, it is cheap.</div><article>{halves[1]}</article></main><footer>us</footer>"
    assert main_text(two) == TEXT
    assert main_text(f"<article>{halves[0]}<div class='search-tips'><p>Sh.</p>{halves[1]}</div></article>") == TEXT
    assert main_text(f"<article>{BODY}<div class='search-form'><p>What do you look for? Type it here.</p></div></article>") == TEXT
    assert main_text(f"<div class='with-sidebar'><div>{BODY}</div><div class='sidebar'><p>More of this, and of that, to read.</p></div></div>") == TEXT
    teasers = "".join(f"<article><p>Teaser {k}.</p></article>" for k in range(5))
    assert main_text(f"<article>{BODY * 3}</article><div>{teasers}</div>") == " ".join([TEXT] * 3)


@pytest.mark.parametrize("page,least", [
    ("<a " * 350_000, 1),
    ("<a href=\"x" * 100_000, 1),
    ("<a b='c>" * 130_000, 0),
    ("<div>" * 100_000 + "deep text, here." + "</div>" * 100_000, 16),
    ("<div>" * 100_000 + "<p>x</em>" * 50_000, 1),
    ("<em class=ad><div>" + "<span class=ad>" * 50_000 + "x</em>" * 50_000, 0),
    ("<ul><li>" * 60_000 + "some, text.", 1),
    ("<p>" + "<b>bold, <i>text. " * 60_000, 1),
    ("&" * 1_000_000, 1),
    ("<!" * 500_000, 1),
])
def test_broken_and_deep_pages_take_linear_time(page, least):
    began = time.perf_counter()
    assert len(main_text("<article>" + page)) >= least
    assert time.perf_counter() - began < 6


def test_cases():
    assert main_text(None) == main_text("") == main_text("<p> </p>") == main_text("<nav>x</nav>") == ""
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text("<article><p>a &lt; b &amp; c&nbsp;d &#233;</p></article>") == "a < b & c d é"
    assert main_text("<article><p><b>Bold.<br><p>Next</p><p>on<i>e</i> 1 < 2</article>") == "Bold. Next one 1 < 2"
    assert len(main_text("<article>" + "<p>some words, here.</p>" * 50_000 + "</article>")) == 50_000 * 18 - 1


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    expected = {r.page_id: plain_article(r.html) for r in pages.collect()}
    found = {r.page_id: r.text for r in extract(pages).collect()}
    assert found == expected
    assert extract(pages.limit(0)).count() == 0


def test_null_keys_and_clashing_columns(spark):
    rows = [(None, None, f"<article>{BODY}</article>", "x"), (1, "u", None, "y"), (1, "u", None, "y")]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in found), key=str) == sorted([(0, None, TEXT, len(TEXT)), (1, "u", "", 0), (1, "u", "", 0)], key=str)


LINE = "The committee met again on Tuesday, and it heard from seven witnesses; none of them had seen the report."
THINGS = [f"Thing number {k}" for k in range(30)]


@pytest.mark.parametrize("page,text", [
    (f"<form id=aspnetForm><input type=hidden name=v><nav>{MENU}</nav><input name=q><button>Go</button><h1>Title</h1><p>{LINE}</p><p>{LINE}</p><footer>us</footer></form>", f"Title {LINE} {LINE}"),
    (f"<nav>{MENU}</nav><form>Sign in <label>User</label><input><label>Password</label><input type=password><button>Go</button></form>", ""),
    (f"<main><article><p>{LINE * 20}</p><p>{LINE * 20}</p></article><article><h1>Second</h1><p>{LINE}</p></article></main>", f"{LINE * 20} {LINE * 20} Second {LINE}"),
    (f"<article><p>{LINE}</p><p class='promoted-study'>The promoted study found, in short, nothing.</p><section class='rail-history'><p>{LINE}</p></section><div class='related-posts'><p>Read this, please.</p></div></article>", f"{LINE} The promoted study found, in short, nothing. {LINE}"),
    (f"<article><p>{LINE}</p><p>See <a href=x>the whole long report of the committee</a>.</p><p><a href=y>Other news of the day</a></p></article>", f"{LINE} See the whole long report of the committee."),
    (f"<div id=nav>{MENU}</div><div id=content><h1>Things to bring</h1><ul>{''.join(f'<li>{x}</li>' for x in THINGS)}</ul></div><div class=footer>c</div>", " ".join(["Things to bring", *THINGS])),
    (f"<div>{MENU}</div><div><h1>Things to bring</h1><p>{LINE}</p><ul>{''.join(f'<li>{x}</li>' for x in THINGS)}</ul><p>{LINE}</p></div><div>{MENU}</div>", " ".join(["Things to bring", LINE, *THINGS, LINE])),
    (f"<article><p>Press <button>OK</button>, or wait for the second message to come up.</p><p>{LINE}</p><button>Share</button></article>", f"Press OK, or wait for the second message to come up. {LINE}"),
])
def test_what_elements_hold_decides(page, text):
    assert main_text(page) == text
