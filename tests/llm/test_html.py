"""Main text of hand-written pages."""

from shotspark.llm.html import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">Blog, news.</a></ul></nav>
<div id="cookie-notice">We use cookies, as all do. Accept.</div><div class="ad">Buy this, now.</div>
<article><h1>Head&amp;line</h1><p><b>First &lt;para&gt;,
 with&nbsp;   spaces.<br><p>Second &copy; para, <a href="x">with a link</a>, more words. And more.</p>
<script>var t = "</p>";</script><!-- <p>no</p> --><ul><li>one<li>two</ul>
<section class="comments"><p>Nice article, thanks!</p></section><form>Mail <input><button>Go</button></form></article>
<aside><p>Related, other, stories.</p></aside><footer><p>&copy; 2020, all.</p></footer></body></html>"""


def test_article():
    want = "Head&line\nFirst <para>, with spaces.\nSecond © para, with a link, more words. And more.\none\ntwo"
    assert main_text(PAGE) == want


def test_page_without_article_element():
    page = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    assert main_text(page) == main_text(PAGE)


def test_broken_pages():
    assert main_text("") == ""
    assert main_text("<p") == ""
    assert main_text("plain, text. only") == "plain, text. only"
    assert main_text("<article><p>cut off &am") == "cut off &am"
    assert main_text("<article><p>a < b, c</p><p title='>'>d</p>") == "a < b, c\nd"
    assert main_text("<script>x") == ""
    assert main_text("<div>" * 3000 + "<p>deep, text.") == "deep, text."


def test_table(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (2, None, None, "c"), (None, "w", "", "c")],
        "page_id bigint, url string, html string, text string",
    )
    got = sorted((tuple(r) for r in extract_main_text(pages).collect()), key=str)
    text = main_text(PAGE)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "w", "", 0)], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0


BODY = "".join(f"<p>Sentence {i} of the story, which goes on for a while, as stories do. And then it ends, at last.</p>" for i in range(8))


def test_article_elements_that_mark_teasers():
    cards = "".join(f'<article><h3><a href="/{i}">Other story {i}</a></h3></article>' for i in range(6))
    page = f'<html><body><div class="post"><h1>Headline</h1>{BODY}</div><div>{cards}</div></body></html>'
    got = main_text(page).split("\n")
    assert [x for x in got if x.startswith("Sentence")] == [f"Sentence {i} of the story, which goes on for a while, as stories do. And then it ends, at last." for i in range(8)]
    assert not any(x.startswith("Other") for x in got)


def test_threshold_holds_within_articles():
    links = "".join(f"<li>x<a>y{i}</a>" for i in range(30))
    page = f"<html><body><article><h1>Headline</h1>{BODY}<section><div><ul>{links}</ul></div></section></article></body></html>"
    got = main_text(page)
    assert got.count("Sentence") == 8 and "y7" not in got


def test_layout_words_in_classes_do_not_empty_the_page():
    want = main_text(f"<html><body><article><h1>Headline</h1>{BODY}</article></body></html>")
    assert want.count("Sentence") == 8
    aside = '<div class="sidebar"><p>Popular today, all of it.</p></div><div class="site-header"><p>Our site, since 1999.</p></div>'
    for wrapper in ("has-sidebar", "content-sidebar-wrap", "header-fixed", "search", "legal notice"):
        assert main_text(f'<html><body><div class="{wrapper}"><article><h1>Headline</h1>{BODY}</article></div>{aside}</body></html>') == want
        assert main_text(f'<html><body><div class="{wrapper}"><h1>Headline</h1>{BODY}</div>{aside}</body></html>') == want
    for own in ("comments-open", "category-legal", "tag-search", "related"):
        assert main_text(f'<html><body><article class="post {own}"><h1>Headline</h1>{BODY}</article>{aside}</body></html>') == want
    assert main_text('<div class="promo"><p>All, there is.</p></div>') == "All, there is."
