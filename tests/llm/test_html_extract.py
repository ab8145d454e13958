import random
import re
import time

import pytest

from quillcast.llm.html_extract import dense_lines, extract_pages, main_text
from quillcast.llm.queries import op2_html_extraction

LONG = "A paragraph of the article that is long enough to make the sum of a window surge past any threshold. "


def test_article_alone_stays():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now!</div><div class='cookie-notice'><p>We use cookies</p></div>
    <article><header><h1>Title &amp; more</h1><p>By someone</p></header><p>One<br>two&nbsp;&lt;b&gt; <b>bold</b></p><aside>Side</aside><p>Short.</p>
    <form><input name=x>Mail</form><ul><li>item <a href=x>link</a></li></ul><section id="comments"><p>Nice post</p></section></article>
    <footer>&copy; us</footer></body></html>"""
    assert main_text(html) == "Title & more\n\nOne two <b> bold\n\nShort.\n\nitem link"


def test_pages_without_an_article_element():
    html = f"<body><div id=menu><a>Home</a></div><div><a>News</a> <a>Sport</a></div><div class=post><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><div class='sidebar'><p>{LONG}</p></div><p>Contact</p></body>"
    assert main_text(html) == f"Head\n\n{LONG.strip()}\n\n{LONG.strip()}\n\nEnd."
    assert main_text("just text &eacute;") == "just text é"
    assert main_text("<p>short</p>") == "short"


def test_broken_markup():
    assert main_text("<article><p>a<p>b <b>c &am") == "a\n\nb c &am"
    assert main_text("<nav>menu<article><p>text</p></article>") == "text"
    assert main_text('<article><p title="x>one</p><p>two</p></article>').endswith("two")
    assert main_text("<article>x<!-- never closed") == "x"
    assert main_text("<article><script>if (a < b) {</article>") == ""
    assert main_text("<article><div class=ad>a<div>b</div>c</div>d</article>") == "d"
    assert main_text("") == "" and main_text("<br><p></p>") == ""


def test_dense_lines_against_every_window():
    rng = random.Random(2)
    for _ in range(500):
        sizes = [rng.choice([0, 0, 3, 20, 60, 300]) for _ in range(rng.randint(1, 25))]
        windows = [range(i, min(i + 3, len(sizes))) for i in range(max(1, len(sizes) - 2))]
        least = max(1, min(86, max(sum(sizes[k] for k in w) for w in windows)))
        surging = {k for w in windows if sum(sizes[k] for k in w) >= least for k in w}
        assert dense_lines(sizes) == [k in surging and sizes[k] > 0 for k in range(len(sizes))]


def test_windows_find_the_article_under_any_name(spark, sf_dir):
    """The driver's pages with their article, menu and footer renamed to plain divs give the same text."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    plain = [re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", h) for h in pages]
    same = [main_text(a) == main_text(b) for a, b in zip(pages, plain)]
    assert sum(same) >= 0.9 * len(same)


@pytest.mark.parametrize("tag", ['<p id="social-contract">', '<section id="bottom-line">', '<blockquote class="response">', '<table class="tags"><tr><td>', '<div class="article-menus-history">', '<p id="search-party">'])
def test_names_that_only_resemble_those_of_boxes_keep_their_text(tag):
    assert main_text(f"<article><p>{LONG}</p>{tag}kept</article>") == f"{LONG.strip()}\n\nkept"


@pytest.mark.parametrize("tag", ['<div class="ad">', '<div id="sidebar">', '<ul class="main-menu">', '<div class="cookie-banner">', '<section class="comments">', '<div class="comment-list">', '<div class="newsletter-signup-box" role=form>', '<p class="advert">', "<aside>", '<div class="site-footer">', '<div class="related-posts">'])
def test_boxes_lose_their_text(tag):
    end = re.match(r"<(\w+)", tag)[1]
    assert main_text(f"<article><p>{LONG}</p>{tag}{LONG}</{end}><p>End.</p></article>") == f"{LONG.strip()}\n\nEnd."


def test_teasers_and_short_lines():
    assert main_text(f"<article class=card>Teaser</article><main><p>{LONG}</p><p>x</p></main>") == f"{LONG.strip()}\n\nx"
    assert main_text(f"<div class=post><p>{LONG}</p><p>a</p><p>b</p><p>c</p><p>d</p></div>") == "\n\n".join([LONG.strip(), *"abcd"])
    assert main_text(f"<div><section><p>{LONG}</p></section><section><p>b</p><p>{LONG}</p></section></div><div>Imprint</div>") == "\n\n".join([LONG.strip(), "b", LONG.strip()])
    assert main_text("<article><p class=advert>By X<p>text<p>more</article>") == "text\n\nmore"


def test_time_is_linear_in_depth():
    took = []
    for n in (4000, 16_000):
        began = time.process_time()
        main_text("<article>" + "<div>a b" * n + "</article>")
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.1


def test_query(spark, sf_dir):
    rows = op2_html_extraction(spark, sf_dir).collect()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert len(rows) == pages and all(r.n_chars == len(r.text) > 0 for r in rows)
    assert not any("track(" in r.text or "&copy;" in r.text or "<p>" in r.text for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (None, "u", "", "b"), (2, "u", "<p>x</p>", "c"), (2, "u", "<p>x</p>", "c"), (3, "u", f"<article>{'<p>word' * 50_000}</article>", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, None, 0), (None, "u", 0), (2, "u", 1), (2, "u", 1), (3, "u", 50_000 * 4 + 49_999 * 2)], key=str)
    assert extract_pages(pages.limit(0)).collect() == []
