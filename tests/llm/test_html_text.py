"""Main text of pages against plain cuts of the tables' articles, and of pages with other layouts."""

import html as H
import re

import pytest

from quire.llm.html_text import extract, main_text

SF = "/root/testdata/sf0.01"
PARAGRAPHS = [f"Sentence {i}, with a few words in it; and, since it is long enough, a second part. Then another one follows, number {i}." for i in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
LINKS = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Weather", "About us")) + "</ul>"
TEXT = " ".join(PARAGRAPHS)


def plain(page):
    article = re.search("<article>(.*?)</article>", page, re.S)[1]
    return " ".join(H.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())


def test_whole_table(spark):
    from quire.llm.queries import op12_html_text

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    df = op12_html_text(spark, SF)
    assert dict(df.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    rows = df.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def test_ratios_alone(spark):
    # the same pages without landmarks and names: only ratios tell the article from menu, advert and footer
    right = total = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        bare = re.sub("<(/?)(article|nav|footer)", r"<\1div", r.html).replace(' class="ad"', "")
        right += main_text(bare) == plain(r.html)
        total += 1
    assert right >= 0.95 * total


LAYOUTS = {
    "names": f'<div id="topMenu">{LINKS}</div><div class="page-header"><p>The paper, since 1900.</p></div><div class="post"><h1>Title</h1>{BODY}</div><div class="side-bar sidebar"><p>{PARAGRAPHS[0]}</p></div><div id="comments"><p>I like it, a lot. {PARAGRAPHS[1]}</p></div><div class="site-footer footer">All rights reserved, 2020.</div>',
    "no names": f"<div>{LINKS}</div><div>Buy now.</div><div><h1>Title</h1>{BODY}</div><div>&copy; 2020, all rights reserved.</div>",
    "nested": f"<body><main><header><h1>Site</h1></header><article><header><h1>Title</h1></header><div class=body>{BODY}</div><aside>{BODY}</aside></article><section class='comments'><article class='comment'>{BODY}</article></section></main></body>",
    "title above": f'<table><tr><td>{LINKS}</td><td><div><h1>Title</h1><div>{BODY}</div></div></td></tr></table>',
    "forms": f'<article><h1>Title</h1>{BODY}<form><p>Mail us, please. {PARAGRAPHS[0]}</p><button>Send</button></form><div class="share-buttons">Share, like.</div>{LINKS}</article><dialog>Accept, or not.</dialog><div class="cookie-notice"><p>We use cookies, as {PARAGRAPHS[0]}</p></div>',
    "no ends": f"<html><head><title>T</title><style>p{{}}</style><body><nav><ul><li><a href=x>Home<li><a href=y>News</ul></nav><article><h1>Title</h1>{''.join(f'<p>{p}' for p in PARAGRAPHS)}</article><footer>End.",
    "wrapper named": f'<div class="with-sidebar"><article><h1>Title</h1>{BODY}</article><div class="sidebar">{BODY}</div></div>',
    "scripts": f"<article><h1>Title</h1><script>if (a < b) {{ x = '<p>no</p>' }}</script><!-- <p>no</p> --><style>p > a {{}}</style>{BODY}<noscript>no</noscript></article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert main_text(LAYOUTS[name]) == f"Title {TEXT}"


def test_what_an_article_holds_stays():
    page = "<article><h1>T</h1><p>One.</p><h2>Part</h2><ul><li>first</li><li>second</li></ul><blockquote><p>Said.</p></blockquote><table><tr><td>1<td>2</table><figure><img src=x><figcaption>Seen</figcaption></figure><p>a<br>b <i>c</i>d&nbsp;&amp;amp; &lt;e&gt;\n\t f</p><p></p>tail</article>"
    assert main_text(page) == "T One. Part first second Said. 1 2 Seen a b cd &amp; <e> f tail"


def test_whitespace_references_and_broken_markup():
    assert main_text("<p>5 < 6 & 7 &#x41;&#66; &eacute;&nbsp;x</p>") == "5 < 6 & 7 AB é x"
    assert main_text("no markup at all") == "no markup at all"
    assert main_text("<p>cut <a href='x") == "cut"
    for bad in ("", "<", "<>", "</>", "</p>", "<!--", "<script>x", "<p " * 1000, "<div>" * 3000, "<a href=\"" * 500):
        assert main_text(bad) in ("", "<", "<>")


@pytest.mark.parametrize("unit", ["<div>", "<p>x", "<a ", "<!--", "<b>x", "</", '<span class="ad">x', "<h1>x", "<li>x<ul>"])
def test_time_grows_with_the_page(unit):
    import time

    began = time.process_time()
    main_text(unit * 40_000)
    assert time.process_time() - began < 10


def test_odd_rows(spark):
    long = "<article>" + "<p>word, word.</p>" * 50_000 + "</article>"
    rows = [(1, None, 5, "t"), (2, "", None, "t"), (3, "<nav>x</nav>", 1, "t"), (4, long, 2, "t"), (None, "<p>Hi.</p>", 3, "t"), (5, "<p>a.</p>", 1, "t"), (5, "<p>a.</p>", 1, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars int, text string")
    got = {(r.page_id, r.text, r.n_chars) for r in extract(df).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "", 0), (4, " ".join(["word, word."] * 50_000), 50_000 * 12 - 1), (None, "Hi.", 3), (5, "a.", 2)}
    assert extract(df).count() == len(rows)
    assert extract(df.limit(0)).collect() == []
    assert extract(df.withColumnRenamed("page_id", "c0"), keep=["c0"]).columns == ["c0", "text", "n_chars"]
