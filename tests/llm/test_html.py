"""Main text of pages: hand-made pages of many makes, and the plain reading of the table's pages."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusmetrics.llm.html_extract import html_extract, main_blocks
from corpusmetrics.llm.queries import op13_html_extract

P = "This is a paragraph of the article, with some commas, and it goes on for a while. It has two sentences."
NOISE = "We use cookies, and more, to improve things. Accept all, or leave, please."

PAGES = {
    "elements that say so": (
        f"<html><head><title>T &amp; x</title><style>p{{}}</style></head><body><header><h1>My site</h1><p>{P}</p></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        f"<div class='cookie-notice'><p>{NOISE}</p></div><main><article><h1>Title</h1><p>{P} one</p><div class=ad>Buy, now. {P}</div><p>{P}&nbsp;two <b>bo</b>ld<script>var x='</p>';</script>\n tail</p>"
        f"<ul><li>item one</li><li>item two</ul><blockquote>Quote</blockquote></article></main><aside><p>{P}</p></aside><section id=comments><h2>3 Comments</h2><div class=comment><p>{P} {P}</p></div></section>"
        f"<form><p>{P}</p><input></form><footer><p>{P} &copy; 2020</p></footer></body></html>",
        ["Title", P + " one", P + " two bold tail", "item one", "item two", "Quote"],
    ),
    "divisions with classes": (
        f"<body><div id=header><h1>Site</h1></div><div class=menu><a href=x>a</a> <a href=y>b</a></div><div class=wrap><div class=content><h1>Title</h1><p>{P}</p><p>Short.</p><p>{P} 2</p></div>"
        f"<div class=sidebar><p>{P}</p></div></div><div class='reader-comments'><p>{P * 9}</p></div><div id=footer><p>{P}</p></div></body>",
        ["Title", P, "Short.", P + " 2"],
    ),
    "divisions without classes": (f"<body><div><a href=x>Home</a> | <a href=y>About us</a></div><div><h1>Title</h1><div><p>{P}</p><p>Short</p><p>{P}</p></div></div><div><a href=x>Imprint</a></div></body>", ["Title", P, "Short", P]),
    "one form around all": (f"<body><form id=page><nav>x</nav><article><p>{P}</p></article><div class=cookie>no {P}</div></form></body>", [P]),
    "sections": (f"<main><h1>T</h1><section><h2>A</h2><p>{P}</p></section><section><h2>B</h2><p>{P}</p></section></main>", ["T", "A", P, "B", P]),
    "header in an article": (f"<article><header><h1>Title</h1><p>By X</p></header><p>{P}</p><footer>tags</footer></article>", ["Title", P]),
    "classes about absent parts": (f"<body class='has-sidebar no-comments'><div class='layout with-sidebar'><main><p>{P}</p></main><div class=sidebar>{P}</div></div></body>", [P]),
    "roles and hidden parts": (f"<div role=navigation>{P}</div><div role=main><p>{P}</p><p hidden>{P}</p><p style='display: none'>{P}</p></div><div role=contentinfo>{P}</div>", [P]),
    "attributes with brackets": ("<article><p title=\"a > b\" data-x='<p>'>Hello</p><p>1 < 2 &amp;&amp; 3 > 2</p></article>", ["Hello", "1 < 2 && 3 > 2"]),
    "open elements": (f"<article><h1>T</h1><p><b>Bold.<br><p>{P}<p>{P}", ["T", "Bold.", P, P]),
    "references": ("<article><p>&lt;p&gt; &#233;&#xE9;&eacute; &am &amp &quot;&nbsp;x&#10;y &unknown;</p></article>", ['<p> ééé &am & " x y &unknown;']),
    "cut in a tag": (f"<article><p>{P}</p><p cla", [P]),
    "cut in a comment": (f"<article><p>{P}</p><!-- p", [P]),
    "no elements": ("just text &lt; no tags", ["just text < no tags"]),
    "only menus": ("<nav>a</nav><footer>f</footer>", []),
    "empty": ("", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_made_pages(name):
    source, want = PAGES[name]
    assert main_blocks(source) == want


def test_short_paragraphs_share_the_ratio_of_their_path():
    """The shortest paragraph of the article stays, a longer notice without any label goes."""
    page = f"<body><div><span>{NOISE}</span></div><div>" + f"<p>{P}</p>" * 6 + "<p>No.</p></div></body>"
    assert main_blocks(page) == [P] * 6 + ["No."]


def test_linear_in_the_length_of_bad_pages():
    began = time.time()
    for unit in ("<a ", "<b>", "<div>", "<li>", '<p title="', "<!--", "<div><b>", "<table><tr><td>", "<header>", "<main>", "</div>", "<form>", "x &amp"):
        main_blocks(unit * 30_000 + "x")
    assert time.time() - began < 30


def plain(source: str) -> str:
    art = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", art))
    return "\n".join(b for b in blocks if b)


def test_all_pages_of_a_table(spark):
    """Every page of the table, against the plain reading of its article."""
    sf = "/root/testdata/sf0.01"
    want = {r["page_id"]: (r["url"], plain(r["html"])) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op13_html_extract(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r["page_id"]: (r["url"], r["text"]) for r in got.collect()} == want
    assert got.where("n_chars != length(text)").count() == 0


def test_odd_rows(spark):
    """Nulls, repeated rows, a long page, clashing columns, no rows."""
    long = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    rows = [(None, None, None, "t", 1), (1, "u", "", "t", 1), (1, "u", "", "t", 1), (2, None, f"<article>{P}</article>", None, None), (3, "v", long, "t", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((tuple(r) for r in html_extract(pages).collect()), key=repr)
    whole = "\n".join([P] * 20_000)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, None, P, len(P)), (3, "v", whole, len(whole))], key=repr)
    assert html_extract(pages.limit(0)).collect() == []
    assert html_extract(pages.withColumn("page_id", F.col("page_id").cast("int"))).count() == 5
