"""The passes for main text on pages with and without article elements."""

from __future__ import annotations

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.maintext import main_text, precise, wide

P = ["The first paragraph of a story that is long enough to count, with some words more.", "A second one, which has <a href=x>a link</a> in the midst of its words &amp; goes on after it.", "The third paragraph ends the story, and it is about as long as the others are."]
TEXT = ["The first paragraph of a story that is long enough to count, with some words more.", "A second one, which has a link in the midst of its words & goes on after it.", "The third paragraph ends the story, and it is about as long as the others are."]
BODY = "".join(f"<p>{p}</p>" for p in P)
MENU = "<nav><ul><li><a href=1>Home</a></li><li><a href=2>News of the day</a></li></ul></nav>"
LINKS = "<div class=more><ul>" + "".join(f"<li><a href={i}>Another story with a long title number {i}</a></li>" for i in range(9)) + "</ul></div>"
STORY = "\n".join(TEXT)


@pytest.mark.parametrize("html", [
    f"<body>{MENU}<article><h1>Title</h1>{BODY}<aside><p>{'beside ' * 30}</p></aside></article>{LINKS}<footer><p>{'foot ' * 50}</p></footer></body>",
    f"<body>{MENU}<main><h1>Title</h1>{BODY}{LINKS}</main><div>{'other words ' * 30}</div></body>",
    f"<body><div id=top>{MENU}</div><div class=x><h1>Title</h1>{BODY}</div>{LINKS}<div class=y><p>Short words here</p></div></body>",
    f"<table><tr><td><a href=1>One</a><td><h1>Title</h1>{BODY}</table>",
])
def test_precision(html):
    assert precise(html) == f"Title\n{STORY}"


def test_which_pass_finds_it(spark):
    half = f"<p>{P[0]}</p>"
    pages = {
        "precision": (f"<article>{BODY}{BODY}</article>", STORY),
        "recall": (f"<article>{half}</article><div>{half}</div><div><span>{P[1]}</span></div>", f"{TEXT[0]}\n{TEXT[0]}\n{TEXT[1]}"),
        "paragraphs": (f"<footer>{BODY}</footer>", None),
        "none": (f"<article>{half}</article>", ""),
    }
    rows = [(k, h) for k, (h, _) in pages.items()] + [("null", None), ("empty", ""), ("open", "<p><b")]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k string, html string").repartition(2).select("k", main_text(F.col("html")).alias("m")).collect()}
    for k, (_, text) in pages.items():
        assert got[k].extractor == k and (text is None or got[k].text == text)
    assert len(got["paragraphs"].text) >= 200 and all(tuple(got[k]) == ("", "none") for k in ("null", "empty", "open"))


def test_wide_keeps_what_is_not_links():
    assert wide(f"{MENU}<div>{BODY}</div>{LINKS}<div>and <a href=x>so</a> on</div>") == f"{STORY}\nand so on"


def test_long_and_odd_pages_end():
    assert precise("<div>" * 3000 + "text " * 100 + "</div>" * 3000).startswith("text text") and isinstance(precise("<" * 1000), str)
    assert len(precise("<article><p>" + "word " * 200_000 + "</p></article>")) == 999_999


def test_pages_of_the_table(spark, sf):
    """Their article elements hold the text, block by block; a repeated block is there once."""
    from corpusloom.queries import main_text as query

    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    seen = 0
    for r in query(spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p|div|br)\b[^>]*>", article)]
        text = "\n".join(dict.fromkeys(b for b in blocks if b))
        if len(text) >= 200:
            assert (r.extractor, r.text) == ("precision", text)
            seen += 1
    assert seen > 20
