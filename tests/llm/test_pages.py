"""Main text of pages that are not among the labelled ones: wrappers of any name, blocks with names never seen, layouts without names."""

from __future__ import annotations

import pytest

STORY = "<h2>The headline</h2><p>First words of a text that goes on for some time here.</p><p>Second paragraph of the same story, with some more words in it.</p><p>Third one, which ends the story after all of these words.</p>"
WANT = "The headline First words of a text that goes on for some time here. Second paragraph of the same story, with some more words in it. Third one, which ends the story after all of these words."
ARTICLE = f"<article>{STORY}</article>"
READERS = "<div class='u1'><p>I like this story a lot, thanks.</p></div><div class='u1'><p>So do I, and my friends too.</p></div>"
SIDE = "<aside class='sidebar'><p>side words here</p></aside>"

#: Names in these pages that no labelled page has: livefyre, fyre, zergnet, mailmunch, kx, z9, q1 to q3, u1, aspnet.
HELD_OUT = {
    "site": f"<div id='page' class='site'>{ARTICLE}</div>",
    "row": f"<div class='row'>{ARTICLE}{SIDE}</div>",
    "has-sidebar": f"<div class='layout has-sidebar'>{ARTICLE}{SIDE}</div>",
    "form": f"<form id=aspnetForm>{ARTICLE}<footer>f</footer></form>",
    "readers of unseen name": f"<article>{STORY}</article><div class=livefyre>{READERS * 3}</div>",
    "readers in main": f"<main>{ARTICLE}<section class=fyre>{READERS * 4}</section></main>",
    "no article": f"<div class=z9>{STORY}</div><div class=livefyre>{READERS}</div>",
    "no article, wrapped": f"<div id=page class=site><div class='row'><div class=kx>{STORY}</div><div class=fyre>{READERS}</div></div></div>",
    "advert before": f"<div class=zergnet><p>Buy a new car today for little money</p></div><div class=kx>{STORY}</div>",
    "letter after": f"<div class=kx>{STORY}</div><div class=mailmunch><p>Get our letter each week in your box</p></div>",
    "center": f"<center>{STORY}</center>",
    "table": f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td>{STORY}</td></tr></table><p><small>made in 1999</small></p>",
    "form without article": f"<form id=aspnetForm><div class=q1><a href=1>A</a><a href=2>B</a></div><div class=q2>{STORY}</div><div class=q3>imprint words</div></form>",
    "sidebar without article": f"<div class='layout has-sidebar'><div class=kx>{STORY}</div><div class=sidebar><p>some side words here</p></div></div>",
}


@pytest.mark.parametrize("name", HELD_OUT)
def test_pages_not_among_the_labelled(name):
    from corpusloom.llm.html_text import extractor

    assert extractor().text(HELD_OUT[name]) == WANT


def test_blocks_in_an_article_keep_their_text_whatever_they_are_called():
    from corpusloom.llm.html_text import extractor

    html = "<article><h1>The title</h1><p>First words of a text that goes on for some time.</p><div class='widget-text'><p>Second paragraph with words in it that matter.</p></div><p class='legal'>A legal paragraph of the story itself.</p><div class='advert'>Buy</div></article>"
    assert extractor().text(html) == "The title First words of a text that goes on for some time. Second paragraph with words in it that matter. A legal paragraph of the story itself."


def test_no_name_empties_a_page():
    from corpusloom.llm.html_text import extractor

    e = extractor()
    names = sorted({x.rstrip("+") for x in e.weight if x[0] != "<"})
    assert {"site", "row", "sidebar", "form", "social", "comment", "footer"} <= set(names)
    for w in names:
        for html in (f"<div class='{w}'>{ARTICLE}</div>", f"<div class='{w}'>{STORY}</div>", f"<body id='{w}'><div class='a {w}'>{STORY}</div></body>", f"<div class='{w}'><nav><a>x</a></nav>{ARTICLE}<footer>f</footer></div>"):
            assert e.text(html) == WANT, w


def test_the_scan_decides():
    """Without the scan, most of these pages would have more text than their own."""
    from corpusloom.llm.html_text import extractor, runs

    e = extractor()
    whole = {k: e.joined(runs(h, e.weight)) for k, h in HELD_OUT.items()}
    assert sum(t != WANT for t in whole.values()) >= 8 and all(WANT in t for t in whole.values())
