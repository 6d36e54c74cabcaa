"""Main text of web pages as a maximum-scoring subsequence.

A page is read as a row of words and tags, each with a score: words by where they stand (the block around
them, in a link or not, in an article or not) and by what the elements around them are called, tags below
zero. A linear scan finds the contiguous region with the best sum; what it holds is the text, but for small
blocks in it that are called like adverts, forms and the like. All weights come from labelled pages: those of
words from how often words that stand so are main text, those of tags from how often each stands outside main
text, those of an element's name, classes, id and role from the elements that hold main text and those that
don't.

A name only ever lowers what an element adds. It says nothing of an element that holds the page's article, nor
of one that holds most of what it stands in: pages are wrapped in elements of any name.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, slices

#: A comment, a declaration, a tag with quoted attributes, or a tag cut off by the page's end.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*+(?:>|\Z))|<(?=/?\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content is never text for a reader.
RAW = {"script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that a page's main text can be named by; they are never left out for their names alone.
ROOTS = {"html", "body", "main", "article"}
#: A start tag of one of these ends an open paragraph or list item.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: What an element's names must sum up to for it to be left out, or (with a good part of the page's words) to count as the article.
OUT, ANCHOR = -1.0, 1.5
#: An element with more than this share of the words that it stands among says nothing by its name.
MOST = 0.4
#: An element with this share of a page's words is where most text is.
DOMINANT = 0.6
#: Elements that are beside the main text by their meaning, however much they hold.
BESIDE = {"aside", "dialog", "footer", "menu", "nav"}


class Element:
    """An element and what holds for all in it: labelled main text; the block around, in a link or not; in an article; the least and greatest of what names around say; whether it would be left out; whether it is where most text is."""

    __slots__ = ("anchors", "article", "block", "called", "good", "holds", "inside", "least", "link", "main", "most", "near", "out", "parent", "parts", "tag", "words")

    def __init__(self, tag: str = "", attributes: str = "", parent: Element | None = None):
        self.tag, self.parent, self.words, self.holds, self.anchors = tag, parent, 0, False, 0
        self.called = names(tag, attributes) if tag else []
        # A link ends where a block begins, as links are often left open.
        self.block, self.link = ("", False) if parent is None else (parent.block, parent.link or tag == "a") if tag in INLINE else (tag, False)
        self.main = parent is not None and (parent.main or "data-main" in attributes) and "data-out" not in attributes
        self.article = tag == "article" or (parent is not None and parent.article)
        self.inside, self.least, self.most, self.out = False, 0.0, 0.0, False
        self.good, self.parts, self.near = 0, 0, False

    def says(self, weight: dict[str, float]) -> float:
        """What the names say, by what they say in or out of articles."""
        inner = self.parent is not None and self.parent.article
        return max(-3.0, min(2.0, sum(weight.get(x + "+" * inner, 0.0) for x in self.called)))


class Run:
    """Some text between two tags, or a tag (a start tag of an element: with what the element is called), and the element that it stands in."""

    __slots__ = ("at", "name", "open", "text")

    def __init__(self, name: str, text: str, at: Element, opens: bool = False):
        self.name, self.text, self.at, self.open = name, text, at, opens


def n_words(text: str) -> int:
    """Words, and at least one for each 40 characters (scripts without spaces)."""
    return 0 if text.isspace() else max(len(text.split()), len(text) // 40)


def best_region(scores: list[float]) -> tuple[int, int]:
    """begin and end of the contiguous region with the greatest sum (the first of equals; empty if none is above zero), by one scan."""
    best, begin, end, total, since = 0.0, 0, 0, 0.0, 0
    for k, x in enumerate(scores):
        total += x
        if total <= 0:
            total, since = 0.0, k + 1
        elif total > best:
            best, begin, end = total, since, k + 1
    return begin, end


def names(tag: str, attributes: str) -> list[str]:
    """What an element is called: its tag, and the words of its class, id, role and the like."""
    found = [f"<{tag}>"]
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
            found += [w for w in re.split(r"[^a-z]+", value) if w]
    return found


def parsed(html: str) -> tuple[list[Run], list[Element]]:
    """The page's texts and tags in order, and its elements, each after the one that it stands in."""
    top = Element()
    rows: list[Run] = []
    elements, stack = [top], [top]
    at, raw = 0, ""

    def text(t: str) -> None:
        stack[-1].words += n_words(t)
        rows.append(Run("", t, stack[-1]))

    for m in MARKUP.finditer(html):
        if raw:
            if m[1] == "/" and m[2] and m[2].lower() == raw:
                raw = ""
            at = m.end()
            continue
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in RAW:
                continue
            here = stack[-1]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            rows.append(Run(tag, "", here))
            continue
        if tag in RAW:
            raw = "" if m[3].endswith("/>") else tag
            if tag in ("script", "style", "title", "textarea") and raw:
                # Their content is not markup: go on after the end tag.
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                if not end:
                    at = len(html)
                    break
            continue
        if tag in VOID:
            rows.append(Run(tag, "", stack[-1]))
            continue
        while len(stack) > 1 and stack[-1].tag in CLOSES.get(tag, ()):
            stack.pop()
        new = Element(tag, m[3], stack[-1])
        elements.append(new)
        stack.append(new)
        rows.append(Run(tag, " ".join(new.called), new, True))
    if not raw and at < len(html):
        text(html[at:])
    for e in reversed(elements[1:]):
        e.parent.words += e.words
    return rows, elements


def judge(elements: list[Element], weight: dict[str, float]) -> None:
    """Set, for each element, what names around it say, whether it is in the article, and whether it would be left out.

    The article is what article elements hold, else main elements, unless their names are those of comments
    and the like; beside those, elements with telling names and a good part of the words count as if. What an
    element is called says nothing against it where one of those is in it; where it has most of the words of the
    one that it stands in, and there is none elsewhere; or where the page has none and it has most of all words.
    """
    said = [e.says(weight) for e in elements]
    total = elements[0].words
    roots = next((r for tag in ("article", "main") if (r := [e for e, x in zip(elements, said, strict=True) if e.tag == tag and e.words and x > 2 * OUT])), [])
    anchors = set(map(id, roots)) | {id(e) for e, x in zip(elements, said, strict=True) if x >= ANCHOR and e.tag not in INLINE and 4 * e.words > total}
    within = set(map(id, roots))
    for e in reversed(elements[1:]):
        e.parent.holds = e.parent.holds or e.holds or id(e) in anchors
    for e, x in zip(elements, said, strict=True):
        up = e.parent
        if up is None:
            continue
        e.anchors = up.anchors + (id(e) in anchors)
        e.inside = up.inside or id(e) in within
        around, nearest = total, up
        while nearest.parent is not None and id(nearest) not in anchors:
            nearest = nearest.parent
        around = nearest.words
        if x < 0 and (e.holds or e.tag in ("html", "body") or id(e) in anchors or (e.tag not in BESIDE and e.anchors == len(anchors) and e.words > MOST * around)):
            x = 0.0
        e.least, e.most = min(up.least, x), max(up.most, x)
        e.out = e.least < OUT


def runs(html: str, weight: dict[str, float]) -> list[Run]:
    """The page's texts and tags in order, with where each stands by what names say."""
    rows, elements = parsed(html)
    judge(elements, weight)
    for r in rows:
        if not r.name and not r.at.out and not r.at.link:
            r.at.good += n_words(r.text)
    for e in reversed(elements[1:]):
        e.parent.good += e.good
        e.parent.parts += e.good > 0 and e.tag not in INLINE
    # Where most text is: the innermost element of several parts with most of the words that aren't links.
    most = elements[0]
    for e in elements:
        if e.parts > 1 and e.good >= DOMINANT * elements[0].good:
            most = e
    for e in elements:
        e.near = e is most or (e.parent is not None and e.parent.near)
    return rows


class Extractor:
    def __init__(self, pages: Iterable[str]):
        """Learns from labelled pages."""
        pages = list(pages)
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for page in pages:
            _, elements = parsed(page)
            wraps: set[int] = set()
            for e in reversed(elements[1:]):
                if e.main or id(e) in wraps:
                    wraps.add(id(e.parent))
            for e in elements[1:]:
                # A class of what holds main text, around it or in it, speaks for that class; an element around it says nothing of its kind.
                inner, around = "+" * e.parent.article, id(e) in wraps and not e.main
                held[e.main or around].update({x + inner for x in e.called if not (around and x[0] == "<")} - {"data" + inner, "out" + inner})
        self.weight = {x: log((held[True][x] + 0.5) / (held[False][x] + 0.5)) for x in held[True] | held[False]}
        # Elements that stand in main text and elsewhere alike say nothing about what they hold, nor do inline ones.
        self.weight = {x: w for x, w in self.weight.items() if not (x[0] == "<" and (held[True][x] or x.strip("<>+") in INLINE))}
        tags, outside, words, in_main = Counter(), Counter(), Counter(), Counter()
        for page in pages:
            rows = runs(page, self.weight)
            named = self.has_article(rows)
            for k, r in enumerate(rows):
                if r.at.out:
                    continue
                if r.open:
                    tags[self.kind(rows, k)] += 1
                    outside[self.kind(rows, k)] += not r.at.main
                elif not r.name:
                    key, n = self.place(r.at, named), n_words(r.text)
                    words[key] += n
                    in_main[key] += n * r.at.main
        #: What a start tag adds to a region.
        self.tag = {k: -0.1 - 10 * outside[k] / n for k, n in tags.items() if k[0] not in INLINE}
        #: What a word adds, by where it is.
        self.word = {k: max(-1.0, min(1.0, log((in_main[k] + 0.5) / (n - in_main[k] + 0.5)))) for k, n in words.items() if n}

    @staticmethod
    def has_article(rows: list[Run]) -> bool:
        return any(r.at.inside for r in rows)

    @staticmethod
    def place(e: Element, named: bool) -> tuple[str, bool, bool, bool, bool]:
        """Of a word: the block around it, whether it is in a link, whether in an article, whether the page has one, and if not, whether it is where most text is."""
        return e.block, e.link, e.inside, named, e.near and not named

    @staticmethod
    def kind(rows: list[Run], k: int) -> tuple[str, bool, bool]:
        """Of a start tag: its element, whether it is in an article, and whether it begins with a link."""
        return rows[k].name, rows[k].at.inside, k + 1 < len(rows) and rows[k + 1].name == "a"

    def scores(self, rows: list[Run]) -> list[float]:
        """What each text and tag of a page adds to a region; what would be left out of an article adds nothing, other such words take away."""
        out, named = [], self.has_article(rows)
        for k, r in enumerate(rows):
            at = r.at
            if at.out and (at.inside or at.anchors or r.name):
                x = 0.0 if at.inside or at.anchors else -0.1
            elif r.name:
                x = self.tag.get(self.kind(rows, k), -0.1 if at.inside or r.name in INLINE else -1.0) if r.open else -0.1
            else:
                x = self.word.get(self.place(at, named), 1.0 if at.inside else -0.5 if at.link or named or not at.near else 1.0)
                x = n_words(r.text) * max(-2.0, min(1.5, x + at.most / 2 + at.least))
            out.append(x)
        return out

    def region(self, rows: list[Run]) -> list[Run]:
        begin, end = best_region(self.scores(rows))
        return rows[begin:end]

    @staticmethod
    def joined(rows: list[Run]) -> str:
        """The text of a region without the small blocks in it that would be left out."""
        total = sum(n_words(r.text) for r in rows if not r.name)
        found = []
        for r in rows:
            if r.name and r.name not in INLINE:
                found.append(" ")
            elif not r.name and not (r.at.out and Extractor._cut(r.at).words <= MOST * total):
                found.append(unescape(r.text) if "&" in r.text else r.text)
        return " ".join("".join(found).split())

    @staticmethod
    def _cut(e: Element) -> Element:
        """The outermost element around e that would be left out."""
        while e.parent is not None and e.parent.out:
            e = e.parent
        return e

    def text(self, html: str | None) -> str:
        """The main text; empty if there is none."""
        return self.joined(self.region(runs(html or "", self.weight)))


@functools.cache
def extractor() -> Extractor:
    """The extractor learned from the pages in labelled_pages, once for each worker process."""
    from corpusloom.llm.labelled_pages import PAGES

    return Extractor(PAGES)


def extract(pages: DataFrame) -> DataFrame:
    """Every row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    Null html counts as empty; a page without main text gives the empty text. Null page_ids and urls stay null,
    repeated rows come out as often as they go in, other columns (of any name) are not looked at, and an empty
    table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = extractor()
        for batch in slices(batches, "html"):
            texts = [e.text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
