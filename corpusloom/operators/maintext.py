"""Main text of a fetched page: a pass for precision, then one for recall, then its paragraphs.

A page is a tree of blocks. Each block and each element around it is known by how much text it has and how much
of that is in links. The pass for precision takes one container and the blocks in it that are hardly links; the
one for recall takes all blocks of the page that are not mostly links. A pass counts if it finds 200 characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.operators.web import paragraph_text

LEAST = 200
#: Most of a block's characters that links may have, and of an element around it, in the pass for precision; and of a block in that for recall.
BLOCK_LINKS, AROUND_LINKS, RECALL_LINKS = 0.2, 0.5, 0.5
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
SKIPPED = {"script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br"}
#: What is beside the main text, wherever it stands, and what is so but in an article.
BESIDE, HEADS = {"aside", "button", "dialog", "footer", "form", "head", "menu", "nav"}, {"header"}


class Node:
    __slots__ = ("beside", "direct", "length", "links", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.length, self.links, self.direct = tag, parent, 0, 0, 0
        self.beside = parent is not None and parent.beside or tag in BESIDE or (tag in HEADS and not _within(parent, "article"))


def _within(node: Node | None, tag: str) -> bool:
    while node is not None and node.tag != tag:
        node = node.parent
    return node is not None


def _blocks(html: str) -> tuple[list[tuple[str, int, Node]], list[Node]]:
    """The page's blocks of text, with the characters of each in links and the element that each stands in; and all block elements."""
    root = Node("", None)
    nodes, stack, out = [root], [root], []
    parts: list[str] = []
    at, in_link, linked = 0, False, 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, min(linked, len(text)), stack[-1]))
            node: Node | None = stack[-1]
            if node.parent is not None:
                node.parent.direct += len(text) if linked <= BLOCK_LINKS * len(text) else 0
            while node is not None:
                node.length, node.links = node.length + len(text), node.links + min(linked, len(text))
                node = node.parent
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        text = unescape(text) if "&" in text else text
        parts.append(text)
        if in_link:
            linked += len("".join(text.split()))

    while True:
        m = TOKEN.search(html, at)
        add(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closes = m[2].lower(), m[1] == "/"
        if tag in SKIPPED:
            if not closes and not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = close.end() if close else len(html)
        elif tag == "a":
            in_link = not closes
        elif tag in BLOCKS:
            end()
            in_link = False
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            elif tag not in VOID:
                if tag in ("p", "li", "td", "tr", "dt", "dd") and stack[-1].tag in ("p", tag):
                    stack.pop()
                stack.append(Node(tag, stack[-1]))
                nodes.append(stack[-1])
    end()
    return out, nodes


def _links(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def precise(html: str) -> str:
    """The blocks of one container, each once: of the article or main element with most text, else of the element that blocks with most text stand in."""
    blocks, nodes = _blocks(html)
    for tag in ("article", "main", ""):
        found = [n for n in nodes if n.length and not n.beside and (n.tag == tag or not tag)]
        if found:
            break
    else:
        return ""
    top = max(found, key=lambda n: n.length if tag else n.direct)

    def good(node: Node) -> bool:
        while node is not top:
            if node.parent is None or node.beside and not top.beside or (node.tag not in ("p", "li", "td") and _links(node) > AROUND_LINKS):
                return False
            node = node.parent
        return True

    return "\n".join(dict.fromkeys(text for text, linked, node in blocks if linked <= BLOCK_LINKS * len(text) and good(node)))


def wide(html: str) -> str:
    """All blocks that aren't beside the text and not mostly links."""
    return "\n".join(text for text, linked, node in _blocks(html)[0] if not node.beside and linked <= RECALL_LINKS * len(text))


def _passes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in parts:
        found = []
        for html in s:
            text, name = "", ""
            for name, of in (("precision", precise), ("recall", wide)):
                text = of(html or "")
                if len(text) >= LEAST:
                    break
            else:
                text = name = ""
            found.append((text, name))
        yield pd.DataFrame(found, columns=["text", "extractor"])


def main_text(html: Column) -> Column:
    """text and extractor (precision, recall, paragraphs or none): what the first pass with enough text finds. A null page has none."""
    passes = F.pandas_udf(_passes, "text string, extractor string")(html)
    paragraphs = F.coalesce(paragraph_text(html, LEAST), F.lit(""))
    rest = F.struct(paragraphs.alias("text"), F.when(paragraphs != "", "paragraphs").otherwise("none").alias("extractor"))
    return F.when(passes["extractor"] != "", passes).otherwise(rest)
