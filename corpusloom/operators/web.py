"""Pages and URLs: paragraphs, sitemaps, links, names, deny-lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DENY_LINK, DENY_URL, SEED

DROPPED = ("script", "style", "noscript")
#: The white space that is stripped from the ends of a text.
STRIPPED = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
#: Character references that are decoded without leaving the JVM; &amp; last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def paragraphs(html: Column) -> Column:
    """The bodies of p elements as an array of trimmed texts without tags, after scripts, styles and noscripts are cut out."""
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))

    # Many paragraphs are one string for the decoder; a record separator parts them (no page's text has one left by now).
    bare = F.transform(found, lambda p: F.replace(F.regexp_replace(p, "<[^>]+>", " "), F.lit("\x1e"), F.lit(" ")))
    joined = F.array_join(bare, "\x1e")
    decoded = F.coalesce(unescape(F.when(joined.contains("&"), joined)), joined)
    parts = F.transform(F.split(decoded, "\x1e"), lambda p: F.regexp_replace(F.btrim(p, F.lit(STRIPPED)), "[ \t]+", " "))
    return F.when(F.size(found) > 0, parts).otherwise(F.array().cast("array<string>"))


def paragraph_text(html: Column, least: int = 200) -> Column:
    """The paragraphs by lines; empty if they have fewer characters than `least`."""
    text = F.btrim(F.array_join(paragraphs(html), "\n"), F.lit(STRIPPED))
    return F.when(F.length(text) >= least, text).otherwise("")


def _unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    from html import unescape as decode

    for s in parts:
        yield pd.Series([None if t is None else decode(t) for t in s], dtype=object)


def unescape(text: Column) -> Column:
    """All character references decoded, named and numbered; Spark has no function for them."""
    return F.pandas_udf(_unescape, "string")(text)


def sitemap(xml: Column) -> tuple[Column, Column]:
    """A sitemap's child maps and page URLs: loc elements, or the http lines of a plain text, or loc elements with a prefix."""
    locs = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.btrim(x))
    plain = F.filter(F.transform(F.split(xml, r"\r\n|[\n\r]"), lambda x: F.btrim(x)), lambda x: x.startswith("http"))
    index = F.lower(F.substring(xml, 1, 2000)).contains("<sitemapindex")
    none = F.array().cast("array<string>")
    # A document whose elements have a prefix is read as XML: its first element tells what it is, and references are decoded.
    root = F.lower(F.regexp_extract(xml, r"(?s)\A\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1))
    prefixed = F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<([\w.-]+):loc\b[^>]*>([^<]*)</\1:loc>"), F.lit(2)), lambda x: F.btrim(reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), REFERENCES, x))), lambda x: x != "")
    named = (F.size(locs) == 0) & (F.size(plain) == 0)
    children = F.when(index & (F.size(locs) > 0), locs).when(named & root.endswith("sitemapindex"), prefixed).otherwise(none)
    urls = F.when(F.size(locs) > 0, F.when(index, none).otherwise(locs)).when(F.size(plain) > 0, plain).when(~root.endswith("sitemapindex"), prefixed).otherwise(none)
    return children, urls


def hrefs(html: Column) -> Column:
    """The raw targets of links."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))


def _absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urldefrag, urljoin

    return pd.Series([None if b is None or h is None else urldefrag(urljoin(b, h))[0] for b, h in zip(base, href, strict=True)])


def absolute(base: str, href: str) -> Column:
    """Links made absolute, without fragments."""
    return F.pandas_udf(_absolute, "string")(base, href)


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, link: the distinct absolute links of pages (page_id, url, html)."""
    return pages.select("page_id", "url", F.explode(hrefs(F.col("html"))).alias("href")).select("page_id", "url", absolute("url", "href").alias("link")).distinct()


def authority(url: Column) -> Column:
    """Host with port and user, as in the URL."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_article(url: Column) -> Column:
    return ~url.rlike(DENY_URL)


def may_follow(url: Column) -> Column:
    return ~url.rlike(DENY_LINK)


def is_pdf(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def unquoted(text: Column) -> Column:
    """Percent signs decoded as UTF-8, one that doesn't begin a code stays, and bad bytes become replacement characters. A plus stays a plus."""
    decoded = F.try_url_decode(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(text.contains("%"), F.coalesce(decoded, text)).otherwise(text)


def safe_name(url: Column) -> Column:
    """A file name that stays readable and doesn't collide: the path's last part, percent signs decoded, and 8 digits of the URL's hash."""
    base = unquoted(F.element_at(F.split(path(url), "/"), -1))
    base = F.substring(F.regexp_replace(F.when(base == "", "document.pdf").otherwise(base), "[^A-Za-z0-9._-]+", "_"), 1, 80)
    stem = F.when(F.lower(base).endswith(".pdf"), F.substring(base, F.lit(1), F.length(base) - 4)).otherwise(base)
    return F.concat(stem, F.lit("__"), F.substring(F.md5(url), 1, 8), F.lit(".pdf"))


def fetch_outcome(status: Column, content_type: Column, size: Column) -> Column:
    """What a fetch says of a URL: answers below 500 are final, server errors are asked again, and only html and xml are read."""
    return (
        F.when(status.isNull() | (status >= 500), "retry_later")
        .when(status.between(400, 499), F.concat(F.lit("http_"), status.cast("string")))
        .when(~F.coalesce(content_type, F.lit("")).rlike("html|xml"), "content_type")
        .when(size == 0, "empty")
        .otherwise("ok")
    )


def final(outcome: Column) -> Column:
    """Whether a URL with this outcome belongs into the log of visited ones."""
    return outcome != "retry_later"


def unvisited(urls: DataFrame, visited: DataFrame, order: str = "forward", seed: int = SEED) -> DataFrame:
    """urls (url, place) without those in visited (url), with turn to sort by: forward, from the tail, or shuffled anew."""
    if order not in ("forward", "tail", "reshuffle"):
        raise ValueError(f"unknown order: {order}")
    turn = {"forward": F.col("place"), "tail": -F.col("place"), "reshuffle": F.xxhash64(F.lit(seed + 1), F.col("url"))}[order]
    return urls.join(visited.select("url").distinct(), "url", "left_anti").withColumn("turn", turn.cast("long"))


def record_visits(visited: DataFrame, fetched: DataFrame) -> DataFrame:
    """The log of visited URLs after a run: what it held and the new final ones, each once with its outcome (the earlier one counts)."""
    new = fetched.filter(final(F.col("outcome"))).select("url", "outcome", F.lit(1).alias("_run"))
    both = visited.select("url", "outcome", F.lit(0).alias("_run")).unionByName(new)
    return both.groupBy("url").agg(F.min(F.struct("_run", "outcome"))["outcome"].alias("outcome"))


def merged_list(prior: DataFrame, found: DataFrame) -> DataFrame:
    """url and place: a list and what was found since, each URL where it comes first (place counts on from the prior list's)."""
    after = F.coalesce(F.lit(prior.agg(F.max("place")).head()[0]).cast("long"), F.lit(-1)) + 1
    both = prior.select("url", F.col("place").cast("long").alias("place")).unionByName(found.select("url", (F.col("place").cast("long") + after).alias("place")))
    return both.groupBy("url").agg(F.min("place").alias("place"))


def valid_pdf(content: Column, least: int = 20_000) -> Column:
    """Whether a fetched file is a PDF of some size."""
    return (F.octet_length(content) >= least) & (F.hex(F.substring(content, 1, 4)) == "25504446")
