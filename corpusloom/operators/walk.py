"""Breadth-first walks: over links between pages, and over nested sitemaps.

A walk goes level by level. Each level is the last one joined with a table of edges, less what was reached
before. What a queue would take first is kept as data: a node's order is the places of the links on the way to
it, so of all ways to a node on its first level the one that a queue would have met first counts, whatever the
partitions are.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import web
from corpusloom.operators.budget import ranked
from corpusloom.scratch import Scratch


def breadth_first(edges: DataFrame, starts: DataFrame, scratch: Scratch, depth: int | None = None) -> DataFrame:
    """origin, node, depth, parent, order: the nodes that each origin reaches, at their least depth.

    edges: (source, at, target), at being the place of the link in its source. starts: (origin, node, place).
    Walks of different origins don't see each other. parent is null at the starts; order is an array of places.
    """
    first = starts.groupBy("origin", "node").agg(F.min("place").alias("place"))
    level = scratch.table(first.select("origin", "node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.array(F.col("place").cast("long")).alias("order")), "level-0")
    reached = level
    links = scratch.table(edges.groupBy("source", "target").agg(F.min(F.col("at").cast("long")).alias("at")), "links")
    for k in itertools.count(1):
        if (depth is not None and k > depth) or level.isEmpty():
            return reached
        found = level.join(links, level["node"] == links["source"]).select("origin", F.col("target").alias("node"), F.struct(F.concat("order", F.array("at")).alias("order"), F.col("node").alias("parent")).alias("way"))
        found = found.groupBy("origin", "node").agg(F.min("way").alias("way")).join(reached.select("origin", "node"), ["origin", "node"], "left_anti")
        level = scratch.table(found.select("origin", "node", F.lit(k).alias("depth"), F.col("way.parent").alias("parent"), F.col("way.order").alias("order")), f"level-{k}")
        reached = reached.union(level)


def page_walk(pages: DataFrame, seeds: DataFrame, depth: int, per_host: int | None = None) -> DataFrame:
    """url, kind, depth, parent, fetched: pages and PDF files that seeds (url, place) lead to in `depth` steps over pages (url, html).

    Links are followed within a host, but for those that shouldn't be; PDF files may be on any host and cost no
    step. fetched tells whether the table has the page; others are reached but lead nowhere. With per_host, only
    the first so many pages of a host, in the order of the walk, count.
    """
    scratch = Scratch(pages.sparkSession, "walk")
    own = pages.groupBy("url").agg(F.first("html").alias("html"))
    found = own.select("url", F.posexplode(web.hrefs(F.col("html"))).alias("at", "href")).select("url", "at", F.btrim("href").alias("href"))
    found = found.select("url", "at", web.absolute("url", "href").alias("link")).filter(F.col("link").rlike("^https?://"))
    found = scratch.table(found, "found")
    pdf = web.is_pdf(F.col("link"))
    follow = ~pdf & (web.authority(F.col("link")) == web.authority(F.col("url"))) & web.may_follow(F.col("link"))
    starts = seeds.select(F.lit("").alias("origin"), F.col("url").alias("node"), "place")
    reached = scratch.table(breadth_first(found.filter(follow).select(F.col("url").alias("source"), "at", F.col("link").alias("target")), starts, scratch, depth), "reached")
    if per_host is not None:
        rows = reached.withColumn("host", web.authority(F.col("node")))
        reached = ranked(rows, ["host"], ["depth", "order", "node"], scratch).filter(F.col("rank") <= per_host).select(*reached.columns)
    files = reached.filter(F.col("depth") < depth).join(found.filter(pdf), F.col("node") == F.col("url"))
    files = files.groupBy("link").agg(F.min(F.struct("depth", F.concat("order", F.array(F.col("at").cast("long"))).alias("order"), F.col("node").alias("parent"))).alias("way"))
    files = files.join(reached.select(F.col("node").alias("link")), "link", "left_anti")
    there = own.select(F.col("url").alias("node"), F.lit(True).alias("there"))
    walked = reached.join(there, "node", "left").select(F.col("node").alias("url"), F.lit("page").alias("kind"), "depth", "parent", F.col("there").isNotNull().alias("fetched"))
    return walked.union(files.select(F.col("link").alias("url"), F.lit("pdf"), F.col("way.depth"), F.col("way.parent"), F.lit(False)))


def sitemap_walk(maps: DataFrame, starts: DataFrame, max_maps: int = 200, max_urls: int | None = 100_000) -> DataFrame:
    """origin, url, map, depth: the page URLs that each origin's sitemaps name, nested ones too.

    maps: (url, xml), what the addresses serve. starts: (origin, node, place), where each origin's walk begins:
    what its robots file names, then the usual places. Of an origin, the first max_maps addresses in the order of
    the walk are asked, and the first max_urls URLs (None: all) taken, each where it comes first; denied ones don't count.
    """
    scratch = Scratch(maps.sparkSession, "sitemaps")
    children, urls = web.sitemap(F.col("xml"))
    parsed = scratch.table(maps.groupBy("url").agg(F.first("xml").alias("xml")).select("url", children.alias("children"), urls.alias("urls")), "parsed")
    edges = parsed.select(F.col("url").alias("source"), F.posexplode("children").alias("at", "target"))
    walk = scratch.table(breadth_first(edges, starts, scratch), "walk")
    asked = ranked(walk, ["origin"], ["depth", "order", "node"], scratch, "asked").filter(F.col("rank") <= max_maps)
    named = asked.join(parsed, F.col("node") == F.col("url")).select("origin", F.col("node").alias("map"), "depth", F.col("rank").alias("turn"), F.posexplode("urls").alias("at", "url"))
    named = named.filter(web.is_article(F.col("url"))).groupBy("origin", "url").agg(F.min(F.struct("turn", "at", "map", "depth")).alias("way"))
    rows = named.select("origin", "url", "way.*")
    if max_urls is None:
        return rows.select("origin", "url", "map", "depth")
    return ranked(rows, ["origin"], ["turn", "at"], scratch, "taken").filter(F.col("rank") <= max_urls).select("origin", "url", "map", "depth")


def robots_sitemaps(text: Column) -> Column:
    """The addresses that a robots file names as sitemaps, in order."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: F.lower(F.ltrim(x)).startswith("sitemap:"))
    return F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, "(?i)^[^:]*:", "")))
