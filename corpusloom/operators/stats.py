"""Summaries, audits and budget arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNLABELLED = "UNLABELLED"


def corpus_summary(df: DataFrame) -> DataFrame:
    """documents, n_chars by provenance class (null: UNLABELLED)."""
    return df.groupBy(F.coalesce("provenance_class", F.lit(UNLABELLED)).alias("provenance_class")).agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))


def top_sources(df: DataFrame, n: int = 60) -> DataFrame:
    """The n sources with most documents, as class:source."""
    name = F.concat_ws(":", F.coalesce("provenance_class", F.lit(UNLABELLED)), F.coalesce("source", F.lit("?")))
    return df.groupBy(name.alias("source")).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "source").limit(n)


def reason_histogram(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "reason").agg(F.count("*").alias("documents"), F.sum("n_boilerplate").alias("boilerplate_lines"))


def audit(df: DataFrame) -> DataFrame:
    """documents, n_chars by class and source, by class, and by file (grouping sets; null stands for all)."""
    sets = [["provenance_class", "source"], ["provenance_class"], ["file"]]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], "provenance_class", "source", "file")
    return grouped.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("n_chars"))


def ceiling(manual_chars: Column, chars_per_token: float, fraction: float) -> dict[str, Column]:
    """What a manual share permits: manual tokens, downloaded tokens, and the total."""
    tokens = manual_chars / chars_per_token
    return {"manual_tokens": tokens, "downloaded_permitted": tokens * ((1 - fraction) / fraction), "ceiling": tokens * (1 + (1 - fraction) / fraction)}


def plan(urls: Column, hosts: Column, *, delay: float = 1.5, hours: float = 4, acceptance: float = 0.45, tokens_per_doc: float = 600, fraction: float = 0.20, target: float = 500e6) -> dict[str, Column]:
    """What crawling can yield: one page a host and delay, up to the URLs there are; and the corpus it supports."""
    fetchable = F.least(hosts / delay * hours * 3600, urls.cast("double"))
    manual = fetchable * acceptance * tokens_per_doc
    return {"fetchable": fetchable, "manual_tokens": manual, "max_total": manual / fraction, "short_of_target": F.greatest(F.lit(0.0), F.lit(target) - manual / fraction), "url_headroom": urls / F.nullif(manual / tokens_per_doc / acceptance, F.lit(0.0))}


def score_summary(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Scores by whole points (0 to 5), and their mean."""
    return scores.groupBy(*([by] if by else []), F.floor("score").cast("int").alias("points")).agg(F.count("*").alias("documents"), F.avg("score").alias("mean_score"))


def silent_hosts(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """Hosts that were asked and gave nothing."""
    return wanted.select("host").distinct().join(got.select("host"), "host", "left_anti")


def slow_hosts(delays: DataFrame, usual: float, top: int = 4) -> DataFrame:
    """The hosts (host, delay) that ask for more than twice the usual delay, slowest first."""
    return delays.filter(F.col("delay") > 2 * usual).orderBy(F.desc("delay"), "host").limit(top)
