"""Checks of a finished corpus: (name, violations), all passed when every count is 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


def in_two_splits(df: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split, and in how many."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def unlabelled(df: DataFrame) -> DataFrame:
    """Rows by provenance class that is neither manual nor downloaded (null: MISSING)."""
    cls = F.coalesce("provenance_class", F.lit("MISSING"))
    return df.groupBy(cls.alias("provenance_class")).agg(F.count("*").alias("n")).filter(~F.col("provenance_class").isin("manual", "downloaded"))


def cross_checks(docs: DataFrame, other: DataFrame) -> DataFrame:
    """name, violations, passed: ids and contents that two languages' corpora (doc_id, text) share."""
    a, b = (df.select("doc_id", content_hash(F.col("text")).alias("content")) for df in (docs, other))
    parts = [_count(a.select(c).filter(F.col(c).isNotNull()).intersect(b.select(c)), f"no {c} in both languages") for c in ("doc_id", "content")]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)


def lineage_check(spark: SparkSession, models: list[str], allowed: tuple[str, ...] = ("train",)) -> DataFrame:
    """name, violations, passed of each model: how many other splits than the allowed ones were among the files that were read for it (see sinks.write_model)."""
    rows = reduce(DataFrame.unionByName, (spark.read.parquet(f"{m}_lineage") for m in models))
    other = F.array_except("splits", F.array(*map(F.lit, allowed)))
    return rows.select("name", F.size(other).cast("long").alias("violations"), (F.size(other) == 0).alias("passed"))


def checks(docs: DataFrame, other: DataFrame | None = None, tokens: DataFrame | None = None, min_fraction: float = 0.20, models: list[str] | None = None) -> DataFrame:
    """name, violations, passed. docs: (doc_id, text, provenance_class, split); other: another language's; tokens: (provenance_class, n_tokens)."""
    docs = docs.withColumn("content", content_hash(F.col("text")))
    parts = [
        _count(in_two_splits(docs, "doc_id"), "no doc_id in two splits"),
        _count(in_two_splits(docs, "content"), "no content in two splits"),
        _count(unlabelled(docs), "provenance is manual or downloaded"),
    ]
    if tokens is not None:
        manual = F.sum(F.when(F.col("provenance_class") == "manual", F.col("n_tokens")).otherwise(0))
        short = F.coalesce(manual / F.nullif(F.sum("n_tokens"), F.lit(0)), F.lit(0.0)) < min_fraction
        parts.append(tokens.agg(short.cast("long").alias("violations")).select(F.lit("manual share of tokens").alias("name"), "violations"))
    found = reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)
    if other is not None:
        found = found.unionByName(cross_checks(docs, other))
    return found if models is None else found.unionByName(lineage_check(docs.sparkSession, models))
