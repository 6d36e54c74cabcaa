"""Token counts and tokenizer measures. Tokens are whitespace words here; `pieces` encodes with a given vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DOWNLOADED_NAMES, MANUAL_NAMES
from corpusloom.functions.text import words


def classify(value: Column) -> Column:
    """The provenance class a free value means; others pass in lower case, none is unlabelled."""
    v = F.lower(F.btrim(value))
    return F.when(F.coalesce(value, F.lit("")) == "", "unlabelled").when(v.isin(*MANUAL_NAMES), "manual").when(v.isin(*DOWNLOADED_NAMES), "downloaded").otherwise(v)


def totals(df: DataFrame, tokens: Column, by: list[str]) -> DataFrame:
    """documents, n_tokens, n_chars, n_bytes by the given columns."""
    return df.withColumn("_n", tokens).groupBy(*by).agg(F.count("*").alias("documents"), F.sum("_n").alias("n_tokens"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("text")).alias("n_bytes"))


def rollup(df: DataFrame, tokens: Column) -> DataFrame:
    """totals by split and class, by split, and over all (null stands for all)."""
    return df.withColumn("_n", tokens).rollup("split", "provenance_class").agg(F.count("*").alias("documents"), F.sum("_n").alias("n_tokens"), F.sum(F.length("text")).alias("n_chars"))


def requirements(counted: DataFrame, target: int, min_fraction: float = 0.20) -> DataFrame:
    """One row of verdicts over (provenance_class, documents, n_tokens): fractions, shortfall, and what fails or should be noted."""
    share = lambda c, n: F.sum(F.when(F.col("provenance_class") == c, F.col(n)).otherwise(0))
    one = counted.agg(share("manual", "n_tokens").alias("manual"), share("unlabelled", "n_tokens").alias("unlabelled"), share("manual", "documents").alias("manual_docs"), F.sum("n_tokens").alias("tokens"), F.sum("documents").alias("docs"))
    one = one.withColumn("manual_fraction", F.try_divide("manual", "tokens")).withColumn("manual_doc_fraction", F.try_divide("manual_docs", "docs"))
    return one.select(
        "tokens", "manual_fraction", "manual_doc_fraction",
        F.greatest(F.lit(0), F.lit(target) - F.col("tokens")).alias("shortfall"),
        (F.col("unlabelled") > 0).alias("fails_unlabelled"),
        (F.col("manual_fraction") < min_fraction).alias("fails_fraction"),
        (F.abs(F.col("manual_fraction") - F.col("manual_doc_fraction")) > 0.05).alias("notes_divergence"),
        (F.col("tokens") < target).alias("notes_shortfall"),
    )


def frequency(df: DataFrame, tokens: Column | None = None) -> DataFrame:
    """token, n of the words of df (or of an array column)."""
    return df.select(F.explode(words(F.col("text")) if tokens is None else tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def ranked(freq: DataFrame, top: int | None = None) -> DataFrame:
    """rank, token, n, most frequent first, ties by token. With top, only so many (a top-n, not a full sort)."""
    if top is not None:
        freq = freq.orderBy(F.desc("n"), "token").limit(top)
    return freq.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))


def vocabulary_use(freq: DataFrame) -> DataFrame:
    """One row: distinct tokens, those seen once, all tokens."""
    return freq.agg(F.count("*").alias("distinct_tokens"), F.count_if(F.col("n") == 1).alias("hapax"), F.sum("n").alias("tokens"))


def coverage(freq: DataFrame, sizes: tuple[int, ...] = (100, 1000, 10000)) -> DataFrame:
    """One row: the tokens that the most frequent k cover, and all."""
    top = ranked(freq, max(sizes))
    return top.agg(*(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)).alias(f"top_{k}") for k in sizes)).crossJoin(F.broadcast(freq.agg(F.sum("n").alias("tokens"))))


def zipf_slope(freq: DataFrame, top: int = 5000, least: int = 10) -> DataFrame:
    """One row: the least-squares slope of log n on log rank over the first ranks; null under 10 points."""
    points = ranked(freq, top).select(F.log(F.col("rank").cast("double")).alias("x"), F.log(F.col("n").cast("double")).alias("y"))
    return points.agg(F.when(F.count("*") >= least, F.regr_slope("y", "x")).alias("zipf_slope"))


def length_histogram(freq: DataFrame, top: int = 20) -> DataFrame:
    """Tokens by length, the shortest lengths."""
    return freq.groupBy(F.length("token").alias("length")).agg(F.sum("n").alias("n")).orderBy("length").limit(top)


def efficiency(df: DataFrame, tokens: Column, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """fertility, chars and bytes per token, tokens per document; of groups with enough documents."""
    rows = df.select(*(by or []), tokens.alias("t"), F.size(words(F.col("text"))).alias("w"), F.length("text").alias("c"), F.octet_length("text").alias("b")).filter("w > 0")
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("documents"), F.sum("t").alias("tokens"), (F.sum("t") / F.sum("w")).alias("fertility"), F.try_divide(F.sum("c"), F.sum("t")).alias("chars_per_token"), F.try_divide(F.sum("b"), F.sum("t")).alias("bytes_per_token"), (F.sum("t") / F.count("*")).alias("tokens_per_document"))
    return out.filter(F.col("documents") >= least)


def ladder(freq: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """vocab_size and fertility, were the most frequent words single tokens and all others spelled out."""
    top = ranked(freq, max(sizes)).select("rank", "n", F.length("token").alias("len"))
    saved = top.agg(*(F.sum(F.when(F.col("rank") <= k, F.col("n") * (F.col("len") - 1)).otherwise(0)).alias(f"s{k}") for k in sizes))
    whole = freq.agg(F.sum(F.col("n") * F.length("token")).alias("spelled"), F.sum("n").alias("words"))
    one = saved.crossJoin(F.broadcast(whole))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("vocab_size"), ((F.col("spelled") - F.col(f"s{k}")) / F.col("words")).alias("fertility")) for k in sizes))))


def elbow(metrics: DataFrame, least_gain: float = 0.02, max_byte_fallback: float = 0.01, max_unknown: float = 0.001) -> DataFrame:
    """metrics (model_type, vocab_size, fertility, byte_fallback_rate, unk_rate) with gain over the next smaller size and selected.

    Of a type's sizes that meet both limits, the first whose next one gains less than least_gain is selected,
    else the largest. If none meets them, the best by the two rates.
    """
    w = Window.partitionBy("model_type").orderBy("vocab_size")
    rows = metrics.withColumn("gain", (F.lag("fertility").over(w) - F.col("fertility")) / F.nullif(F.lag("fertility").over(w), F.lit(0.0)))
    good = F.coalesce((F.col("byte_fallback_rate") <= max_byte_fallback) & (F.col("unk_rate") <= max_unknown), F.lit(False))
    f = Window.partitionBy("model_type", "_good").orderBy("vocab_size")
    rows = rows.withColumn("_good", good).withColumn("_next", F.lead("fertility").over(f))
    gain_next = (F.col("fertility") - F.col("_next")) / F.nullif(F.col("fertility"), F.lit(0.0))
    stop = F.col("_good") & (F.col("_next").isNull() | F.coalesce(gain_next < least_gain, F.lit(False)))
    every = Window.partitionBy("model_type")
    first = F.min(F.when(stop, F.col("vocab_size"))).over(every)
    worst = F.min(F.struct("byte_fallback_rate", "unk_rate", "vocab_size")).over(every)["vocab_size"]
    chosen = F.when(F.max("_good").over(every), first).otherwise(worst)
    return rows.withColumn("selected", F.col("vocab_size") == chosen).drop("_good", "_next")


def scaling_law_vocab(parameters: Column, width: Column) -> Column:
    """The vocabulary k * parameters**0.83 / width, k set so that 65e9 parameters of width 8192 get 216,000."""
    k = 216_000 * 8192 / math.pow(65e9, 0.83)
    least = lambda c: F.greatest(F.lit(1), c).cast("double")
    return F.floor(F.lit(k) * F.pow(least(parameters), F.lit(0.83)) / least(width)).cast("long")


def drift(measured: Column, used: Column, most: float = 0.05) -> Column:
    """Whether measured characters per token are off what budgets were sized with."""
    return F.abs(F.coalesce(measured, F.lit(0.0)) - used) > most


def training_lines(df: DataFrame) -> DataFrame:
    """line: the non-empty trimmed lines of texts, as training input for a tokenizer."""
    return df.select(F.explode(F.split("text", "\n")).alias("line")).select(F.btrim("line").alias("line")).filter("line <> ''")


def named(freq: DataFrame, vocab: DataFrame) -> DataFrame:
    """freq (token: an id, n, ...) with each id's piece and whether it is a byte; the vocabulary is broadcast (it is bounded by the model)."""
    return freq.join(F.broadcast(vocab.select(F.col("id").alias("token"), "piece", "is_byte")), "token")


def piece_lengths(freq: DataFrame, vocab: DataFrame, top: int = 20) -> DataFrame:
    """length, n: tokens by the characters of their pieces without word marks, the shortest lengths."""
    bare = F.length(F.replace("piece", F.lit("\u2581"), F.lit("")))
    return named(freq, vocab).groupBy(bare.alias("length")).agg(F.sum("n").alias("n")).orderBy("length").limit(top)


def not_nfc(df: DataFrame) -> DataFrame:
    """One row: documents, and how many of their texts are not in NFC."""

    @F.pandas_udf("boolean")
    def odd(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        for s in parts:
            yield pd.Series([t is not None and not unicodedata.is_normalized("NFC", t) for t in s], dtype="bool")

    return df.select(odd("text").alias("odd")).agg(F.count("*").alias("documents"), F.count_if("odd").alias("not_nfc"))


def choose(metrics: DataFrame, forced: int | None = None, reason: str | None = None) -> DataFrame:
    """One row of a sweep's metrics (vocab_size, model_type, fertility, selected, ...): the selected size or, with a reason, a forced one that was swept; of several types the one of least fertility."""
    sizes = {r.vocab_size for r in metrics.select("vocab_size").distinct().collect()}
    if forced is not None and forced not in sizes:
        raise ValueError(f"{forced} was not swept; there are {sorted(sizes)}")
    rows = metrics.filter(F.col("vocab_size") == forced if forced is not None else F.col("selected"))
    why = F.lit(f"forced: {reason or 'on grounds of the parameter budget'}" if forced is not None else "elbow")
    return rows.orderBy("fertility", "vocab_size", "model_type").limit(1).withColumn("reason", why)
