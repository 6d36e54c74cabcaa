"""Quality scores: n-gram profiles, the heuristic rater, distillation to a linear model, thresholds."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE, dense, lines, words
from corpusloom.operators.budget import label_split
from corpusloom.operators.budget import sample as fixed_sample
from corpusloom.operators.gates import SYMBOL_WORD, ratio
from corpusloom.scratch import Scratch
from corpusloom.sources.records import exists

GRAM = 5


#: Distinct n-grams that a task holds before it hands their counts on.
HELD = 300_000
#: N-grams of documents that are handed on together, at most (and one document's): a batch of 10,000 texts has millions.
TOGETHER = 50_000
#: N-grams (with their counts) of texts that become vectors handed on together, at most (and one text's).
GRAMS_TOGETHER = 500_000
#: Words of a text whose n-grams are looked up together, at most.
WORDS_TOGETHER = 20_000
#: Bytes of a row group of vectors: a task that writes or reads them holds one.
ROW_GROUP_BYTES = 16 << 20
#: MB of vectors that the fit keeps together. What doesn't fit in memory goes to disk as objects, and Java holds the last 100 of them that a task writes or reads.
BLOCK_MB = 0.1
#: Whether Spark reads lists in Parquet files in batches of rows.
LISTS_IN_BATCHES = "spark.sql.parquet.enableNestedColumnVectorizedReader"
#: The most bytes of n-grams and counts that are broadcast, as they lie in memory; a row takes some 100 bytes beside its string.
BROADCAST_BYTES, ROW_BYTES = 256 << 20, 100
WHITE = re.compile(r"\s+")


def profile(df: DataFrame, n: int = GRAM) -> DataFrame:
    """gram, n over the texts of df (trusted ones), white space being single spaces: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def drain() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"])
            held.clear()
            return rows

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    flat = WHITE.sub(" ", text)
                    held.update([flat[i : i + n] for i in range(len(flat) - n + 1)])
                if len(held) > HELD:
                    yield drain()
        yield drain()

    return df.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _own_grams(head: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the n-grams of each text's head: doc_id, gram, times (a null gram for texts under 10 characters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            places, grams, times = [], [], []
            for place in range(batch.num_rows):
                text = texts[place].as_py()
                flat = WHITE.sub(" ", text)[:head] if text is not None else ""
                found = Counter([flat[i : i + GRAM] for i in range(len(flat) - GRAM + 1)]) if len(flat) >= 10 else {None: 0}
                places += [place] * len(found)
                grams += found.keys()
                times += found.values()
                if len(places) >= TOGETHER or place + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(places)), pa.array(grams, pa.string()), pa.array(times, pa.int64())], names=["doc_id", "gram", "times"])
                    places, grams, times = [], [], []

    return run


def log_probability(df: DataFrame, reference: DataFrame, head: int = 4000, bounded: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id and lp: the mean log-probability of the n-grams of a text's head under a profile; -20 under 10 characters, 0 without a profile.

    N-grams that the profile lacks count half an occurrence. A document's n-grams are counted in one pass, so each
    is looked up once a document, and a task holds no more than TOGETHER of them however large its batches are.
    The profile is written once and its bytes are measured: up to `bounded` it is broadcast, so that the n-grams
    of the documents aren't shuffled to it.
    """
    profile = Scratch(df.sparkSession, "profile").table(reference.select("gram", "n"), "grams")
    size, total = profile.agg(F.coalesce(F.sum(F.octet_length("gram") + ROW_BYTES), F.lit(0)), F.sum("n")).head()
    if not total:
        return df.select("doc_id", F.lit(0.0).alias("lp"))

    kind = dict(df.dtypes)["doc_id"]
    own = df.select("doc_id", "text").mapInArrow(_own_grams(head), f"doc_id {kind}, gram string, times long")
    met = own.join(F.broadcast(profile) if size <= bounded else profile, "gram", "left")
    log = F.col("times") * F.log(F.coalesce("n", F.lit(0.5)) / F.lit(total))
    lp = met.groupBy("doc_id").agg(F.sum("times").alias("times"), F.sum(log).alias("log"))
    return lp.select("doc_id", F.when(F.col("times") == 0, -20.0).otherwise(F.col("log") / F.col("times")).alias("lp"))


def score_all(df: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """doc_id, provenance_class and score (heuristic, two decimals) of tidied documents; with a profile, distance to it counts too."""
    rows = df.select("doc_id", "provenance_class", "text", words(F.col("text")).alias("ws"))
    if reference is None:
        return rows.select("doc_id", "provenance_class", heuristic_score(F.col("text"), F.col("ws")).alias("score"))
    # What else the score needs is a few numbers, so no text is joined.
    parts = rows.select("doc_id", "provenance_class", heuristic_parts(F.col("text"), F.col("ws")).alias("p"))
    lp = log_probability(df, reference)
    return parts.join(lp, "doc_id").select("doc_id", "provenance_class", rounded_score(F.col("p.n"), F.col("p.score"), F.col("lp")).alias("score"))


def rounded_score(n: Column, score: Column, lp: Column | None) -> Column:
    if lp is not None:
        score = score - 2.0 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (-lp - 8.0) / 5.0))
    return F.when(n < 20, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(5.0), score)), 2))


def heuristic_parts(text: Column, ws: Column) -> Column:
    """n (words) and score (before the profile counts, unclamped) of a tidied text and its words."""
    ls = F.filter(lines(text), lambda x: F.btrim(x) != "")
    n = F.size(ws)
    unique = ratio(F.size(F.array_distinct(ws)), n)
    dup = F.coalesce(1 - ratio(F.size(F.array_distinct(ls)), F.size(ls)), F.lit(0.0))
    mean = ratio(F.length(dense(text)), n)
    symbols = ratio(F.when(text.rlike(SYMBOL_WORD), F.size(F.filter(ws, lambda w: w.rlike(SYMBOL_WORD)))).otherwise(0), n)
    score = F.lit(5.0) - F.when(unique < 0.30, 2.0).when(unique < 0.45, 1.0).otherwise(0.0)
    score = score - 2.0 * F.least(F.lit(1.0), dup / 0.3) - F.when(mean.between(2.0, 12.0), 0.0).otherwise(1.5)
    return F.struct(n.alias("n"), (score - 2.0 * F.least(F.lit(1.0), symbols / 0.10)).alias("score"))


def heuristic_score(text: Column, ws: Column, lp: Column | None = None) -> Column:
    """0 to 5, from a tidied text and its words: words that repeat, lines that repeat, odd word lengths, symbols, and distance to a profile take points off."""
    parts = heuristic_parts(text, ws)
    return rounded_score(parts["n"], parts["score"], lp)


class Scorer(Protocol):
    """What rates texts in batches: a score from 0 to 5, or None."""

    def score_batch(self, texts: list[str]) -> list[float | None]: ...


def parse_rating(answer: Column) -> Column:
    """The first digit 0 to 5 of a rater's answer, or null."""
    return F.nullif(F.regexp_extract(answer, "[0-5]", 0), F.lit("")).cast("double")


RATING_PROMPT = "Rate the passage below for a language-model training corpus from 0 (unusable) to 5 (clean, coherent prose). Answer with one digit.\n\nLanguage: {language}\nPassage:\n{text}\n\nRating:"


def rating_prompt(text: Column, language: str, head: int = 2400) -> Column:
    before, after = RATING_PROMPT.replace("{language}", language).split("{text}")
    return F.concat(F.lit(before), F.substring(F.btrim(text), 1, head), F.lit(after))


def score_with(df: DataFrame, make: Callable[[], Scorer], done: DataFrame | None = None, batch: int = 8) -> DataFrame:
    """doc_id and score by a scorer made once in each task, without the doc_ids that done has. A batch that fails is scored null."""
    todo = df.select("doc_id", "text") if done is None else df.select("doc_id", "text").join(done.select("doc_id"), "doc_id", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for part in parts:
            scores: list[float | None] = []
            for at in range(0, len(part), batch):
                texts = part["text"].iloc[at : at + batch].tolist()
                try:
                    scores += scorer.score_batch(texts)
                except Exception:
                    scores += [None] * len(texts)
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": pd.array(scores, dtype="Float64")})

    return todo.mapInPandas(run, f"doc_id {dict(df.dtypes)['doc_id']}, score double")


class TooSlow(RuntimeError):
    """A scorer would take longer than it may."""


def rate(df: DataFrame, make: Callable[[], Scorer], to: str, sample: int = 30_000, max_hours: float = 6.0, trial: int = 64, chunk: int = 5000, batch: int = 8) -> DataFrame:
    """Append scores of a sample of df (doc_id, text) to the Parquet table `to`, without the doc_ids that it has; what the table has then.

    The sample is the same in every run, so a run that was stopped goes on where it was. The first `trial`
    documents tell how long the rest would take; above max_hours nothing more is rated (TooSlow). The rest
    comes in chunks, each of which is written whole or not at all; a batch that fails is scored null, and is
    asked again by the next run.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "rate")
    schema = f"doc_id {dict(df.dtypes)['doc_id']}, score double"

    def known() -> DataFrame:
        return spark.read.schema(schema).parquet(to).filter("score IS NOT NULL") if exists(spark, to) else spark.createDataFrame([], schema)

    todo = fixed_sample(df.select("doc_id", "text"), sample).join(known().select("doc_id"), "doc_id", "left_anti")
    todo = scratch.table(todo, "todo")
    n = todo.count()
    parts = -(-max(0, n - trial) // chunk)
    first = scratch.table(fixed_sample(todo, trial).select("doc_id"), "trial")
    rest = todo.join(first, "doc_id", "left_anti").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, parts))))
    began = time.monotonic()
    score_with(todo.join(first, "doc_id", "left_semi"), make, batch=batch).write.mode("append").parquet(to)
    hours = (time.monotonic() - began) / 3600 * max(0, n - trial) / max(1, min(trial, n))
    if hours > max_hours:
        raise TooSlow(f"{n - trial} documents would take {hours:.1f} hours, above {max_hours}")
    for k in range(parts):
        score_with(rest.filter(F.col("part") == k).drop("part"), make, batch=batch).write.mode("append").parquet(to)
    return known()


def word_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within words, each word between spaces."""
    ws = F.transform(F.filter(F.split(F.lower(text), f"[{SPACE}]+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        return F.flatten(F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def gram_vocabulary(df: DataFrame, most: int) -> list[str]:
    """The most frequent n-grams (word_grams) of df (text) that two rows or more have, the first of equals.

    A word's n-grams are made once, not wherever it stands: words are counted first, with the least and the
    greatest row that has each, and an n-gram is in two rows if these differ over its words.
    """
    # Rows get their numbers in a step of their own: beside a generator, Spark numbers what that makes.
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.lower("text").alias("text"))
    texts = rows.select("row", F.explode(F.split("text", f"[{SPACE}]+")).alias("word"))
    found = [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")]
    words_ = texts.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))
    grams = words_.select(F.explode(word_grams(F.col("word"))).alias("gram"), "n", "first", "last").groupBy("gram").agg(*found)
    return [r.gram for r in grams.filter("first < last").orderBy(F.desc("n"), "gram").limit(most).select("gram").collect()]


def _counted(vocabulary: list[str]) -> Callable[[str | None], tuple[np.ndarray, np.ndarray]]:
    """What tells the places in a vocabulary of a lower-case text's n-grams (word_grams), ascending, and how often each is there.

    All places of a text are looked up together, a character of the n-grams at a time: what begins an n-gram
    of the vocabulary has a number, which makes a key with the next character.
    """
    letters = np.unique(np.frombuffer("".join(vocabulary).encode("utf-32-le"), np.uint32))
    code = np.zeros(0x110000, np.int64)
    code[letters] = np.arange(1, len(letters) + 1)
    base, place = len(letters) + 1, {g: i for i, g in enumerate(vocabulary)}
    first = {chr(c): int(code[c]) for c in letters}
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    number = first
    for n in range(2, max(map(len, vocabulary), default=1) + 1):
        begins = {g[:n] for g in vocabulary if len(g) >= n}
        keyed = sorted((number[g[:-1]] * base + first[g[-1]], g) for g in begins)
        number = {g: i for i, (_, g) in enumerate(keyed)}
        levels.append((np.array([k for k, _ in keyed], np.int64), np.array([place.get(g, -1) for _, g in keyed], np.int32)))

    def found(words_: list[str]) -> Iterator[np.ndarray]:
        flat = np.frombuffer(f" {'  '.join(words_)} ".encode("utf-32-le"), np.uint32)
        at, chars, space = np.arange(len(flat)), code[flat], flat == 32
        apart = np.append(space[:-1] & space[1:], True)  # no n-gram goes on after this place
        numbers = chars
        for n, (keys, places) in enumerate(levels, 2):
            on = ~apart[at + n - 2]
            at = at[on]
            wanted = numbers[on] * base + chars[at + n - 1]
            numbers = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            known = keys[numbers] == wanted
            at, numbers = at[known], numbers[known]
            yield places[numbers]
            if n == 3:  # a word of one character is its only n-gram of 3 and of 4
                yield places[numbers[space[at] & space[at + 2]]]

    def count(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words_ = (text or "").split()
        each = [x[x >= 0] for k in range(0, len(words_), WORDS_TOGETHER) for x in found(words_[k : k + WORDS_TOGETHER])]
        at, times = np.unique(np.concatenate(each) if each else np.empty(0, np.int32), return_counts=True)
        return at, times.astype(np.float64)

    return count


def gram_counts(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """df with indices and counts of the n-grams of its texts that a vocabulary has, in place of text; a task hands on few rows' together."""
    others = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counted(vocabulary)
        for batch in batches:
            texts, start, held, size = batch.column("text"), 0, [], 0
            for k in range(batch.num_rows):
                held.append(count(texts[k].as_py()))
                size += len(held[-1][0])
                if size >= GRAMS_TOGETHER or k + 1 == batch.num_rows:
                    ends = pa.array(np.cumsum([0, *(len(x) for x, _ in held)], dtype=np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in held]))) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, k + 1 - start) for c in others), *lists], names=[*others, "indices", "counts"])
                    start, held, size = k + 1, [], 0

    kinds = dict(df.dtypes)
    rows = df.select(*others, F.lower("text").alias("text"))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "indices array<int>, counts array<double>"]))


def linear_scores(df: DataFrame, vocabulary: list[str], weights: np.ndarray, coefficients: np.ndarray, intercept: float) -> DataFrame:
    """doc_id and prediction of df (doc_id, text) by a linear model of weighted n-grams of length 1. No vector leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counted(vocabulary)

        def score(text: str | None) -> float:
            at, times = count(text)
            x = (1 + np.log(times)) * weights[at]
            length = np.sqrt(x @ x)
            return float(x @ coefficients[at] / length + intercept) if length > 0 else intercept

        for batch in batches:
            scores = [score(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "prediction"])

    return df.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, prediction double")


@contextmanager
def read_by_rows(spark: SparkSession) -> Iterator[None]:
    """Lists in Parquet files are read a row at a time within: Spark else holds those of 4,096 rows in a task, however long they are."""
    before = spark.conf.get(LISTS_IN_BATCHES, None)
    spark.conf.set(LISTS_IN_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.unset(LISTS_IN_BATCHES) if before is None else spark.conf.set(LISTS_IN_BATCHES, before)


def distil(labelled: DataFrame, docs: DataFrame, least: int = 200, vocabulary: int = 120_000, alpha: float = 1.0) -> tuple[DataFrame, dict]:
    """doc_id and quality_score of docs, by ridge regression on weighted n-grams of labelled (doc_id, text, score); and how it does on held-out labels.

    Counts enter as 1 + log, weighted by inverse document frequency and normalised. Only labelled texts become
    vectors in a table (the fit reads its rows many times), which is written in small row groups and read a row
    at a time, so a task's memory is that of a few rows; so are the blocks that the fit keeps.
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import IDF, Normalizer
    from pyspark.ml.linalg import VectorUDT
    from pyspark.ml.regression import LinearRegression
    from pyspark.sql.types import StructField, StructType

    n = labelled.count()
    if n < least:
        raise ValueError(f"{n} labelled documents; {least} are needed")

    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "distil")
    split = labelled.select("text", label_split(F.col("doc_id")).alias("part"), F.col("score").cast("double").alias("label"))
    known = gram_vocabulary(split.filter("part = 'train'"), vocabulary)
    if not known:
        raise ValueError("no n-gram is in two labelled documents")

    damped = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(len(known)).alias("size"), "indices", F.transform("counts", lambda x: 1 + F.log(x)).alias("values"))
    plain = scratch.table(gram_counts(split, known).select("part", "label", damped.alias("damped")), "labelled", **{"parquet.block.size": str(ROW_GROUP_BYTES)})
    # A vector is stored as such a struct, so the table can be read as one of vectors.
    schema = StructType([StructField(f.name, VectorUDT() if f.name == "damped" else f.dataType) for f in plain.schema])
    with read_by_rows(spark):
        rows = spark.read.schema(schema).parquet(f"{scratch.path}/labelled")
        idf = IDF(inputCol="damped", outputCol="weighted").fit(rows.filter("part = 'train'"))
        rows = Normalizer(inputCol="weighted", outputCol="features").transform(idf.transform(rows)).select("label", "part", "features")
        fitted = rows.filter("part = 'train'")
        model = LinearRegression(regParam=alpha / max(1, fitted.count()), elasticNetParam=0.0, standardization=False, solver="l-bfgs", maxIter=50, maxBlockSizeInMB=BLOCK_MB).fit(fitted)
        held = model.transform(rows.filter("part = 'test'"))
        mae = RegressionEvaluator(metricName="mae").evaluate(held)
        r = held.agg(pearson(F.col("prediction"), F.col("label"))).head()[0]
    scratch.drop("labelled")
    scored = linear_scores(docs, known, idf.idf.toArray(), model.coefficients.toArray(), model.intercept)
    return scored.select("doc_id", F.round("prediction", 3).alias("quality_score")), {"mae": mae, "pearson_r": r, "labels": n}


def pearson(x: Column, y: Column) -> Column:
    """The correlation of two columns; null where one of them doesn't vary (as few held-out labels may not)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def apply_threshold(docs: DataFrame, scores: DataFrame, least: float = 2.5) -> DataFrame:
    """docs with quality_score that reach the threshold; those without a score stay."""
    return docs.join(scores.select("doc_id", "quality_score"), "doc_id", "left").filter(F.coalesce(F.col("quality_score") >= least, F.lit(True)))


def is_byte_piece(piece: str) -> bool:
    return bool(re.fullmatch(r"<0x..>", piece))
