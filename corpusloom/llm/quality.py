"""Quality by importance resampling.

Two generative models over hashed n-grams, of the target (texts labelled good) and of the raw corpus, give
each document the log of its importance weight: the sum over its n-grams of log p(target) - log p(raw). The
resample is drawn without replacement by Gumbel top-k: each weight gets its own Gumbel noise, and the k
largest sums stay. k is the number of documents whose weight passes the border that parts labelled good
from labelled bad texts best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, lean, slices

#: At most about so many labelled rows are learned from (by a hash of doc_id); they are broadcast.
LABELS = 20_000
#: Hash buckets of words and word pairs.
BUCKETS = 10_000
#: Buckets of their own, the last two, for a word that comes again at once and for one that comes again after the next token.
AGAIN = (BUCKETS - 2, BUCKETS - 1)
SEED = 11
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hasher(dict):
    """Tokens to 32-bit hashes, forgotten when they are many."""

    def __missing__(self, token: str) -> int:
        from xxhash import xxh32_intdigest

        if len(self) > 200_000:
            self.clear()
        self[token] = h = xxh32_intdigest(token.encode())
        return h


def buckets(text: str | None, hasher: Hasher) -> np.ndarray:
    """The buckets of a text's words, marks, pairs of them and repeated words, in lower case."""
    tokens = TOKEN.findall((text or "").lower())
    h = np.fromiter(map(hasher.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    found = (np.concatenate([h, pairs]) % np.uint64(AGAIN[0])).astype(np.int64)
    again = [np.full(np.count_nonzero(h[gap:] == h[:-gap]), b) for gap, b in zip((1, 2), AGAIN, strict=True)]
    return np.concatenate([found, *again])


def log_ratio(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket: raw over all docs (doc_id, text), target over those whose doc_id is in target (broadcast)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hasher = np.zeros((2, BUCKETS), np.int64), Hasher()
        for batch in slices(batches, "text"):
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
                own = np.bincount(buckets(text, hasher), minlength=BUCKETS)
                n[0] += own
                if good:
                    n[1] += own
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "raw": n[0], "target": n[1]})

    marked = docs.select("doc_id", "text").join(F.broadcast(target.select("doc_id").distinct().withColumn("good", F.lit(True))), "doc_id", "left")
    found = marked.select("text", "good").mapInArrow(lean(count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    n = np.ones((2, BUCKETS))
    for r in found:
        n[:, r.bucket] += r.raw, r.target
    share = np.log(n / n.sum(axis=1, keepdims=True))
    return share[1] - share[0]


def border(weights: list[tuple[float, int]]) -> float:
    """Between the weights of bad (0) and good (1) rows where the mean of both classes' accuracies is best: the middle of that gap."""
    rows = sorted(weights)
    w, good = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]) > 0
    if not len(rows) or good.all() or not good.any():
        return -np.inf
    below = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    above = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    at = int(np.argmax(below + above))
    return float(w[0] - 1 if at == 0 else w[-1] + 1 if at == len(w) else (w[at - 1] + w[at]) / 2)


def top_k_border(keys: DataFrame, k: int) -> float:
    """The k-th largest of keys (key double, no nulls), by ever finer histograms of which the driver gets one at a time."""
    low, high = keys.agg(F.min("key"), F.max("key")).head()
    left = k
    for _ in range(64):
        width = (high - low) / 4096
        inside = keys.filter(F.col("key").between(low, high))
        if width <= 0 or low + width == low:
            return low
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(4095))
        counts = sorted(inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), reverse=True)
        for r in counts:
            if left <= r.n:
                low, high = r.low, r.high
                break
            left -= r.n
        if r.n <= 10_000:
            return sorted((x.key for x in keys.filter(F.col("key").between(low, high)).select("key").collect()), reverse=True)[left - 1]
    return low


def resample(docs: DataFrame, labels: DataFrame, sample: int = LABELS) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, text_hash (xxhash64), log_weight, key (with Gumbel noise), kept.

    labels: (doc_id, quality: 1 good, 0 bad; null is no label); of repeated or contradicting labels the
    smallest counts. Null texts count as empty, with weight 0. Rows equal in doc_id and text get the same
    noise, so they stay or go together; rows that tie with the k-th key stay. Without labels of both
    classes nothing is rejected. Other columns of either table are not looked at; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, known.count()))
    known = scratch.table(known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20))), "labels")
    ratio = log_ratio(docs, known.filter("quality = 1"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, "text"):
            weights = [float(ratio[buckets(t, hasher)].sum()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "log_weight": pa.array(weights, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    scores = rows.mapInArrow(lean(score), "doc_id long, text_hash long, log_weight double")
    uniform = (F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scores = scratch.table(scores.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "scores")
    # One row a label, however often its doc_id stands in docs.
    labelled = scores.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("log_weight"), F.min("quality").alias("quality")).collect()
    least = border([(r.log_weight, r.quality) for r in labelled])
    n = scores.filter(F.col("log_weight") > least).count()
    cut = top_k_border(scores.select("key"), n) if n else np.inf
    return scores.withColumn("kept", F.col("key") >= float(cut))
