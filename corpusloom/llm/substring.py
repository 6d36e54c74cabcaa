"""Substring dedup: words in passages that occur more than once, by compacted De Bruijn paths.

The graph's edges are the windows of 35 consecutive words (its token k-mers); an edge follows another where a
text goes on by one word. What repeats in it is found in four steps, of which three are joins:

1. Edges to paths. Windows that follow each other and agree on the 8-word minimizer with the smallest hash
   among their own are one path, known by that minimizer: windows of equal words agree on it and on its
   place, wherever they stand. A text of n words becomes about n / 15 path rows instead of n edge rows.
   Paths are counted by minimizer, with the smallest and the largest hash of their words. A minimizer seen
   once holds no repeated edge. Where all its paths are equal, its edges all repeat; where they differ, the
   edges themselves are the rows: the path is branching, and its windows are hashed and counted.
2. Compaction. Of the repeated paths and edges, as (source, place) coordinates, it is counted what follows each
   in its text. A path that is always followed by one and the same, which always follows it, is not branching
   there: a join of both finds these links, and a second one takes them back to the coordinates, where linked
   paths are one.
3. Verification. Every occurrence of a compacted path is cut out of its source at its coordinates, and the
   words are compared as bytes, once for each path. Hashes only propose: a path whose occurrences differ is
   resolved by the words of its windows.
4. The coordinates are joined to the texts, where they merge to spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, hot_keys, keyed_join, lean, slices

WINDOW, KMER = 35, 8
#: Odd bases of the polynomials over word hashes, modulo 2**64.
KMER_BASE, PATH_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (a bijection)."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts in a row, with where each text begins. Of word hashes only `bits` bits count."""

    def __init__(self, texts: list[str | None], bits: int = 64):
        from xxhash import xxh64_intdigest

        split = [(t or "").encode().split() for t in texts]
        self.begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        n = int(self.begin[-1])
        self.hash = np.fromiter((xxh64_intdigest(w) for words in split for w in words), np.uint64, n)
        if bits < 64:
            self.hash &= np.uint64((1 << bits) - 1)
        self.of = np.repeat(np.arange(len(split)), np.diff(self.begin))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hash ^ np.uint64(0x5BD1E995)) * powers(PATH_BASE, n), dtype=np.uint64)])
        self.inverse = powers(pow(PATH_BASE, -1, 1 << 64), n + 1)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of words: of their content and length, not of where they stand."""
        return mix((self.prefix[end] - self.prefix[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def windows(self, size: int = WINDOW, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window within one text: its start, the place of its k-mer, and that k-mer's hash."""
        n = len(self.hash)
        if n < size:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        kmer = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            kmer = kmer * np.uint64(KMER_BASE) + self.hash[j : n - k + 1 + j]
        kmer = mix(kmer)
        start = np.nonzero(self.of[: n - size + 1] == self.of[size - 1 :])[0]
        least = np.lib.stride_tricks.sliding_window_view(kmer, size - k + 1)
        place = np.concatenate([start[a : a + 65536] + least[start[a : a + 65536]].argmin(axis=1) for a in range(0, len(start), 65536)] or [start])
        return start, place, kmer[place]


def paths(docs: DataFrame, size: int = WINDOW, k: int = KMER, bits: int = 64) -> DataFrame:
    """The paths of docs (id, text): id, first (word of the first window), n (windows), kmer, path (hash of the words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text").to_pylist(), bits)
            start, place, kmer = words.windows(size, k)
            if not len(start):
                continue
            cut = np.nonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))[0]
            n = np.diff(np.concatenate([cut, [len(start)]]))
            first, of = start[cut], words.of[start[cut]]
            path = words.hashes(first, first + n + size - 1)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(of)), "first": (first - words.begin[of]).astype(np.int32), "n": n.astype(np.int32), "kmer": kmer[cut].view(np.int64), "path": path.view(np.int64)})

    return docs.select("id", "text").mapInArrow(lean(run), "id long, first int, n int, kmer long, path long")


def repeated_edges(docs: DataFrame, scratch: Scratch, size: int, k: int, bits: int) -> DataFrame:
    """id, first, n, key: the paths whose edges all repeat, and the single repeated edges of the others, at every coordinate; equal keys have equal words unless hashes fail."""
    found = scratch.table(paths(docs, size, k, bits), "paths")
    counts = found.groupBy("kmer").agg(F.count("*").alias("times"), F.min("path").alias("low"), F.max("path").alias("high"))
    again = scratch.table(counts.filter("times > 1").select("kmer", "times", (F.col("low") == F.col("high")).alias("whole")), "repeated")
    hot = hot_keys(again.select("kmer", F.col("times").alias("n")), again.agg(F.coalesce(F.sum("times"), F.lit(0))).head()[0], scratch, "hot-kmers")
    met = scratch.table(keyed_join(found, again.select("kmer", "whole"), "kmer", hot).select("id", "first", "n", "path", "whole"), "met")
    scratch.drop("paths")
    branching = met.filter("not whole").groupBy("id").agg(F.collect_list(F.struct("first", "n")).alias("runs"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text").to_pylist(), bits)
            start, _, kmer = words.windows(size, k)
            if not len(start):
                continue
            wanted = np.zeros(len(words.hash) + 1, np.int64)
            for b, runs in zip(words.begin.tolist(), batch.column("runs").to_pylist(), strict=False):
                for r in runs:
                    wanted[b + r["first"]] += 1
                    wanted[b + r["first"] + r["n"]] -= 1
            pick = np.cumsum(wanted)[start] > 0
            start, kmer = start[pick], kmer[pick]
            of = words.of[start]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(of)), "first": (start - words.begin[of]).astype(np.int32), "kmer": kmer.view(np.int64), "own": words.hashes(start, start + size).view(np.int64)})

    edges = docs.select("id", "text").join(branching, "id").mapInArrow(lean(windows), "id long, first int, kmer long, own long")
    edges = scratch.table(edges, "edges")
    twice = edges.groupBy("kmer", "own").agg(F.count("*").alias("n")).filter("n > 1")
    twice = scratch.table(twice, "edges-repeated")
    hot = hot_keys(twice, twice.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0], scratch, "hot-edges")
    edge_keys = F.struct("kmer", "own")
    single = keyed_join(edges.select("id", "first", edge_keys.alias("edge")), twice.select(edge_keys.alias("edge")), "edge", hot and hot.select(edge_keys.alias("edge"), "copies"))
    single = single.select("id", "first", F.lit(1).alias("n"), F.xxhash64("edge.kmer", "edge.own").alias("key"))
    whole = met.filter("whole").select("id", "first", "n", F.xxhash64("path", "n").alias("key"))
    runs = scratch.table(whole.union(single), "runs")
    for name in ("met", "edges"):
        scratch.drop(name)
    return runs


def compacted(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, first, n, head: every occurrence of every compacted path, n windows from word `first` on; head is its first key.

    A link joins two keys that follow each other wherever either of them stands: one join of the keys with what
    always follows them. So a chain of links stands whole wherever one of its keys does, and once the joins have
    brought the links back to the coordinates, it is the run of linked rows there.
    """
    order = Window.partitionBy("id").orderBy("first")
    end = F.col("first") + F.col("n")
    following = F.when(F.lead("first").over(order) == end, F.lead("key").over(order))
    before = F.when(F.lag(end).over(order) == F.col("first"), F.lag("key").over(order))
    met = runs.select("key", following.alias("next"), before.alias("prev")).groupBy("key")
    met = met.agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in ("next", "prev") for name, f in (("n", F.count), ("low", F.min), ("high", F.max))))
    keys = scratch.table(met, "keys")
    always = {c: keys.filter(f"n_{c} = n AND low_{c} = high_{c}") for c in ("next", "prev")}
    ahead = always["next"].select(F.col("key").alias("of"), F.col("low_next").alias("key"))
    back = always["prev"].select("key", F.col("low_prev").alias("of"))
    linked = scratch.table(ahead.join(back, ["key", "of"]).filter("key <> of").select("key", F.lit(True).alias("linked")), "linked")
    hot = hot_keys(keys.select("key", "n"), runs.count(), scratch, "hot-runs")
    at = keyed_join(runs, linked, "key", hot, "left").withColumn("part", F.count_if(F.col("linked").isNull()).over(order))
    return at.groupBy("id", "part").agg(F.min("first").alias("first"), F.sum("n").cast("int").alias("n"), F.min_by("key", "first").alias("head")).drop("part")


def disagreeing(marked: DataFrame, size: int, scratch: Scratch) -> DataFrame | None:
    """head of the paths whose words differ between their occurrences in marked (text, spans); None if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            heads, cut = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                for s in spans:
                    heads.append(s["head"])
                    cut.append(b" ".join(words[s["first"] : s["first"] + s["n"] + size - 1]))
            # Copies within a batch needn't leave it.
            both = pa.table({"head": pa.array(heads, pa.int64()), "words": pa.array(cut, pa.large_binary())})
            for part in both.group_by(["head", "words"]).aggregate([]).to_batches():
                yield pa.RecordBatch.from_arrays([part.column("head"), part.column("words").cast(pa.binary())], names=["head", "words"])

    found = marked.filter("spans IS NOT NULL").select("text", "spans").mapInArrow(lean(run), "head long, words binary")
    # Equal words are combined before the shuffle and are one row after it.
    texts = found.groupBy("head", "words").agg(F.lit(1).alias("one")).groupBy("head").agg(F.count("one").alias("n"))
    bad = scratch.table(texts.filter("n > 1").select("head"), "disagreeing")
    return None if bad.isEmpty() else bad


def by_words(marked: DataFrame, bad: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """id, first, n of the windows of the paths in bad whose words do stand elsewhere, by the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=16):
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans")), strict=True):
                words = text.encode().split()
                at = [(s["head"], j) for s in spans for j in range(s["first"], s["first"] + s["n"])]
                for a in range(0, len(at), 4096):
                    part = at[a : a + 4096]
                    yield pa.RecordBatch.from_pydict({"id": pa.array([i] * len(part), pa.int64()), "head": pa.array([h for h, _ in part], pa.int64()), "first": pa.array([j for _, j in part], pa.int32()), "words": pa.array([b" ".join(words[j : j + size]) for _, j in part], pa.binary())})

    rows = marked.filter("spans IS NOT NULL").select("id", "text", "spans").mapInArrow(lean(run), "id long, head long, first int, words binary")
    rows = scratch.table(rows.join(bad, "head").select("id", "first", "words"), "windows-by-words")
    again = rows.groupBy("words").agg(F.count("*").alias("times")).filter("times > 1").select("words")
    return rows.join(again, "words").select("id", "first", F.lit(1).alias("n"))


def remove_repeats(docs: DataFrame, size: int = WINDOW, k: int = KMER, texts: bool = False, bits: int = 64) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and with texts kept_text and the struct others of all other columns.

    A word goes if some window of `size` words that covers it also starts elsewhere, in the same text or
    another. Windows are judged on the input. kept_sha256 is of the kept words joined by one space; the kept
    text keeps its own white space, and is the text itself where nothing goes. Null texts have no words (and
    stay null), texts shorter than a window lose none; repeated rows repeat each other's windows. The other
    columns may have any names. bits: how many bits of word hashes count (fewer make false matches, which the
    comparison of words sets right).
    """
    scratch = Scratch(docs.sparkSession, "substring")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    # With texts, the other columns travel in one struct, so that their names can't clash.
    others = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", "doc_id"))).alias("others")] if texts and len(docs.columns) > 2 else []
    own = docs.select("doc_id", "text", *others)
    if ids.isEmpty():
        own = own.withColumn("id", F.col("doc_id").cast("long"))
    else:
        own = scratch.table(own.withColumn("id", F.monotonically_increasing_id()), "numbered")
    whole = compacted(repeated_edges(own.select("id", "text"), scratch, size, k, bits), scratch)
    spans = whole.groupBy("id").agg(F.collect_list(F.struct("first", "n", "head")).alias("spans"))
    marked = scratch.table(own.join(spans, "id", "left"), "marked")
    scratch.drop("runs")
    if (bad := disagreeing(marked, size, scratch)) is not None:
        # The paths in bad give way to what their words say.
        each = marked.select("id", F.explode("spans").alias("s")).select("id", "s.*").join(bad, "head", "left_anti").select("id", "first", "n")
        right = each.union(by_words(marked, bad, size, scratch)).groupBy("id").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
        marked = scratch.table(own.join(right, "id", "left"), "verified")
    rows = marked.drop("id")
    carried = [c for c in rows.columns if c not in ("text", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = (text or "").encode()
                words = data.split()
                n_words.append(len(words))
                if not runs:
                    n_removed.append(0)
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    kept_texts.append(text)
                    continue
                covered = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    covered[r["first"]] += 1
                    covered[r["first"] + r["n"] + size - 1] -= 1
                keep = (np.cumsum(covered)[:-1] == 0).tolist()
                kept = list(compress(words, keep))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                if texts:
                    kept_texts.append(b"".join(compress(WORD.findall(data), keep)).decode().strip("\t\n\v\f\r "))
            columns = {c: batch.column(c) for c in carried} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept_text": pa.array(kept_texts, pa.string())} if texts else {}))

    types = dict(rows.dtypes)
    return rows.mapInArrow(lean(run), ", ".join(f"{c} {types[c]}" for c in carried) + ", n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
