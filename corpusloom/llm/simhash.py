"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a document's word shingles. Two of them link
when at most 4 of the 64 bits differ. The bits are cut into three segments; at most 4 errors leave at least
two segments with at most 2 errors each (else there were 6). Within a segment, two values that differ in at
most 2 bits have a third one within 1 bit of both, and the perfect binary Golay code decodes that one to one
codeword: so the codewords nearest to a value and to its neighbours, 1 or 6 of them, are keys of which both
share one. The keys of two segments together are 24 bits; equal keys propose, and the exact distance decides.

Buckets work on distinct fingerprints. A bucket yields a spanning forest of its links, never its pairs; one
of more than `BLOCK` fingerprints is cut into blocks, and each pair of blocks is searched as a bucket.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, components, hot_keys, keyed_join, lean, partitions, slices

SHINGLE, SEED, ERRORS = 4, 42, 4
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BLOCK = 2048


def fingerprint(text: str | None) -> int:
    """Unsigned 64 bits; 0 without a word."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know ASCII only.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n], ends[-n:]
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        part = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + 16384].tolist(), ends[at : at + 16384].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64) and fp (the fingerprint as a signed 64-bit integer) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, text_hash long, fp long")


@functools.cache
def codewords() -> np.ndarray:
    """The 4096 codewords of the perfect Golay code (generator 0xC75), by their 12 data bits."""
    data = np.arange(1 << 12, dtype=np.uint32)
    rest = data << 11
    for k in range(22, 10, -1):
        rest = np.where(rest >> k & 1, rest ^ np.uint32(0xC75 << (k - 11)), rest)
    return data << 11 | rest


@functools.cache
def decoder() -> np.ndarray:
    """For each 23-bit word the 12 data bits of the codeword within 3 bits of it."""
    words, data = codewords(), np.arange(1 << 12, dtype=np.uint32)
    table = np.zeros(1 << 23, np.uint16)
    one = 1 << np.arange(23, dtype=np.uint32)
    errors = [np.uint32(0), *one, *(one[i] | one[j] for i in range(23) for j in range(i)), *(one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j))]
    for e in errors:
        table[words ^ e] = data
    return table


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of unsigned fingerprints: each row's distinct keys."""
    table, near = decoder(), []
    for first, n in SEGMENTS:
        value = (fps >> np.uint64(first) & np.uint64((1 << n) - 1)).astype(np.uint32)
        flips = np.concatenate([[0], 1 << np.arange(n)]).astype(np.uint32)
        found = np.sort(table[value[:, None] ^ flips[None, :]].astype(np.int64), axis=1)
        # Up to 6 distinct codewords: put repeats last and cut there.
        found[:, 1:][found[:, 1:] == found[:, :-1]] = 1 << 12
        near.append(np.sort(found, axis=1)[:, :6])
    rows, out = [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        pair = (near[i][:, :, None] << 12 | near[j][:, None, :]).reshape(len(fps), -1)
        good = ((near[i] < 4096)[:, :, None] & (near[j] < 4096)[:, None, :]).reshape(len(fps), -1)
        row = np.nonzero(good)[0]
        rows.append(row)
        out.append(pair[good] | k << 24)
    return np.concatenate(rows), np.concatenate(out)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges (signed) that join all of fps that links join, fewer than there are fingerprints."""
    n = len(fps)
    label, edges = np.arange(n), []
    for i in range(n - 1):
        near = i + 1 + np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= ERRORS)[0]
        for j in near[label[near] != label[i]]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((i, j))
    signed = fps.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in edges]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key, each key's at most a few blocks: edges of each bucket's forest."""
    out: set[tuple[int, int]] = set()
    held_key, held_fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def flush() -> pa.RecordBatch:
        rows = list(out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def search(key: np.ndarray, fps: np.ndarray) -> None:
        cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        size = np.diff(cuts)
        # Buckets of two, the most by far, at once.
        first = cuts[:-1][size == 2]
        x, y = fps[first], fps[first + 1]
        near = (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= ERRORS) & (x != y)
        out.update(zip(x[near].tolist(), y[near].tolist(), strict=True))
        for a, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            out.update(forest(np.unique(fps[a : a + n]).view(np.uint64)))

    for batch in batches:
        key = np.concatenate([held_key, batch.column("key").to_numpy()])
        fps = np.concatenate([held_fps, batch.column("fp").to_numpy()])
        if len(key):
            # The last key may go on in the next batch.
            last = int(np.searchsorted(key, key[-1]))
            search(key[:last], fps[:last]) if last else None
            held_key, held_fps = key[last:], fps[last:]
        if len(out) > 50_000:
            yield flush()
    if len(held_key):
        search(held_key, held_fps)
    yield flush()


def links(scratch: Scratch, distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of distinct (fp) just as all their links do."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, key = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows])], names=["key", "fp"])

    # Few bytes make many keys, so the fingerprints are dealt to more tasks than their size asks for.
    keyed = distinct.repartition(partitions(distinct.sparkSession), "fp").mapInArrow(lean(emit), "key long, fp long")
    sizes = scratch.table(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "large")
    spread = keyed
    if large := sizes.count():
        # Keys of more than a block of fingerprints: fewer than all keyed rows / block.
        sizes = F.broadcast(sizes) if large <= 100_000 else sizes
        marked = keyed.join(sizes, "key", "left")
        small = marked.filter("n IS NULL").select("key", "fp")
        blocks = F.ceil(F.col("n") / block).cast("long")
        own = F.pmod(F.xxhash64("fp"), blocks)
        pairs = marked.filter("n IS NOT NULL").withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pairs = pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        spread = small.union(pairs)
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_buckets), "a long, b long")


def identified(scratch: Scratch, distinct: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Every row of distinct (key, first_id) as key, component_id: the smallest first_id that edges (a, b) between keys reach.

    A node of the graph is the id that speaks for a key, so a component's label is its id: no group of a
    component's members gathers again. Nodes without an id come after all others.
    """
    edges = scratch.table(edges.select("a", "b").distinct(), "edges")
    total = edges.count()
    node = F.struct(F.col("first_id").isNull().alias("no_id"), F.col("first_id").alias("id"), F.col(key).alias("key"))
    for side in ("a", "b"):
        hot = hot_keys(edges.groupBy(side).agg(F.count("*").alias("n")), total, scratch, f"hot-{side}")
        edges = keyed_join(edges, distinct.select(F.col(key).alias(side), node.alias(f"node_{side}")), side, hot)
    joined = components(scratch, edges.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    joined = joined.select(F.col("node.key").alias(key), F.col("component.id").alias("reached"), F.lit(True).alias("linked"))
    found = distinct.select(key, "first_id").join(joined, key, "left")
    return found.select(key, F.when(F.col("linked"), F.col("reached")).otherwise(F.col("first_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, text_hash, fp (signed) and component_id, the smallest doc_id that links reach.

    Null texts count as empty; all texts without a word have fingerprint 0 and are linked like any others.
    Repeated rows come out as often as they go in. A null doc_id stays null and is never a component's id
    unless the component has no other. Other columns are not looked at; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs), "fps")
    distinct = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    info = scratch.table(identified(scratch, distinct, links(scratch, distinct.select("fp")), "fp"), "info")
    hot = hot_keys(distinct.select("fp", "n"), rows.count(), scratch, "hot")
    return keyed_join(rows, info, "fp", hot).select("doc_id", "text_hash", "fp", "component_id")
