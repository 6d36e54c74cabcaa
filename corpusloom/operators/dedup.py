"""Exact and near deduplication that keeps the first of each group in a given total order."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DedupConfig
from corpusloom.functions.text import words
from corpusloom.scratch import Scratch

#: Hashes are 31 bits and permutations (a * h + b) mod this prime, so products stay below 2**62.
PRIME = (1 << 31) - 1


def exact_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """doc_id and exact_kept of every row of df: whether it is the first of its key in order. doc_ids must be unique.

    df is read once: its ids, order and key are written as a narrow table, whose first row of each key comes
    from a partial aggregate and is joined back by doc_id, not by key. So however many copies a text has, they
    don't gather in one task.
    """
    carried = list(dict.fromkeys(["doc_id", *order]))
    keys = Scratch(df.sparkSession, "exact").table(df.select(*carried, key.alias("_key")), "keys")
    first = keys.groupBy("_key").agg(F.min(F.struct(*order, F.col("doc_id").alias("_id")))["_id"].alias("_first"))
    return keys.join(first.select("_first"), F.col("doc_id") == F.col("_first"), "left").select("doc_id", F.col("_first").isNotNull().alias("exact_kept"))


def geometry(cfg: DedupConfig = DedupConfig()) -> tuple[int, int]:
    """Bands and rows a band whose threshold (1/b)**(1/r) is nearest to the wanted one; the first of equals."""
    options = [(b, cfg.permutations // b) for b in range(1, cfg.permutations + 1)]
    return min(options, key=lambda o: abs((1 / o[0]) ** (1 / o[1]) - cfg.threshold))


def permutations(n: int) -> list[tuple[int, int]]:
    """n pairs (a, b) below the prime, a > 0."""

    def draw(name: str) -> int:
        return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")

    return [(1 + draw(f"a{i}") % (PRIME - 1), draw(f"b{i}") % PRIME) for i in range(n)]


def shingles(ws: Column, n: int = DedupConfig.shingle) -> Column:
    """Distinct n-word shingles of words (a column, as lambdas would make an expression again for each shingle); a shorter text is one shingle, an empty one the empty string."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " ")))
    return F.when(F.size(ws) >= n, many).otherwise(F.array(F.coalesce(F.array_join(ws, " "), F.lit(""))))


def shingle_hash(s: Column) -> Column:
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % (PRIME + 1)


def signatures(df: DataFrame, cfg: DedupConfig = DedupConfig(), carried: dict[str, Column] | None = None) -> DataFrame:
    """doc_id and m0, m1, ...: the least permuted hash of its shingles for each permutation that bands use; and the least of each carried column.

    The minima are one aggregate over exploded hashes; as a document's shingles lie together, it shuffles a row
    for each document. The words come from a generator: an optimizer that merged projections would else make
    them again for every shingle.
    """
    b, r = geometry(cfg)
    carried = carried or {}
    rows = df.select("doc_id", *(c.alias(k) for k, c in carried.items()), F.inline(F.array(F.struct(words(F.col("text")).alias("ws")))))
    hashed = rows.select("doc_id", *carried, F.explode(shingles(F.col("ws"), cfg.shingle)).alias("s")).select("doc_id", *carried, shingle_hash(F.col("s")).alias("h"))
    minima = [F.min((F.col("h") * a + c) % PRIME).alias(f"m{i}") for i, (a, c) in enumerate(permutations(b * r))]
    return hashed.groupBy("doc_id").agg(*minima, *(F.min(k).alias(k) for k in carried))


def bands(df: DataFrame, cfg: DedupConfig = DedupConfig(), carried: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, what is carried, band, key: equal keys of a band propose near duplicates."""
    b, r = geometry(cfg)
    keys = F.array(*(F.struct(F.lit(k).alias("band"), F.md5(F.concat_ws(",", *(f"m{i}" for i in range(k * r, k * r + r)))).alias("key")) for k in range(b)))
    return signatures(df, cfg, carried).select("doc_id", *(carried or {}), F.inline(keys))


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, bucket) with a document's rows together, documents in order: those that share a bucket with an earlier one that stays."""
    owned: set[int] = set()
    held, doc = [], None
    started = False

    def rejected() -> bool:
        if owned.isdisjoint(held):
            owned.update(held)
            return False
        return True

    for batch in batches:
        gone = []
        for d, bucket in zip(batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), strict=True):
            if started and d == doc:
                held.append(bucket)
                continue
            if started and rejected():
                gone.append(doc)
            started, doc, held = True, d, [bucket]
        yield pa.RecordBatch.from_arrays([pa.array(gone, batch.schema.field("doc_id").type)], names=["doc_id"])
        kind = batch.schema.field("doc_id").type
    if started and rejected():
        yield pa.RecordBatch.from_arrays([pa.array([doc], kind)], names=["doc_id"])


#: So few undecided rows (document, bucket) one task settles at once, in order; and up to LONG_TAIL (some 50 MB) where a round decides less than a tenth of them.
SETTLED_AT_ONCE, LONG_TAIL = 100, 200_000


def near_first(df: DataFrame, order: list[str], cfg: DedupConfig = DedupConfig(), among: DataFrame | None = None, at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """doc_id and near_kept of every document: the greedy choice in order, where a rejected one rejects none.

    A document stays unless an earlier one that stays shares a band key. Each round keeps, of the undecided
    documents, those that come first in all of their buckets, then drops those that share a bucket with
    a kept one: the outcome is that of the one-by-one pass for any partitioning. Every round decides at least
    the first undecided document, so the rounds end. Once at_once rows are left, or a long chain (which takes a
    round for each two documents), one task makes the pass itself over them. Buckets of one document are left out at
    once. among: only these doc_ids take part, and are in the result.
    """
    scratch = Scratch(df.sparkSession, "near")
    # Rows of one doc_id are one document, which never rejects itself. The rank travels with the signature: df is read once.
    rank = F.struct(*order, F.col("doc_id").alias("_id"))
    member = bands(df, cfg, {"rank": rank}).select("doc_id", "rank", F.xxhash64("band", "key").alias("bucket"))
    if among is not None:
        member = member.join(among.select("doc_id"), "doc_id", "left_semi")
    member = scratch.table(member, "members")
    every = member.select("doc_id").distinct()
    shared = member.groupBy("bucket").agg(F.count_distinct("doc_id").alias("n")).filter("n > 1").select("bucket")
    left = scratch.table(member.join(shared, "bucket"), "left-0")
    dropped, before = None, None
    for k in itertools.count(1):
        n = left.count()
        if not n:
            break
        slow, before = before is not None and n <= LONG_TAIL and n > 0.9 * before, n
        if n <= at_once or slow:
            kind = dict(member.dtypes)["doc_id"]
            gone = left.repartition(1).sortWithinPartitions("rank").select("doc_id", "bucket").mapInArrow(_one_by_one, f"doc_id {kind}")
            gone = scratch.table(gone, f"gone-{k}")
            dropped = gone if dropped is None else dropped.union(gone)
            break
        # First in all of its buckets: in as many as it has. Nothing is joined by bucket for that.
        firsts = left.groupBy("bucket").agg(F.min("rank")["_id"].alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("firsts"))
        has = left.groupBy("doc_id").agg(F.count_distinct("bucket").alias("buckets"))
        kept = scratch.table(has.join(firsts, "doc_id").filter("buckets = firsts").select("doc_id"), f"kept-{k}")
        # A written table, so that the join by bucket can split large buckets.
        taken = scratch.table(left.join(kept, "doc_id", "left_semi").select("bucket").distinct(), f"taken-{k}")
        gone = left.join(taken, "bucket", "left_semi").select("doc_id").distinct().join(kept, "doc_id", "left_anti")
        gone = scratch.table(gone, f"gone-{k}")
        dropped = gone if dropped is None else dropped.union(gone)
        left = scratch.table(left.join(kept.union(gone), "doc_id", "left_anti"), f"left-{k}")
    if dropped is None:
        return every.select("doc_id", F.lit(True).alias("near_kept"))
    return every.join(dropped.withColumn("near_kept", F.lit(False)), "doc_id", "left").withColumn("near_kept", F.coalesce("near_kept", F.lit(True)))


#: Hashes of shingles that are handed on together, at most (and one text's), and words whose hashes a task remembers.
HASHES, REMEMBERED = 500_000, 300_000


def shingle_sets(df: DataFrame, n: int = DedupConfig.shingle) -> DataFrame:
    """doc_id, set, hashes of df (tidied text): the distinct n-word shingles of each document as sorted 64-bit hashes, and a digest of the whole set.

    A word has a hash of 128 bits, of which two lanes of a shingle's hash are made for all shingles of a text at
    once: the first stands for the shingle, both are in the digest. Building the shingles as strings in the JVM
    takes some twenty times as long.
    """
    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "text").mapInArrow(_hashed_sets(n), f"doc_id {kind}, set binary, hashes array<long>")


def _hashed_sets(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    factor = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    shift = np.uint64(32)

    class Known(dict[str, bytes]):
        def __missing__(self, word: str) -> bytes:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            return h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()

        def of(text: str | None) -> tuple[bytes, np.ndarray]:
            ws = [w for w in (text or "").replace("\n", " ").split(" ") if w]
            size = min(n, len(ws))
            each = np.frombuffer(b"".join([known[w] for w in ws]), np.uint64).reshape(-1, 2)
            h = np.full((len(ws) - size + 1, 2), size + 1, np.uint64)
            for i in range(size):
                h = (h ^ each[i : i + len(h)]) * factor
                h ^= h >> shift
            h = h * factor[::-1]
            h ^= h >> shift
            first, at = np.unique(h[:, 0], return_index=True)
            return hashlib.md5(first.tobytes() + h[at, 1].tobytes()).digest(), first.view(np.int64)

        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            start, digests, held, size = 0, [], [], 0
            for i in range(batch.num_rows):
                digest, hashes = of(texts[i].as_py())
                digests.append(digest)
                held.append(hashes)
                size += len(hashes)
                if size >= HASHES or i + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([ids.slice(start, i + 1 - start), pa.array(digests, pa.binary()), lists], names=["doc_id", "set", "hashes"])
                    start, digests, held, size = i + 1, [], [], 0

    return run


def _classes(member: DataFrame) -> DataFrame:
    """set, class_id, class_size of a table of shingle sets."""
    return member.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))


def shingle_classes(df: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """doc_id, class_id, class_size and n_shingles of every document: those with equal shingle sets are a class, named by its smallest doc_id."""
    sets = shingle_sets(df, cfg.shingle).select("doc_id", "set", F.size("hashes").cast("long").alias("n_shingles"))
    member = Scratch(df.sparkSession, "classes").table(sets, "sets")
    return member.join(_classes(member), "set").select("doc_id", "class_id", "class_size", "n_shingles")


def jaccard_pairs(df: DataFrame, cfg: DedupConfig = DedupConfig(), threshold: float = 0.8, block: int = 1000) -> DataFrame:
    """All pairs (a, b), a < b, of class representatives whose shingle sets have a Jaccard similarity of at least threshold, with that similarity.

    Documents of one set are one class (see shingle_classes, which tells the members): copies are never paired,
    and no link between different sets is lost. Shingles are ordered by how few sets have them. Of two sets that
    are alike enough, each has one of the other's among its first n - ceil(threshold n) + 1, so only those few,
    which are rare ones, propose pairs; sets whose sizes differ too much aren't compared. Shingles that more than
    `block` sets have among their first are cut into blocks that are paired block by block. df is read once: what
    follows works on 64-bit hashes of shingles (shingle_sets), and shingles of one set alone, nearly all, are
    only counted.
    """
    scratch, t = Scratch(df.sparkSession, "pairs"), Fraction(str(threshold))
    above = lambda part, whole: F.lit(t.denominator) * part >= F.lit(t.numerator) * whole
    sets = scratch.table(shingle_sets(df, cfg.shingle), "sets")
    first = scratch.table(_classes(sets.select("doc_id", "set")).select(F.col("class_id").alias("doc_id")), "first")
    rows = sets.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", F.size("hashes").cast("long").alias("n"), F.col("hashes").alias("s"))
    rows = scratch.table(rows, "rows")
    scratch.drop("sets")
    each = rows.select("doc_id", "n", F.explode("s").alias("shingle"))
    common = scratch.table(each.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1"), "common")
    few = F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator) + 1
    # As many as a set has of first shingles, those of its own first: the sorted list is cut, and set sizes are those of documents.
    ordered = each.join(common, "shingle").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("s"))
    left = F.greatest(few - (F.col("n") - F.size("s")), F.lit(0)).cast("int")
    starts = scratch.table(ordered.select("doc_id", "n", F.explode(F.slice("s", F.lit(1), left)).alias("x")).select("doc_id", "n", "x.shingle"), "starts")
    shared = starts.groupBy("shingle").agg(F.count("*").alias("m")).filter("m > 1").select("shingle", F.ceil(F.col("m") / block).cast("long").alias("blocks"))
    own = starts.join(shared, "shingle").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = scratch.table(dealt.select("shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "n"), "blocks")
    x, y = (dealt.select("shingle", "low", "high", F.col("own").alias(f"own_{c}"), F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    like = above(F.least("n_a", "n_b"), F.greatest("n_a", "n_b"))
    pairs = x.join(y, ["shingle", "low", "high"]).filter(F.expr("a < b AND (low = high OR own_a <> own_b)") & like).select("a", "b").distinct()
    pairs = scratch.table(pairs, "proposed")
    of_a, of_b = (rows.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    pairs = pairs.join(of_a, "a").join(of_b, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    pairs = pairs.select("a", "b", "shared", (F.size("sa") + F.size("sb") - F.col("shared")).cast("long").alias("either")).filter(above(F.col("shared"), F.col("either")))
    return pairs.withColumn("jaccard", F.col("shared") / F.col("either"))


def collisions(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys in both, without null."""
    return left.select(key).filter(F.col(key).isNotNull()).intersect(right.select(key))


def first_seen(df: DataFrame, key: str, position: list[Column | str]) -> DataFrame:
    """The distinct keys with the position where each comes first."""
    return df.groupBy(key).agg(F.min(F.struct(*position)).alias("first")).select(key, "first.*")


def append_new(df: DataFrame, existing: DataFrame, order: list[Column | str], key: str = "doc_id") -> DataFrame:
    """Rows to append to a shard: one for each key that it doesn't have, the first in order (rows are combined by key before they are shuffled)."""
    new = df.join(existing.select(key), key, "left_anti").select(F.struct(*order).alias("_order"), F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"))
    return new.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
