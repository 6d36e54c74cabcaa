"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves a bounded sample of the vectors again and again, by the median of their projections on the
line between two random ones of them. Every vector is indexed: it goes down each tree to a leaf. A query
goes down all trees at once through one shared priority queue, always to the node it is deepest within or
least beyond the border of, until it has met enough leaves; what those leaves hold are its candidates, each
once, and exact distances in double precision rank them. How many leaves are enough is measured on the
sample: so many that the queue meets the wanted share of the true neighbours there, found by brute force.

Many trees of small leaves are used: for one recall they propose far fewer candidates than few trees of large
ones. Only ids are looked up in the forest, a row of leaves at a time. Vectors lie in blocks of those that are near
each other in the first tree; a query comes to a block with the list of candidates that it has there, each once.

Equal vectors are one class in the index, with the smallest of their ids (no more of one class can be among
a query's nearest), so a leaf's size doesn't grow with the number of copies.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, Stage, lean, partitions

#: The sample that trees are fitted on: at most so many vectors and bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 32_768, 64 << 20
TREES, LEAF, RECALL, SEED = 96, 16, 0.96, 7
#: Bytes of a block of vectors, about, and queries that one task measures against it at once.
BLOCK_BYTES, QUERIES = 8 << 20, 512
#: Vectors whose leaves of one tree are searched together, about.
TOGETHER = 65_536
#: Sample vectors that the number of probes is measured with.
TRIALS = 128


class Tree:
    """One tree over sample vectors. Node k divides by the line from sample vector ends[k, 0] to ends[k, 1] and has the children kids[k]; a negative one is the leaf ~child."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        ends, borders, kids = [], [], []
        self.leaves, self.root = 0, 0
        #: Nodes and sides (1 right, -1 left) on the way to each leaf.
        ways: list[list[tuple[int, int]]] = []
        todo = [(np.arange(len(sample)), -1, 0, [])]
        while todo:
            rows, parent, side, way = todo.pop()
            node, parts = self._halves(sample, rows, leaf, rng)
            if node is None:
                ways.append(way)
                at = -len(ways)
            else:
                at = len(kids)
                ends.append(node[:2])
                borders.append(node[2])
                kids.append([0, 0])
                todo += [(parts[1], at, 1, [*way, (at, 1)]), (parts[0], at, 0, [*way, (at, -1)])]
            if parent >= 0:
                kids[parent][side] = at
            else:
                self.root = at
        self.leaves = len(ways)
        self.ends, self.borders, self.kids = np.array(ends, np.int32).reshape(-1, 2), np.array(borders, np.float32), np.array(kids, np.int32).reshape(-1, 2)
        depth = max(1, *map(len, ways))
        self.nodes, self.sides = np.zeros((len(ways), depth), np.int32), np.zeros((len(ways), depth), np.int8)
        for k, way in enumerate(ways):
            for i, (node_, side_) in enumerate(way):
                self.nodes[k, i], self.sides[k, i] = node_, side_

    @staticmethod
    def _halves(sample: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple:
        if len(rows) > leaf:
            a, b = rng.choice(rows, 2, replace=False)
            normal = sample[a] - sample[b]
            if length := float(np.linalg.norm(normal)):
                at = sample[rows] @ (normal / length)
                border = float(np.median(at))
                right = at > border
                if 0 < right.sum() < len(rows):
                    return (a, b, border), (rows[~right], rows[right])
        return None, None

    def normals(self, sample: np.ndarray) -> np.ndarray:
        x = sample[self.ends[:, 0]] - sample[self.ends[:, 1]]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)

    def find(self, rows: np.ndarray, sample: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        normals, node = self.normals(sample), np.full(len(rows), self.root)
        while (live := np.nonzero(node >= 0)[0]).size:
            at = node[live]
            right = np.einsum("ij,ij->i", rows[live], normals[at]) > self.borders[at]
            node[live] = self.kids[at, right.astype(int)]
        return -node - 1


class Forest:
    def __init__(self, sample: np.ndarray, trees: list[Tree]):
        self.sample, self.trees = sample, trees
        self.lengths = [np.maximum(np.linalg.norm(sample[t.ends[:, 0]] - sample[t.ends[:, 1]], axis=1), 1e-30) for t in trees]
        #: The first of each tree's leaves among all.
        self.first = np.concatenate([[0], np.cumsum([t.leaves for t in trees])]).astype(np.int64)

    def margins(self, query: np.ndarray) -> list[np.ndarray]:
        """For each tree, how far the query is beyond each node's border to the right."""
        at = self.sample @ query
        return [(at[t.ends[:, 0]] - at[t.ends[:, 1]]) / n - t.borders for t, n in zip(self.trees, self.lengths, strict=True)]

    def probe(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first leaves that the query meets in the shared queue."""
        margins = [m.tolist() for m in self.margins(query)]
        kids = self._kids()
        queue = [(-np.inf, k, t.root) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        met: list[int] = []
        while queue and len(met) < leaves:
            beyond, k, node = heapq.heappop(queue)
            if node < 0:
                met.append(int(self.first[k]) - node - 1)
                continue
            m, (left, right) = margins[k][node], kids[k][node]
            heapq.heappush(queue, (max(beyond, m), k, left))
            heapq.heappush(queue, (max(beyond, -m), k, right))
        return met

    def _kids(self) -> list[list[list[int]]]:
        if not hasattr(self, "_listed"):
            self._listed = [t.kids.tolist() for t in self.trees]
        return self._listed

    def rows(self, leaves: np.ndarray, row: int) -> np.ndarray:
        """The row of each leaf: `row` neighbouring leaves of a tree stand in one."""
        tree = np.searchsorted(self.first, leaves, side="right") - 1
        return (tree << 32) + (leaves - self.first[tree]) // row

    def keys(self, query: np.ndarray) -> np.ndarray:
        """What each leaf is worth in the queue, at once: the most that the query is beyond a border on the way to it. Leaves are met in this order."""
        return np.concatenate([np.max(-t.sides * m[t.nodes], axis=1, where=t.sides != 0, initial=-np.inf) if len(m) else np.full(1, -np.inf) for t, m in zip(self.trees, self.margins(query), strict=True)])

    def probes(self, k: int, recall: float, trials: int = TRIALS) -> int:
        """How many leaves make the queue meet `recall` of the k nearest sample vectors of some sample vectors."""
        sample = self.sample
        double = sample.astype(np.float64)
        leaf = np.stack([self.first[i] + t.find(sample, sample) for i, t in enumerate(self.trees)])
        needed = []
        for i in np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int):
            far = ((double - double[i]) ** 2).sum(axis=1)
            far[i] = np.inf
            near = np.argsort(far, kind="stable")[: min(k, len(sample) - 1)]
            keys = self.keys(sample[i])
            when = np.searchsorted(np.sort(keys), keys, side="right")
            needed.extend(np.min(when[leaf[:, near]], axis=0).tolist())
        return int(np.ceil(np.quantile(needed, recall))) if needed else int(self.first[-1])


def fitted(spark: SparkSession, sample: np.ndarray, trees: int, leaf: int, seed: int) -> Forest:
    """A forest whose trees are fitted by tasks, each from the whole (bounded) sample."""
    shared = spark.sparkContext.broadcast(sample)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(Tree(shared.value, leaf, np.random.default_rng((seed, k))))])], names=["id", "tree"])

    rows = spark.range(trees, numPartitions=min(trees, spark.sparkContext.defaultParallelism)).mapInArrow(lean(fit), "id long, tree binary").collect()
    return Forest(sample, [pickle.loads(r.tree) for r in sorted(rows)])


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: finite, not all zero, of the commonest length. Floats stay floats; other numbers are doubles."""
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    e = F.col("embedding").cast(kind)
    fine = e.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = rows.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
    return rows.filter(F.size("embedding") == (lengths.d if lengths else 0))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def measure(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """Of some queries (query_id, embedding, candidates) and a block of vectors (class_id, embedding): each query's k nearest among its candidates, by exact distances."""
    out: list[pa.Table] = []
    if asked.num_rows and held.num_rows:
        held = held.sort_by("class_id")
        names, x = held.column("class_id").to_numpy(), _matrix(held.column("embedding").combine_chunks(), np.float64)
        y = _matrix(asked.column("embedding").combine_chunks(), np.float64)
        for query, v, ids in zip(asked.column("query_id").to_pylist(), y, asked.column("candidates"), strict=True):
            at = np.searchsorted(names, np.sort(ids.values.to_numpy()))
            d = x[at] - v
            d = np.sqrt((d * d).sum(axis=1))
            best = np.argsort(d, kind="stable")[:k]
            out.append(pa.table({"query_id": np.full(len(best), query), "class_id": names[at[best]], "score": d[best]}))
    return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "class_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def looked_up(met: pa.Table, placed: pa.Table) -> pa.Table:
    """Of one row of leaves: who meets which (place, query), and what they hold (place, class_id, block). For each query and block, the ids there."""
    if not met.num_rows or not placed.num_rows:
        return pa.table({"query": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})
    placed = placed.sort_by("place")
    place, ids, block = (placed.column(c).to_numpy() for c in ("place", "class_id", "block"))
    wanted, query = met.column("place").to_numpy(), met.column("query").to_numpy()
    begin, end = np.searchsorted(place, wanted), np.searchsorted(place, wanted, side="right")
    n = end - begin
    of = np.repeat(query, n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    order = np.lexsort((block[at], of))
    of, at = of[order], at[order]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (block[at[1:]] != block[at[:-1]])]) if len(of) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(of)].astype(np.int32)), pa.array(ids[at]))
    return pa.table({"query": of[new], "block": block[at[new]], "ids": lists})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, seed: int = SEED, block_bytes: int = BLOCK_BYTES, at_once: int = QUERIES, work: dict | None = None) -> DataFrame:
    """The k nearest rows of vectors (vec_id, embedding) to each row of queries (likewise), but for those with its own vec_id.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance). Ties go to the smaller vec_id. Rows
    whose vector is null, zero, of unusual length, or holds a null or non-finite component take no part, nor
    do rows without vec_id. Where a vec_id stands for several vectors, its nearest one counts. Repeated rows
    count once; other columns are not looked at; without rows on either side there is no result. work, if
    given, takes how many vectors, queries, leaves met by each and distances there were.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = _usable(vectors)
    # The smallest ids of equal vectors, in two steps so that no group gathers in one task.
    few = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    some = rows.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(1024)).alias("salt")).agg(few.alias("ids"))
    few = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1)
    classes = scratch.table(some.groupBy("embedding").agg(few.alias("ids")).select(F.col("ids")[0].alias("class_id"), "ids", "embedding"), "classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(classes.head().embedding)
    asked = _usable(queries).filter(F.size("embedding") == dim).distinct().withColumnRenamed("vec_id", "query_id")
    asked = scratch.table(asked.repartition(partitions(spark)).withColumn("query", F.monotonically_increasing_id()), "asked")
    forest, probes = _forest(classes, n, dim, k, trees, leaf, recall, seed)
    shared, n_blocks = spark.sparkContext.broadcast(forest), -(-8 * dim * n // block_bytes)
    row = max(1, TOGETHER * forest.trees[0].leaves // n)

    met = scratch.table(asked.select("query", "embedding").mapInArrow(lean(_probing(shared, probes, row)), "leaves long, place long, query long"), "met")
    placed = scratch.table(classes.select("class_id", "embedding").mapInArrow(lean(_placing(shared, n_blocks, row)), "leaves long, place long, class_id long, block long"), "placed")
    listed = met.groupBy("leaves").cogroup(placed.groupBy("leaves")).applyInArrow(looked_up, "query long, block long, ids array<long>")
    candidates = listed.groupBy("query", "block").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("candidates"))
    candidates = scratch.table(candidates, "candidates")
    if work is not None:
        distances, n_queries = candidates.agg(F.coalesce(F.sum(F.size("candidates")), F.lit(0))).head()[0], asked.count()
        work.update(vectors=n, queries=n_queries, leaves=probes, distances=distances)

    # A block's queries are dealt to as many tasks as it takes, and its vectors go to each of those.
    parts = candidates.groupBy("block").agg(F.ceil(F.count("*") / at_once).cast("int").alias("parts"))
    own = candidates.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    own = own.join(asked, "query").select("block", "part", "query_id", "embedding", "candidates")
    held = classes.select("class_id", "embedding").join(placed.select("class_id", "block").distinct(), "class_id").join(parts, "block")
    held = held.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "class_id", "embedding")
    found = own.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(lambda a, b: measure(a, b, k + 1), "query_id long, class_id long, score double")
    found = found.groupBy("query_id", "class_id").agg(F.min("score").alias("score")).join(classes.select("class_id", "ids"), "class_id")
    found = found.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _forest(classes: DataFrame, n: int, dim: int, k: int, trees: int, leaf: int, recall: float, seed: int) -> tuple[Forest, int]:
    """A forest over a sample of the classes, and how many leaves a query is to meet."""
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * dim)))
    # A share of the hash range that is expected to hold nine tenths of the bound, cut at the bound.
    share = min(1.0, 0.9 * bound / n)
    drawn = classes.filter(F.pmod(F.xxhash64("class_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("class_id", "embedding").limit(bound)
    sample = np.array([r.embedding for r in sorted(drawn.collect())] or [classes.head().embedding], dtype=np.float32)
    forest = fitted(classes.sparkSession, sample, trees, leaf, seed)
    return forest, forest.probes(k, recall)


def _probing(forest: Broadcast, probes: int, row: int) -> Stage:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, x in enumerate(_matrix(batch.column("embedding"), np.float32)):
                met = np.array(forest.value.probe(x, probes), np.int64)
                yield pa.RecordBatch.from_pydict({"leaves": forest.value.rows(met, row), "place": met, "query": batch.column("query").take(pa.array(np.full(len(met), i)))})

    return run


def _placing(forest: Broadcast, n_blocks: int, row: int) -> Stage:
    """The leaf of each vector in every tree, and the block of those near it: its place among the leaves of the first tree, which stand in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, f = _matrix(batch.column("embedding"), np.float32), forest.value
            for i, t in enumerate(f.trees):
                leaf = t.find(x, f.sample).astype(np.int64)
                if not i:
                    block = leaf * n_blocks // t.leaves
                yield pa.RecordBatch.from_pydict({"leaves": f.rows(f.first[i] + leaf, row), "place": f.first[i] + leaf, "class_id": batch.column("class_id"), "block": block})

    return run
