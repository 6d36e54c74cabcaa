"""What the training-data operators share: inputs, shared scratch tables, Arrow batches, components."""

from __future__ import annotations

import ctypes
import functools
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.scratch import Scratch, scratch_root
from corpusloom.session import ship, spread

__all__ = ["SPACE_CLASS", "Scratch", "components", "fresh", "hot_keys", "keyed_join", "lean", "partitions", "scratch_root", "slices", "table", "without"]

#: Words, as the contracts define them, end at these characters (those of bytes.split()).
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most `rows` rows and, unless it is one row, about `size` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            if i > begin and (i - begin >= rows or held + n > size):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


Stage = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Stage) -> Stage:
    """run, after which the worker gives back what it holds no more: workers live on, beside those of later stages."""

    @functools.wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return leaner


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has columns called so (in any case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


#: Rows to leave out are broadcast up to so many (two 8-byte keys each).
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone (gone_id, gone_hash): those of that doc_id (null too) and xxhash64 of text. docs may have any other columns."""
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    by_id, by_hash = fresh(docs, "gone_id", "gone_hash")
    gone = gone.select(F.col("gone_id").alias(by_id), F.col("gone_hash").alias(by_hash))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(by_id)) & (F.xxhash64("text") == F.col(by_hash)), "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if more than HOT_ROWS rows and more than one in HOT_SHARE of all rows have it; so there are fewer than HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 200, 50_000


def hot_keys(counts: DataFrame, total: int, scratch: Scratch, name: str) -> DataFrame | None:
    """The hot keys of some rows, with copies, as a written table (None if there is none). counts: (key under any name, n).

    copies is how many shares of a hot key's size its rows make; all copies together are fewer than 2 * HOT_SHARE.
    """
    if total <= HOT_ROWS:
        return None
    share = max(HOT_ROWS, total // HOT_SHARE)
    hot = counts.filter(F.col("n") > share).withColumn("copies", F.ceil(F.col("n") / share).cast("int")).drop("n")
    hot = scratch.table(hot, name)
    return None if hot.isEmpty() else hot


def keyed_join(rows: DataFrame, known: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with known (one row a key) by key. The rows of a hot key are dealt to as many tasks as it has copies, and what is known of it goes to each."""
    if hot is None:
        return rows.join(known, key, how)
    copies, deal = fresh(rows.join(known.limit(0), key), "copies", "deal")
    hot = F.broadcast(hot.withColumnRenamed("copies", copies))
    others = [f"`{c}`" for c in rows.columns if c != key]
    dealt = rows.join(hot, key, "left").withColumn(deal, F.coalesce(F.pmod(F.xxhash64(*others), F.col(copies)).cast("int"), F.lit(0))).drop(copies)
    everywhere = known.join(hot, key, "left").withColumn(deal, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1))).drop(copies)
    return dealt.join(everywhere, [key, deal], how).drop(deal)


#: So few edges one task joins at once, some MB of them.
SETTLED_AT_ONCE = 5_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b): each of their nodes with one node of its component, the same for all of that, as root."""
    held = list(batches)
    if not held:
        return
    nodes = pa.concat_arrays([batch.column(c) for c in ("a", "b") for batch in held])
    known: dict = {}
    # Structs come as dicts. The place where a node comes first stands for it.
    place = [known.setdefault(tuple(x.values()) if isinstance(x, dict) else x, i) for i, x in enumerate(nodes.to_pylist())]
    above = {i: i for i in known.values()}

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    for a, b in zip(place[: len(place) // 2], place[len(place) // 2 :], strict=True):
        above[root(b)] = root(a)
    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(x, pa.int64())) for x in (list(above), list(map(root, above)))], names=["node", "root"])


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """Connected components: (node, component), component being the smallest node reached.

    edges: (a, b) of one orderable type, a != b, in any order and number. Nodes without an edge are not in
    the result. Each round contracts the graph: a node goes to the neighbour that comes first in the round's own
    random order, if that comes before itself (a partial aggregate, so hubs are combined before the shuffle),
    and the edges are renamed, once each; those within one node are gone. As edges shrink by a factor a round,
    whatever the graph's shape, all rounds together read a few times what the first does. Hubs, and nodes that
    many go to, are hot keys of the joins (see keyed_join). Each round is a written table, deleted once nothing
    reads it. When at_once edges or fewer are left one task joins them: a round costs some ten jobs however few
    edges it has, and the last rounds halve a handful.
    """

    def renamed(rows: DataFrame, to: DataFrame, key: str, tag: str, n: int | None = None) -> DataFrame:
        """rows (n of them) with key taken over to the root that it went to (some don't go)."""
        hot = hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), rows.count() if n is None else n, scratch, f"{name}-hot-{tag}")
        joined = keyed_join(rows, to.select(F.col("node").alias(key), F.col("root").alias("to_")), key, hot, "left")
        return joined.withColumn(key, F.coalesce("to_", key)).drop("to_")

    def tidy(rows: DataFrame, k: int) -> DataFrame:
        pair = rows.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return scratch.table(pair, f"{name}-edges-{k}")

    left, went = tidy(edges, 0), []
    for k in itertools.count():
        n = left.count()
        if not n:
            break
        if n <= at_once:
            kind = dict(left.dtypes)["a"]
            went.append(scratch.table(left.coalesce(1).mapInArrow(lean(_joined), f"node {kind}, root {kind}"), f"{name}-went-{k}"))
            scratch.drop(f"{name}-edges-{k}")
            break
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        turn = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("turn"), F.col(c).alias("x"))
        first = both.groupBy("node").agg(F.min(turn("other")).alias("first"))
        went.append(scratch.table(first.select("node", F.when(F.col("first") < turn("node"), F.col("first.x")).otherwise(F.col("node")).alias("root")), f"{name}-went-{k}"))
        moved = scratch.table(renamed(left, went[-1], "a", f"a-{k}", n), f"{name}-moved-{k}")
        after = tidy(renamed(moved, went[-1], "b", f"b-{k}", n), k + 1)
        scratch.drop(f"{name}-moved-{k}")
        scratch.drop(f"{name}-edges-{k}")
        left = after
    if not went:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Where the nodes of each round end up, from the last round back to the first.
    ends = went[-1]
    for k in range(len(went) - 2, -1, -1):
        ends = scratch.table(renamed(went[k], ends, "root", f"root-{k}"), f"{name}-ends-{k}")
        scratch.drop(f"{name}-went-{k}")
        scratch.drop(f"{name}-went-{k + 1}" if k == len(went) - 2 else f"{name}-ends-{k + 1}")
    least = ends.groupBy("root").agg(F.min(F.least("node", "root")).alias("least"))
    return renamed(ends, least.select(F.col("root").alias("node"), F.col("least").alias("root")), "root", "least").select("node", F.col("root").alias("component"))
