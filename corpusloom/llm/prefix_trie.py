"""Shared beginnings of conversations as a trie whose nodes stand in preorder.

A node is a distinct sequence of first turns. Two sums of hashes of (place, turn), running totals over the
sorted turns, name the beginning of a conversation at each of its turns, so a node is a group and no
conversation, however long, is read by one task. Each node goes to the lane of the conversation whose id has
the smallest hash among those that share it: a lane is a downward row of nodes, and a way from the root
changes lanes about as often as the logarithm of the number of conversations, whatever the conversations are.

Nodes are ranked lexicographically: by the branches (depth, lane) that lead to their lane, and their depth in
it, at each node branches before the lane's next node. Then the nodes below a node follow it, up to the end
of its lane's block: one end position a lane. Leaves and savings of a subtree are differences of running totals.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, hot_keys, keyed_join, lean, partitions
from corpusloom.llm.running import MASK, running

#: Ids of one node are hashed in blocks of at most so many.
BLOCK = 4096


def placed_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, place (from 0), digest (of role and text), n_bytes (of the text): a written table of conversations (conv_id, turn, role, text).

    Turns go by number, null first; those of equal number by digest. Null roles and texts count as empty. Rows
    without conv_id take no part; other columns (of any name) are not looked at.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one"))
    rows = running(scratch.table(rows, "turns"), ["conv_id", "turn", "digest"], ["one"], scratch, "placed", group="conv_id")
    return rows.select("conv_id", (F.col("run_one") - 1).alias("place"), "digest", "n_bytes")


def _big_endian(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def _name(depth: Column, *sums: Column) -> Column:
    return F.concat_ws("-", depth.cast("string"), *(s.cast("string") for s in sums))


def _beginnings(turns: DataFrame, salt: int, scratch: Scratch) -> DataFrame:
    """turns with depth, the node that ends with each and its parent's, named by running totals of two hashes."""
    hashes = {"h1": F.xxhash64(F.lit(salt), "place", "digest"), "h2": F.xxhash64("digest", F.lit(salt), "place")}
    rows = turns.withColumns({k: h.bitwiseAND(MASK) for k, h in hashes.items()})
    rows = running(rows, ["conv_id", "place"], ["h1", "h2"], scratch, f"sums-{salt}", group="conv_id")
    before = [(F.col(f"run_{h}") - F.col(h)).bitwiseAND(MASK) for h in ("h1", "h2")]
    depth = F.col("place") + 1
    return rows.select("conv_id", depth.alias("depth"), _name(depth, F.col("run_h1"), F.col("run_h2")).alias("node"), _name(F.col("place"), *before).alias("parent"), "digest", "n_bytes")


ROOT = "0-0-0"


def _nodes(turns: DataFrame, ids: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, parent, depth, digest, n_bytes, n_convs, conv_id, lane), and the turns with their nodes.

    All turns of a node must agree in their digests and parents, else two beginnings share both sums: then all
    is named anew with other hashes. As this holds at every depth, names are as good as the SHA-256 of turns.
    """
    lane = F.struct(F.xxhash64("conv_id").alias("hash"), "conv_id")
    for salt in itertools.count():
        rows = scratch.table(_beginnings(turns, salt, scratch), f"beginnings-{salt}")
        last = F.struct("digest", "parent")
        found = rows.groupBy("node").agg(F.min(last).alias("last"), (F.min(last) == F.max(last)).alias("same"), F.min("depth").alias("depth"), F.min("n_bytes").alias("n_bytes"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(lane).alias("lane"))
        found = scratch.table(found, f"nodes-{salt}")
        if found.filter("not same").isEmpty():
            break
    root = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(lane).alias("lane")).filter("n_convs > 0")
    named = found.select("node", F.col("last.parent").alias("parent"), "depth", F.col("last.digest").alias("digest"), "n_bytes", "n_convs", "conv_id", F.col("lane.conv_id").alias("lane"))
    top = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"), "n_convs", "conv_id", F.col("lane.conv_id").alias("lane"))
    return scratch.table(named.union(top), "nodes"), rows


def _id_hashes(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """node, ends_sha256: of the ids of each node in ends (node, conv_id), ascending, joined by commas.

    Sorted ids become blocks of text wherever they lie; a node's blocks then pass through one hash in their
    order, one at a time, since the hash of a long text can't be split; its memory is a batch of blocks.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column("node").to_numpy(zero_copy_only=False), batch.column("conv_id").to_pylist()
            out = []
            begins = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(ids)] if ids else []
            for b, e in itertools.pairwise(begins):
                out += [(names[b], ids[i], ",".join(map(str, ids[i : min(i + BLOCK, e)]))) for i in range(b, e, BLOCK)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == node:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    n = partitions(ends.sparkSession)
    ends = scratch.table(ends, "ends")
    blocks = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(lean(block), "node string, first long, ids string")
    return blocks.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(lean(digest), "node string, ends_sha256 string")


def _lane_keys(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """lane, key: the branches that lead to each lane, as bytes that sort in preorder. By pointer jumping, in the logarithm of the longest way."""
    tops = nodes.filter("parent is null or parent_lane <> lane")
    branch = F.concat(_big_endian(F.col("depth") - 1), F.unhex(F.lit("01")), _big_endian(F.col("lane")))
    lanes = scratch.table(tops.select("lane", F.col("parent_lane").alias("up"), F.when(F.col("parent").isNull(), F.unhex(F.lit(""))).otherwise(branch).alias("key")), "lanes-0")
    for k in itertools.count(1):
        open_ = lanes.filter("up is not null")
        n = open_.count()
        if not n:
            return lanes.select("lane", "key")
        hot = hot_keys(open_.groupBy("up").agg(F.count("*").alias("n")), n, scratch, f"lanes-hot-{k}")
        above = lanes.select(F.col("lane").alias("up"), F.col("up").alias("next"), F.col("key").alias("start"))
        jumped = keyed_join(open_, above, "up", hot).select("lane", F.col("next").alias("up"), F.concat("start", "key").alias("key"))
        lanes = scratch.table(lanes.filter("up is null").union(jumped), f"lanes-{k}")


def prefix_trie(turns: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of turns (conv_id, place, digest, n_bytes), whose places go from 0 on, and ids (conv_id, each once), which also has conversations without turns.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless
    nodes of the subtree, itself included), saved_bytes (over the subtree, bytes of the last text times the
    members but one), preorder and subtree_end (places of the node and of the last below it, from 0), digest (of
    the last turn; null at the root) and ends_sha256 (of the ids of members that end there). Without any id there
    is no node.
    """
    nodes, rows = _nodes(turns, ids, scratch)
    lasts = rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ended = ids.join(lasts, "conv_id", "left").select(F.coalesce("node", F.lit(ROOT)).alias("node"), "conv_id")
    hashes = _id_hashes(ended, scratch)

    total = nodes.count()
    children = scratch.table(nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n")), "children")
    many = hot_keys(children, total, scratch, "many")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("lane").alias("parent_lane"))
    known = nodes.join(children.select(F.col("parent").alias("node"), F.col("n").alias("n_children")), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = scratch.table(keyed_join(known, parents, "parent", many, "left"), "known")

    long_lanes = hot_keys(nodes.groupBy("lane").agg(F.count("*").alias("n")), total, scratch, "long-lanes")
    keys = _lane_keys(known, scratch)
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    leaf = (F.col("n_children") == 0).cast("long")
    stops = keys.select(F.concat("key", F.unhex(F.lit("ff"))).alias("key"), "lane", *(F.lit(None).cast(t).alias(c) for c, t in known.dtypes if c != "lane"), *(F.lit(0).cast("long").alias(c) for c in ("leaf", "saved", "one")))
    inside = keyed_join(known, keys, "lane", long_lanes).withColumns({"leaf": leaf, "saved": saved, "one": F.lit(1).cast("long"), "key": F.concat("key", _big_endian(F.col("depth")), F.unhex(F.lit("00")))})
    ranked = scratch.table(inside.select(*stops.columns).union(stops), "to-rank")
    ranked = scratch.table(running(ranked, ["key"], ["leaf", "saved", "one"], scratch, "ranked"), "rank")
    stops = ranked.filter("node is null").select("lane", *(F.col(f"run_{c}").alias(f"end_{c}") for c in ("leaf", "saved", "one")))
    spans = keyed_join(ranked.filter("node is not null"), stops, "lane", long_lanes)
    none = hashlib.sha256(b"").hexdigest()
    return spans.join(hashes, "node", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("end_leaf") - F.col("run_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("run_saved") + F.col("saved")).alias("saved_bytes"),
        (F.col("run_one") - 1).alias("preorder"),
        (F.col("end_one") - 1).alias("subtree_end"),
        "digest",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes with the role and text of their last turn (null at the root), from the conversations they were made of."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.select(digest.alias("digest"), role.alias("role"), text.alias("text")).groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(turns, "digest", "left")
