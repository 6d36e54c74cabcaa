"""Near duplicates by Golay-code fuzzy hashing of five-word shingles, decided by their Jaccard similarity.

Two texts link when their shingle sets have a similarity of at least 0.8. As in `simhash`, a fingerprint is the
bitwise majority of shingle hashes, and codewords of the binary Golay code are its keys; but at 0.8 some 15 % of
the bits differ, too many for the codewords within a bit or two. So there are 192 bits, of which 7 segments of 23
are decoded by the counts behind the bits (a bit that nearly tied says little): the keys of a segment are the 4
codewords that agree best with its counts. A pair at 0.8 shares one of the 4 with a chance of 0.85, so it shares
none in 7 segments with one of 2 in a million. A key also holds a class of set sizes, which similar sets share.

Equal keys propose, the distance of whole fingerprints thins out (at most `FAR` bits; at 0.8 they differ in 29, by
chance in 96), and the sets decide. Texts that proposals join, directly or through others, are one group; in each
group every pair is compared that isn't joined by links already, so a group of near copies takes one comparison
a text. Buckets and groups beyond `BLOCK` texts (groups also beyond `BLOCK_BYTES`) are cut into blocks and
searched by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, Scratch, components, hot_keys, keyed_join, lean, slices
from corpusloom.llm.simhash import codewords, identified
from corpusloom.llm.substring import mix

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: 64-bit words of a fingerprint; segments of 23 bits and codewords of each; the most bits in which proposals differ.
WORDS, SEGMENTS, CODEWORDS, FAR = 3, 7, 4, 60
#: Set sizes are classed by two grids of this width (of logarithms) that lie half of it apart, so sets of a ratio up to 1.26 share a class.
SIZE_CLASS = 2 * np.log(1.26)
BLOCK, BLOCK_BYTES = 2048, 16 << 20

SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, np.uint64)
LANES, EACH = np.arange(8, dtype=np.uint64), np.uint64(0x0101010101010101)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles; a shorter text is one shingle, a text without a word the empty one."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know ASCII only.
    words = (text or "").encode().lower().split()
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - SHINGLE]
    return np.unique(np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def margins(found: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint, in how many more shingle hashes it is 1 than 0."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), 255):
        # Each byte of a lane counts one bit, so 255 hashes at a time.
        words = mix(found[at : at + 255, None] ^ SALTS)
        ones += (words[:, :, None] >> LANES & EACH).sum(axis=0, dtype=np.uint64).astype("<u8").view(np.uint8).reshape(WORDS, 8, 8).transpose(0, 2, 1).reshape(-1)
    return 2 * ones - len(found)


def _sums(part: np.ndarray) -> np.ndarray:
    """Of each row of k numbers its 2**k sums: at each place, those at the place's 1 bits less the others."""
    out = np.zeros((len(part), 1), np.int32)
    for k in range(part.shape[1]):
        out = np.concatenate([out - part[:, k, None], out + part[:, k, None]], axis=1)
    return out


def golay_keys(margin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The keys of each row of margins, of sets of these sizes: of size class, segment and codeword."""
    near, rest = [], (codewords() & 2047).astype(np.intp)
    for at in range(0, len(margin), 16):
        part = margin[at : at + 16, : 23 * SEGMENTS].astype(np.int32).reshape(-1, 23)
        # How well each codeword agrees: its 12 data bits and its 11 others.
        part = _sums(part[:, 11:]) + _sums(part[:, :11]).take(rest, axis=1)
        best = np.empty((len(part), CODEWORDS), np.int32)
        for k in range(CODEWORDS):
            best[:, k] = part.argmax(axis=1)
            part[np.arange(len(part)), best[:, k]] = np.iinfo(np.int32).min
        near.append(best.reshape(-1, SEGMENTS, CODEWORDS))
    word = np.concatenate(near) | (np.arange(SEGMENTS, dtype=np.int32) << 12)[:, None]
    place = np.log(size) / SIZE_CLASS
    classes = np.stack([2 * np.floor(place), 2 * np.floor(place + 0.5) + 1], axis=1).astype(np.int32)
    return (classes[:, :, None] << 15 | word.reshape(len(word), 1, -1)).reshape(len(word), -1)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _node(found: np.ndarray) -> int:
    """A signed hash of a set."""
    from xxhash import xxh3_64_intdigest

    return (xxh3_64_intdigest(found.tobytes()) + (1 << 63)) % (1 << 64) - (1 << 63)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64), node (a hash of the set), bits (the fingerprint) and keys of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            margin = np.array([margins(x) for x in found])
            bits = np.packbits(margin > 0, axis=1, bitorder="little").view("<i8")
            keys = golay_keys(margin, np.array([len(x) for x in found]))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1))) for x in (bits, keys)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(map(_node, found), pa.int64()), *lists], names=["doc_id", "text_hash", "node", "bits", "keys"])

    return _hashed(docs).mapInArrow(lean(run), "doc_id long, text_hash long, node long, bits array<long>, keys array<int>")


def proposals(key: np.ndarray, node: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all nodes that pairs of rows of one key, with fingerprints at most FAR apart, join; key is sorted.

    Each node is joined to the smallest it reaches, so that the many keys of a group of near copies give much the same edges.
    """
    known, at = np.unique(node, return_inverse=True)
    label = np.arange(len(known))
    rows, step = np.arange(len(key)), 0
    while True:
        # Each row and the one `step` further on, while that has its key.
        step += 1
        rows = rows[: np.searchsorted(rows, len(key) - step)]
        rows = rows[key[rows + step] == key[rows]]
        if not len(rows):
            joined = label != np.arange(len(known))
            return known[joined], known[label[joined]]
        new = rows[label[at[rows]] != label[at[rows + step]]]
        new = new[np.bitwise_count(bits[new] ^ bits[new + step]).sum(axis=1) <= FAR]
        if not len(new):
            continue
        a, b = label[at[new]], label[at[new + step]]
        while (a != b).any():
            above = np.arange(len(known))
            np.minimum.at(above, np.maximum(a, b), np.minimum(a, b))
            while (above != above[above]).any():
                above = above[above]
            label, a, b = above[label], above[a], above[b]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, bits) sorted by key, each key's at most two blocks: edges of proposals."""
    key, node, bits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64)

    def found(n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in proposals(key[:n], node[:n], bits[:n])], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        node = np.concatenate([node, batch.column("node").to_numpy()])
        bits = np.concatenate([bits, np.stack([batch.column(f"bits{k}").to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)])
        if len(key):
            # The last key may go on in the next batch.
            last = int(np.searchsorted(key, key[-1]))
            yield found(last)
            key, node, bits = key[last:], node[last:], bits[last:]
    yield found(len(key))


def sets(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """component, node and set (64-bit hashes) of the texts that picks (pick, component) names by text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(map(_node, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["component", "node", "set"])

    picks = F.broadcast(picks) if picks.count() <= BROADCAST_ROWS else picks
    rows = _hashed(docs).join(picks, F.col("text_hash") == F.col("pick")).select("component", "text")
    return rows.mapInArrow(lean(run), "component long, node long, set binary")


def forest(nodes: list[int], data: list[bytes]) -> list[tuple[int, int]]:
    """Edges that join all nodes that links join, fewer than there are nodes.

    Only pairs that can link are compared. Hashes go by how few of the sets have them; of two sets that link, each
    has one of the other's among its first n - ceil(0.8 n) + 1, and where they first meet enough must be left of
    both. So sets that share a template of less than that are never compared, and sets that are joined already
    aren't either.
    """
    size = np.array([len(d) // 8 for d in data])
    ends = np.cumsum(size)
    starts = ends - size
    known, at, common = np.unique(np.frombuffer(b"".join(data), "<u8"), return_inverse=True, return_counts=True)
    label, edges, has = np.arange(len(nodes)), [], np.zeros(len(known), bool)
    above, below = LEAST
    # The rank of each hash, and each set's hashes by rank.
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(common, kind="stable")] = np.arange(len(known))
    order = np.lexsort((rank[at], np.repeat(np.arange(len(nodes)), size)))
    first = size - -(-size * above // below) + 1
    place = np.arange(len(at)) - np.repeat(starts, size)
    early = np.flatnonzero((place < np.repeat(first, size)) & (common[at[order]] > 1))
    # Who has each hash among its first, and where.
    token, holder, where = at[order][early], np.repeat(np.arange(len(nodes)), size)[early], place[early]
    by = np.argsort(token, kind="stable")
    token, holder, where = token[by], holder[by], where[by]
    begin, end = np.searchsorted(token, np.arange(len(known))), np.searchsorted(token, np.arange(len(known)), side="right")
    for i in range(len(nodes) - 1):
        rest = slice(i + 1, None)
        # Sets whose sizes differ more can't be that similar.
        open_ = (label[rest] != label[i]) & (np.minimum(size[rest], size[i]) * below >= np.maximum(size[rest], size[i]) * above)
        if not open_.any():
            continue
        found = []
        for p, t in enumerate(at[order[starts[i] : starts[i] + first[i]]].tolist()):
            if common[t] > 1 and end[t] - begin[t] > 1:
                other, q = holder[begin[t] : end[t]], where[begin[t] : end[t]]
                later = int(np.searchsorted(other, i, side="right"))
                other, q = other[later:], q[later:]
                left = np.minimum(size[i] - p, size[other] - q)
                found.append(other[open_[other - i - 1] & ((above + below) * left >= above * (size[i] + size[other]))])
        if not found or not len(some := np.unique(np.concatenate(found))):
            continue
        own = at[starts[i] : ends[i]]
        has[own] = True
        n = size[some]
        members = at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[some], n)]
        shared = np.add.reduceat(has[members].astype(np.int64), np.cumsum(n) - n)
        has[own] = False
        for j in some[shared * below >= (n + size[i] - shared) * above].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((nodes[i], nodes[j]))
    return edges


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, set) sorted by key: edges of each key's forest."""
    held_key, nodes, data = None, [], []

    def found() -> pa.RecordBatch:
        edges = forest(nodes, data) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for key, node, members in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "set")), strict=True):
            if key != held_key:
                yield found()
                held_key, nodes, data = key, [], []
            nodes.append(node)
            data.append(members)
    yield found()


def proposed(scratch: Scratch, distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join the nodes of distinct (node, bits, keys) just as all proposals do."""
    keyed = distinct.select(F.explode(F.col("keys").cast("array<long>")).alias("key"), "node", *(F.col("bits")[k].alias(f"bits{k}") for k in range(WORDS)))
    sizes = scratch.table(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "large-keys")
    searched = keyed
    if n := sizes.count():
        sizes = F.broadcast(sizes) if n <= 100_000 else sizes
        marked = keyed.join(sizes, "key", "left")
        blocks = F.ceil(F.col("n") / block).cast("long")
        pairs = marked.filter("n IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        pairs = pairs.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        searched = marked.filter("n IS NULL").select(keyed.columns).union(pairs.select(keyed.columns))
    return searched.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_buckets), "a long, b long")


def _can_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, token, n, at, times) sorted by component and token: those of which two sets can link, if this is the first token that they share."""
    above, below = LEAST
    names = ["component", "token", "n", "at"]
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 5

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        key = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])] if len(rows[0]) else np.zeros(0, bool)
        cuts, good = [*np.flatnonzero(key).tolist(), len(rows[0])], np.zeros(len(rows[0]), bool)
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            n, left, times = rows[2][b:e], rows[2][b:e] - rows[3][b:e], rows[4][b:e]
            for i in range(e - b):
                fits = ((above + below) * np.minimum(left, left[i]) >= above * (n + n[i])) & (np.minimum(n, n[i]) * below >= np.maximum(n, n[i]) * above)
                good[b + i] = times[fits].sum() > 1 if fits[i] else fits.any()
        return pa.RecordBatch.from_arrays([pa.array(r[good]) for r in rows[:4]], names=names)

    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, [*names, "times"], strict=True)]
        if len(held[0]):
            # The last token may go on in the next batch.
            last = len(held[0]) - int(np.argmax((held[0] != held[0][-1])[::-1] | (held[1] != held[1][-1])[::-1]))
            last = 0 if (held[0] == held[0][-1]).all() and (held[1] == held[1][-1]).all() else last
            yield found([h[:last] for h in held])
            held = [h[last:] for h in held]
    yield found(held)


def finer(scratch: Scratch, member: DataFrame) -> DataFrame:
    """node, finer: smaller groups of the sets of large groups (component, node, set), which part no two sets that link.

    The hashes of a group go by how few of its sets have them. Two sets that link share one of their first
    n - ceil(0.8 n) + 1, and where they first meet enough is left of both; sets that can't meet anyone so are left
    out. So texts of one template that are less alike than 0.8 part again, in work proportional to their words.
    """
    above, below = LEAST

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set", rows=256):
            found = [np.frombuffer(x, "<i8") for x in batch.column("set").to_pylist()]
            n = np.array([len(x) for x in found])
            row = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column("component").take(row), batch.column("node").take(row), pa.array(np.repeat(n, n)), pa.array(np.concatenate(found))], names=["component", "node", "n", "token"])

    each = scratch.table(member.select("component", "node", "set").mapInArrow(lean(spread), "component long, node long, n long, token long"), "tokens")
    common = each.groupBy("component", "token").agg(F.count("*").alias("sets")).filter("sets > 1")
    # What only one set has comes first, so a common token's place is after those.
    shared = each.join(common, ["component", "token"]).groupBy("component", "node", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("s"))
    alone = F.col("n") - F.size("s")
    first = F.col("n") - F.ceil(F.col("n") * above / below) + 1
    early = shared.filter(alone < first).select("component", "node", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), (first - alone).cast("int"))).alias("k", "x"))
    early = scratch.table(early.select("component", "node", "n", (F.col("alone") + F.col("k")).cast("long").alias("at"), F.col("x.token").alias("token")), "early")
    kinds = early.groupBy("component", "token", "n", "at").agg(F.count("*").alias("times"))
    kinds = kinds.repartition("component", "token").sortWithinPartitions("component", "token").mapInArrow(lean(_can_meet), "component long, token long, n long, at long")
    meets = scratch.table(early.join(kinds, ["component", "token", "n", "at"], "left_semi").select("component", "token", "node"), "meets")
    least = meets.groupBy("component", "token").agg(F.min("node").alias("least"))
    edges = meets.join(least, ["component", "token"]).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    joined = components(scratch, edges, "finer")
    for name in ("tokens", "early", "meets"):
        scratch.drop(name)
    return joined.select("node", F.col("component").alias("finer"))


def links(scratch: Scratch, docs: DataFrame, distinct: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Edges (a, b) that connect the sets of docs, with their signatures distinct (node, pick, bits, keys), just as all links between those that proposals join do."""
    joined = components(scratch, proposed(scratch, distinct, block).distinct(), "groups")
    # Sets are made again for the texts in groups, a few of all: one text a set, and copies are combined before the shuffle.
    picks = distinct.join(joined, "node").select("pick", "component")
    member = sets(docs, scratch.table(picks, "picks")).groupBy("node").agg(F.first("component").alias("component"), F.first("set").alias("set"))
    member = scratch.table(member, "members")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("set")) / block_bytes)).cast("long")
    large = scratch.table(member.groupBy("component").agg(blocks.alias("blocks")).filter("blocks > 1"), "large")
    if not large.isEmpty():
        few = member.join(large, "component", "left_anti").select("component", "node", "set")
        rest = member.join(finer(scratch, member.join(large, "component", "left_semi")), "node").select(F.col("finer").alias("component"), "node", "set")
        member = scratch.table(few.union(rest), "members-finer")
        scratch.drop("members")
        large = scratch.table(member.groupBy("component").agg(blocks.alias("blocks")).filter("blocks > 1"), "large-finer")
    searched = member.select(F.col("component").alias("key"), "node", "set")
    if n := large.count():
        large = F.broadcast(large) if n <= 100_000 else large
        marked = member.join(large, "component", "left")
        pairs = marked.filter("blocks IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pairs = pairs.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "set")
        searched = marked.filter("blocks IS NULL").select(F.col("component").alias("key"), "node", "set").union(pairs)
    return searched.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_groups), "a long, b long")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """node, first_id, n (rows), pick (a text_hash), bits and keys of each set among signatures."""
    return rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.min("text_hash").alias("pick"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))


def jaccard_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, text_hash and component_id, the smallest doc_id that links reach.

    Null texts count as empty; texts without a word are linked. Repeated rows come out as often as they go
    in. A null doc_id stays null and is never a component's id unless the component has no other. Other
    columns are not looked at; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.table(signatures(docs), "signatures")
    distinct = scratch.table(distinct_sets(rows), "distinct")
    info = scratch.table(identified(scratch, distinct, links(scratch, docs, distinct), "node"), "info")
    for name in ("members", "members-finer", "picks", "edges"):
        scratch.drop(name)
    hot = hot_keys(distinct.select("node", "n"), rows.count(), scratch, "hot")
    scratch.drop("distinct")
    return keyed_join(rows.drop("bits", "keys"), info, "node", hot).select("doc_id", "text_hash", "component_id")
