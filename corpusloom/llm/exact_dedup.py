"""Exact dedup as a log-structured merge index of digests, in DataFrame functions only.

Memtables (blocks of consecutive scanned rows) are grouped by digest and flushed as runs sorted by digest.
Compaction merges runs into a level, which has one entry a digest: the best row and the number of rows. Every
level has a filter, bitmaps over hashes of its digests, and what is looked up in a level meets its filter
first. Three steps do so:

* Digests that more than one row has are hits. The filter of the hits tells most single rows apart, which
  are their own groups without a join, and whose texts are not read on.
* Texts behind hits are compared as bytes; a digest that stands for several texts is resolved by the texts.
* `contains` asks each level's filter before it joins the level.

A run holds one entry per memtable and digest, with the rows as a posting list bounded by the memtable's
size. Digests of very many rows are few, and are joined by a broadcast, so no group gathers in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, SPACE_CLASS, Scratch, fresh, hot_keys, keyed_join

#: Bits of one bitmap (what bitmap_construct_agg makes), keys meant for each, and bitmaps of a filter at most (64 MB, as they are broadcast).
BITS, KEYS, BITMAPS = 32_768, 4_096, 16_384


def without_space(text: Column) -> Column:
    """The text without the six ASCII white-space characters; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "")


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


class Filter:
    """Bitmaps over the digests of a table: what it doesn't pass isn't in the table. Beyond BITMAPS * KEYS digests it passes more, never less."""

    def __init__(self, digests: DataFrame, n: int, scratch: Scratch, name: str):
        self.count = min(BITMAPS, n // KEYS + 1)
        place, bit = self._place(F.col("digest"))
        made = digests.select(place.alias("filter_place"), bit.alias("bit")).groupBy("filter_place").agg(F.bitmap_construct_agg("bit").alias("filter_bits"))
        self.bitmaps = scratch.table(made, name)

    def _place(self, digest: Column) -> tuple[Column, Column]:
        h = F.xxhash64(digest)
        return F.pmod(h, F.lit(self.count)).cast("int"), F.pmod(F.shiftrightunsigned(h, 24), F.lit(BITS))

    def passes(self, rows: DataFrame) -> DataFrame:
        """rows (digest, ...) with passed."""
        place, bit = self._place(F.col("digest"))
        met = rows.join(F.broadcast(self.bitmaps), place == F.col("filter_place"), "left")
        byte = F.conv(F.hex(F.substring(F.col("filter_bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        on = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
        return met.withColumn("passed", F.coalesce(on, F.lit(False))).drop("filter_place", "filter_bits")


@dataclass
class Level:
    """digest, best (row, memtable), group_size, sorted by digest; and the filter over them."""

    table: DataFrame
    filter: Filter


class DigestIndex:
    """The index over documents (doc_id, text, anything else): one table, and others that are added.

    Rows rank by most code points of the original text, then smallest doc_id (a null doc_id comes last),
    then place in the scan. Null texts count as empty; an empty table gives an empty index; other columns are
    not looked at.
    """

    def __init__(self, docs: DataFrame, *, normal: Callable[[Column], Column] = without_space, digest: Callable[[Column], Column] = sha256, memtable_bits: int = 12, fanout: int = 8):
        self.normal, self.digest, self.bits, self.fanout = normal, digest, memtable_bits, fanout
        self.scratch = Scratch(docs.sparkSession, "lsm")
        self.docs: list[DataFrame] = []
        self.runs: list[DataFrame] = []
        self.levels: list[Level] = []
        self.add(docs)

    def add(self, docs: DataFrame) -> None:
        """Flush a table and merge its runs to a level of its own; more than `fanout` levels are merged to one."""
        k = len(self.docs)
        self.docs.append(docs.select("doc_id", "text"))
        self.runs.append(self._flush(k))
        first = F.struct(F.col("rows")[0].alias("row"), F.lit(k).alias("table"), F.col("memtable"))
        entries = self.runs[-1].select("digest", first.alias("best"), F.size("rows").cast("long").alias("group_size"))
        self.levels.append(self._merge(entries, f"level-{k}"))
        if len(self.levels) > self.fanout:
            self.compact()

    def compact(self) -> Level:
        """All levels as one."""
        if len(self.levels) > 1:
            entries = self.levels[0].table
            for level in self.levels[1:]:
                entries = entries.unionByName(level.table)
            self.levels = [self._merge(entries, f"compacted-{len(self.docs)}")]
        return self.levels[0]

    def _digested(self, k: int, *columns: Column | str) -> DataFrame:
        return self.docs[k].select(*columns, self.normal(F.col("text")).alias("normal")).withColumn("digest", self.digest(F.col("normal")))

    def _flush(self, k: int) -> DataFrame:
        rows = self._digested(
            k,
            F.shiftright(F.monotonically_increasing_id(), self.bits).alias("memtable"),
            F.struct((-F.coalesce(F.length("text"), F.lit(0))).alias("minus_points"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")).alias("row"),
        ).select("memtable", "digest", "row")
        runs = rows.repartition("memtable").groupBy("memtable", "digest").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        return self.scratch.table(runs.sortWithinPartitions("digest"), f"runs-{k}")

    def _merge(self, entries: DataFrame, name: str) -> Level:
        merged = entries.groupBy("digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        table = self.scratch.table(merged.sortWithinPartitions("digest"), name)
        return Level(table, Filter(table, table.count(), self.scratch, f"{name}-filter"))

    def lookup(self, digests: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The digests (digest) that the index has, and for each level those its filter let pass: only these are joined with it."""
        asked = [level.filter.passes(digests.select("digest").distinct()).filter("passed").drop("passed") for level in self.levels]
        found = [rows.join(level.table.select("digest"), "digest", "left_semi") for rows, level in zip(asked, self.levels, strict=True)]
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out.distinct(), asked

    def contains(self, texts: DataFrame) -> DataFrame:
        """The rows of texts (text, ...) whose normalised text the index has, by digest. Texts may repeat and have any other columns."""
        (name,) = fresh(texts, "own_digest")
        own = texts.withColumn(name, self.digest(self.normal(F.col("text"))))
        known, _ = self.lookup(own.select(F.col(f"`{name}`").alias("digest")))
        return own.join(known.select(F.col("digest").alias(name)), name, "left_semi").drop(name)

    def _collided(self, hits: DataFrame, n: int, held: Filter) -> DataFrame | None:
        """Hits that stand for more than one text (None if there is none)."""
        keys = F.broadcast(hits) if n <= BROADCAST_ROWS else hits
        texts = None
        for k in range(len(self.docs)):
            # The filter stands before the join: texts that can't be hits are not shuffled.
            own = held.passes(self._digested(k)).filter("passed").join(keys, "digest", "left_semi").select("digest", "normal")
            texts = own if texts is None else texts.union(own)
        # Grouping by the bytes themselves combines copies before the shuffle, so no group gathers in one task.
        distinct = texts.groupBy("digest", "normal").agg(F.lit(1).alias("one"))
        several = distinct.groupBy("digest").agg(F.count("one").alias("texts")).filter("texts > 1").select("digest")
        several = self.scratch.table(several, f"collided-{len(self.docs)}")
        return None if several.isEmpty() else several

    def groups(self) -> DataFrame:
        """Every row of all tables: doc_id, keep_id, group_size, kept, digest."""
        level = self.compact()
        hits = level.table.filter("group_size > 1")
        hits = self.scratch.table(hits.select("digest", F.col("best.row.doc_id").alias("keep_id"), F.col("best.table").alias("keep_table"), F.col("best.memtable").alias("keep_run"), "group_size"), f"hits-{len(self.docs)}")
        n, rows = hits.agg(F.count("*"), F.coalesce(F.sum("group_size"), F.lit(0))).head()
        runs = None
        for k, run in enumerate(self.runs):
            own = run.withColumn("table", F.lit(k))
            runs = own if runs is None else runs.unionByName(own)
        if not n:
            return self._alone(runs)
        held = Filter(hits.select("digest"), n, self.scratch, f"hits-filter-{len(self.docs)}")
        collided = self._collided(hits.select("digest"), n, held)
        met = held.passes(runs)
        hot = hot_keys(hits.select("digest", F.col("group_size").alias("n")), rows, self.scratch, f"hot-{len(self.docs)}")
        joined = keyed_join(met.filter("passed").drop("passed"), hits, "digest", hot, "left")
        # What the filter let pass in error is met by no hit.
        alone = self._alone(met.filter("not passed").drop("passed").unionByName(joined.filter("group_size IS NULL").select(*runs.columns)))
        joined = joined.filter("group_size IS NOT NULL")
        if collided is not None:
            joined = joined.join(collided, "digest", "left_anti")
        here = (F.col("memtable") == F.col("keep_run")) & (F.col("table") == F.col("keep_table"))
        rows = joined.select("digest", "keep_id", "group_size", here.alias("here"), F.posexplode("rows"))
        out = rows.select(F.col("col.doc_id").alias("doc_id"), "keep_id", "group_size", (F.col("here") & (F.col("pos") == 0)).alias("kept"), "digest").unionByName(alone)
        return out if collided is None else out.unionByName(self._by_text(collided))

    @staticmethod
    def _alone(runs: DataFrame) -> DataFrame:
        """Rows that are their own groups."""
        row = F.col("rows")[0]["doc_id"]
        return runs.select(row.alias("doc_id"), row.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")

    def _by_text(self, collided: DataFrame) -> DataFrame:
        """The groups by the texts themselves, for rows whose digest stands for several texts."""
        rows = None
        for k in range(len(self.docs)):
            rank = F.struct((-F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.lit(k).alias("table"), F.monotonically_increasing_id().alias("row"))
            own = self._digested(k, "doc_id", rank.alias("rank")).join(collided, "digest", "left_semi")
            rows = own if rows is None else rows.union(own)
        rows = self.scratch.table(rows, f"by-text-{len(self.docs)}")
        best = rows.groupBy("digest", "normal").agg(F.min("rank").alias("best"), F.count("*").alias("group_size"))
        return rows.join(best, ["digest", "normal"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept"), "digest")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows whose normalised text another row has that ranks before (see DigestIndex); columns may have any names.

    Rows are told apart by doc_id. Where doc_ids repeat, by doc_id and digest, and of rows equal in both the
    one stays that comes first in the order of all its columns as JSON.
    """
    index = DigestIndex(docs)
    groups = index.groups()
    by_id, by_digest, own, place = fresh(docs, "kept_id", "kept_digest", "own_digest", "own_place")
    gone = index.scratch.table(groups.filter("not kept").select(F.col("doc_id").alias(by_id)), "gone")
    ids = index.runs[0].select(F.explode("rows.doc_id").alias("id"))
    if ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
        return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(by_id)), "left_anti")
    kept = groups.filter("kept").select(F.col("doc_id").alias(by_id), F.col("digest").alias(by_digest))
    rows = docs.withColumn(own, sha256(without_space(F.col("text"))))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(by_id)) & (F.col(own) == F.col(by_digest)), "left_semi")
    names = [f"`{c}`" for c in docs.columns]
    # One row of each doc_id and digest: the struct of a row's columns, least by their text.
    whole = F.struct(F.to_json(F.struct(*names)).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = index.scratch.table(rows.withColumn(place, whole), "rows")
    first = rows.groupBy(F.col("doc_id").alias(by_id), F.col(own).alias(by_digest)).agg(F.min(place).alias("first_place"))
    return rows.join(first.select(F.col("first_place.row").alias("first_row")), F.col(f"{place}.row") == F.col("first_row"), "left_semi").select(*names)
