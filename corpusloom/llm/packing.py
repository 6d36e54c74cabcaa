"""Packing by concatenate and cut.

One pass encodes the documents and writes, beside each document's ids, where it starts among the ids of its
partition. The prefix sum over the partitions' totals gives every partition its place in one long row of
ids, and a second pass cuts that row at fixed places: a document that lies across a cut leaves one boundary
record on each side. Every sequence but the last is full, so nothing else is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, lean, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, encode: Callable[[list[str | None]], tuple[list[bytes], str]], scratch: Scratch) -> DataFrame:
    """doc_id, part, start (in that part), n_tokens, width (bytes of an id), ids: a written table, in scan order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            found, kind = encode(batch.column("text").to_pylist())
            width = np.dtype(kind).itemsize
            sizes = np.array([len(x) for x in found], dtype=np.int64) // width
            ends = at + np.cumsum(sizes)
            rows = len(found)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "part": pa.array([part] * rows, pa.int32()), "start": ends - sizes, "n_tokens": sizes, "width": pa.array([width] * rows, pa.int32()), "ids": pa.array(found, pa.binary())})
            at = int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.table(rows.mapInArrow(lean(run), "doc_id long, part int, start long, n_tokens long, width int, ids binary"), "tokens")


def pack(docs: DataFrame, encode: Callable[[list[str | None]], tuple[list[bytes], str]], length: int = 4096, ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text): one row for each document and sequence that it touches.

    start and length count ids in the document, offset in the sequence. With ids, each piece carries its own.
    Null texts are encoded as empty ones; what encode appends (an end id) still makes a piece. A document
    without any id has no piece. Repeated rows are packed as often as they come.
    """
    tokens = tokenized(docs, encode, Scratch(docs.sparkSession, "pack"))
    # One row for each partition of the scan: bounded by the number of tasks.
    totals = sorted(tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).collect())
    bases = dict(zip([r.part for r in totals], accumulate((r.n for r in totals), initial=0), strict=False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            out: list[tuple] = []
            for doc, part, start, n, width, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "start", "n_tokens", "width", "ids")), strict=True):
                wide = memoryview(np.frombuffer(data, dtype=f"<u{width}").astype("<u4").tobytes())
                first = begin = bases[part] + start
                while begin < first + n:
                    end = min(first + n, (begin // length + 1) * length)
                    piece = wide[4 * (begin - first) : 4 * (end - first)]
                    out.append((doc, begin - first, end - begin, zlib.crc32(piece), n, begin // length, begin % length, *([np.frombuffer(piece, "<u4").tolist()] if ids else [])))
                    begin = end
            names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * ids
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if k == "ids" else pa.int64()) for k, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    return tokens.mapInArrow(lean(cut), PIECES + ", ids array<long>" * ids)


def sequences(pieces: DataFrame, length: int = 4096, pad: int = 0) -> DataFrame:
    """The packed sequences themselves (sequence_id, n_tokens, ids), from pieces with ids.

    Each group is bounded by `length` ids. A sequence is padded to `length` unless its own number of ids is
    a power of two.
    """
    rows = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids").cast("long")
    full = n.bitwiseAND(n - 1) == 0
    return rows.select("sequence_id", n.alias("n_tokens"), F.when(full, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), (F.lit(length) - n).cast("int")))).alias("ids"))
