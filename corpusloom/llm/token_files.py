"""Token-ID output: flat unsigned integer shards, 64-bit document offsets, and memory-mapped reading.

Documents are ordered by doc_id (null first, rows of equal doc_id by a hash of the text). Every range
partition writes one shard: `N.bin` (ids), `N.doc` (doc_ids as int64) and `N.len` (token counts as uint64).
The prefix sum over the shards' totals gives each shard its base in the whole corpus, and a second pass
turns the counts into `N.idx`: 64-bit offsets of all documents, counted from the start of the corpus.
Shard contents depend on the rows alone, so a task that runs again writes the same files again.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, partitions, slices

#: Stands for a null doc_id in `.doc` files.
NULL_ID = -(1 << 63)


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder given as a URI, or as an absolute path."""
    uri = f"s3://{uri.removeprefix('s3a://')}" if uri.startswith("s3a://") else uri
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def put(fs: pa.fs.FileSystem, path: str, write: Callable) -> None:
    """Write a file under another name and move it into place when it is whole."""
    from pyspark import TaskContext

    context = TaskContext.get()
    other = f"{path}.{context.taskAttemptId() if context else 'driver'}"
    with fs.open_output_stream(other) as out:
        write(out)
    try:
        fs.move(other, path)
    except OSError:  # stores that don't replace files; an earlier attempt left the same one
        fs.delete_file(path)
        fs.move(other, path)


def mapped(fs: pa.fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local."""
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if fs.get_file_info(path).size else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_tokens(docs: DataFrame, to: str, encode: Callable[[list[str | None]], tuple[list[bytes], str]], shards: int | None = None) -> dict:
    """Write docs (doc_id, text) as token files into the shared folder `to`; returns the manifest.

    encode: texts to ids as little-endian unsigned integers, and their dtype ("<u2" or "<u4"). An empty
    table gives shards without tokens. The manifest (dtype, and of each shard its number, documents,
    tokens and base) is bounded by the number of shards and stored as manifest.json.
    """
    spark = docs.sparkSession
    n = shards or partitions(spark)
    fs, path = filesystem(to)
    fs.create_dir(path)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = filesystem(to)
        k = TaskContext.get().partitionId()
        lengths, ids, kind, total = [], [], "<u2", 0

        def tokens(out) -> None:
            nonlocal kind, total
            for batch in slices(batches, "text"):
                found, kind = encode(batch.column("text").to_pylist())
                out.write(b"".join(found))
                sizes = np.array([len(x) for x in found], dtype="<u8") // np.dtype(kind).itemsize
                lengths.append(sizes)
                total += int(sizes.sum())
                ids.append(pa.compute.fill_null(batch.column("doc_id"), NULL_ID).to_numpy().astype("<i8"))

        put(fs, f"{path}/{k}.bin", tokens)
        put(fs, f"{path}/{k}.len", lambda out: [out.write(x.tobytes()) for x in lengths])
        put(fs, f"{path}/{k}.doc", lambda out: [out.write(x.tobytes()) for x in ids])
        yield pa.RecordBatch.from_pydict({"shard": [k], "docs": [sum(map(len, ids))], "tokens": [total], "kind": [kind]})

    text_hash = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id", text_hash).sortWithinPartitions("doc_id", text_hash)
    found = sorted(ordered.mapInArrow(lean(shard), "shard long, docs long, tokens long, kind string").collect())
    bases = accumulate((r.tokens for r in found), initial=0)
    manifest = {"dtype": next((r.kind for r in found if r.tokens), "<u2"), "shards": [{"shard": r.shard, "docs": r.docs, "tokens": r.tokens, "base": b} for r, b in zip(found, bases, strict=False)]}
    put(fs, f"{path}/manifest.json", lambda out: out.write(json.dumps(manifest).encode()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(to)
        base = {s["shard"]: s["base"] for s in manifest["shards"]}
        for batch in batches:
            for k in batch.column("id").to_pylist():
                if k in base:
                    lengths = mapped(fs, f"{path}/{k}.len", "<u8")
                    offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(lengths, dtype="<u8")]) + np.uint64(base[k])
                    put(fs, f"{path}/{k}.idx", lambda out, x=offsets: out.write(x.astype("<u8").tobytes()))
        yield pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64())})

    spark.range(0, n, 1, min(n, 64)).mapInArrow(lean(index), "id long").count()
    return manifest


def read_manifest(source: str) -> dict:
    fs, path = filesystem(source)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, source: str, ids: bool = False) -> DataFrame:
    """The documents in token files: doc_id, start, n_tokens, ids_crc32 (of the ids as uint32) and, if asked for, the ids as an array."""
    manifest = read_manifest(source)
    numbers = [s["shard"] for s in manifest["shards"]]
    n = max(numbers, default=-1) + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(source)
        known = set(numbers)
        for k in (k for batch in batches for k in batch.column("id").to_pylist() if k in known):
            data, offsets, names = mapped(fs, f"{path}/{k}.bin", manifest["dtype"]), mapped(fs, f"{path}/{k}.idx", "<u8").astype("<i8"), mapped(fs, f"{path}/{k}.doc", "<i8")
            base = int(offsets[0])
            for at in range(0, len(names), 1024):
                part = offsets[at : at + 1025]
                cut = [data[a - base : b - base] for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]
                columns = {
                    "doc_id": pa.array(names[at : at + 1024], mask=names[at : at + 1024] == NULL_ID),
                    "start": part[:-1],
                    "n_tokens": np.diff(part),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.array([x.tolist() for x in cut], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return spark.range(0, n, 1, max(1, n)).mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
