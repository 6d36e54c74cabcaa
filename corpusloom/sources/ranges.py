"""Data sources that read parts of files: byte windows of files of lines, and members of zip archives.

Files are opened with Arrow's filesystems, which reach local and shared folders, HDFS and the object stores;
a task reads its own window or members and nothing else of a file.
"""

from __future__ import annotations

import gzip
import io
import itertools
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.session import ship

CHUNK = 4 << 20
#: Rows that are handed on together, at most.
ROWS = 4096


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of all files below a folder (but hidden ones), by name."""
    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True, allow_not_found=True))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    host = path.split("://")[1].split("/")[0] if scheme and not isinstance(fs, pa.fs.LocalFileSystem | pa.fs.S3FileSystem | pa.fs.GcsFileSystem) else ""
    return sorted((f"{scheme}{host}{f.path}", f.size) for f in found if f.type == pa.fs.FileType.File and f.base_name[0] not in "_.")


def opened(path: str) -> BinaryIO:
    fs, at = filesystem(path)
    return fs.open_input_file(at)


def lines_between(f: BinaryIO, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each line that begins in [start, end), without its end.

    The first line of a window is that after the line that its first byte but one belongs to; the last one is
    read to its end, beyond the window, so each line of a file is in just one of its windows.
    """
    at = max(0, start - 1)
    f.seek(at)
    held, partial = b"", start > 0
    while True:
        data = f.read(min(chunk, max(end - at - len(held), 1 << 12)))
        if not data:
            break
        *lines, rest = (held + data).split(b"\n")
        for line in lines:
            if not partial:
                if at >= end:
                    return
                yield at, line
            at, partial = at + len(line) + 1, False
        held = rest
        if at >= end:
            return
    if held and not partial and at < end:
        yield at, held


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of (…, text) as batches that are bounded by rows and by the size of texts."""
    while True:
        held, size = [], 0
        for row in itertools.islice(rows, ROWS):
            held.append(row)
            size += len(row[-1])
            if size > CHUNK:
                break
        if not held:
            return
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


#: So many tasks read windows, at most: neighbours in a file are dealt to one task beyond that, as tasks cost more than windows of some kilobytes.
TASKS = 2000


@dataclass
class Window(InputPartition):
    path: str
    start: int
    end: int
    #: Bytes of each of the windows that the task reads one after the other; 0: one window.
    step: int = 0


class ByteWindows(DataSource):
    """Lines of files (path; a file, a folder, or a JSON list of those) by windows of bytes: path, offset, value.

    windowBytes (64 MB) cuts files into windows that together hold every line once. With windows (a number),
    that many windows begin at equal distances in each file, and only lines that begin in the first takeBytes of
    each are read: a sample of a file that is spread over all of it. Compressed files (.gz) are one window.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_windows"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def reader(self, schema: object) -> DataSourceReader:
        return ByteWindowReader(dict(self.options))


def paths(options: dict[str, str]) -> list[str]:
    given = options["path"]
    return json.loads(given) if given.startswith("[") else [given]


class ByteWindowReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = paths(options)
        low = {k.lower(): v for k, v in options.items()}
        self.size, self.windows, self.take = int(low.get("windowbytes", 64 << 20)), int(low.get("windows", 0)), int(low.get("takebytes", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        out, files = [], [f for p in self.paths for f in listed(p)]
        together = self.size * max(1, -(-sum(-(-size // self.size) for _, size in files) // TASKS))
        for path, size in files:
            if path.endswith(".gz"):
                out.append(Window(path, 0, -1))
            elif self.windows:
                starts = sorted({i * size // self.windows for i in range(self.windows)})
                out += [Window(path, a, min(a + self.take, b)) for a, b in itertools.pairwise([*starts, size]) if b > a]
            else:
                out += [Window(path, a, min(a + together, size), self.size) for a in range(0, size, together)]
        return out or [Window("", 0, 0)]

    def read(self, window: Window) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("value", pa.string())])
        if not window.path:
            return
        with opened(window.path) as f:
            if window.end < 0:
                found = lines_between(_Forward(gzip.GzipFile(fileobj=f)), 0, 1 << 62)
            else:
                step = window.step or max(1, window.end - window.start)
                starts = range(window.start, window.end, step)
                found = (x for a in starts for x in lines_between(f, a, min(a + step, window.end)))
            yield from batches(((window.path, at, text(line)) for at, line in found), schema)


class _Forward:
    """A stream that is read from its start on and never goes back."""

    def __init__(self, f: BinaryIO):
        self.read = f.read

    def seek(self, at: int) -> None:
        if at:
            raise ValueError("a compressed file is read from its start")


def read_windows(spark: SparkSession, path: str | list[str], **options: int) -> DataFrame:
    """path, offset, value of files of lines; options as ByteWindows has them."""
    ship(spark)
    spark.dataSource.register(ByteWindows)
    return spark.read.format("byte_windows").options(path=path if isinstance(path, str) else json.dumps(path), **options).load()


def read_budget(spark: SparkSession, path: str | list[str], chars: int, windows: int = 200) -> DataFrame:
    """path, offset, value of so much of files of lines that about `chars` characters can be kept of each.

    A kept character is reckoned at 4 bytes (of text, structure and rejected records). Files of more than half as
    much again are read by windows spread over all of them, so that a file put together of several sources is
    sampled, not its first one read; smaller ones and compressed ones are read whole.
    """
    need = 4 * chars
    files = [f for p in ([path] if isinstance(path, str) else path) for f in listed(p)]
    large = [f for f, size in files if size > 1.5 * need and not f.endswith(".gz")]
    small = [f for f, _ in files if f not in set(large)]
    parts = ([read_windows(spark, large, windows=windows, takeBytes=max(1, need // windows))] if large else []) + ([read_windows(spark, small)] if small else [])
    return parts[0].union(parts[1]) if len(parts) == 2 else parts[0] if parts else spark.createDataFrame([], "path string, offset long, value string")


# --- archives ---

MEMBERS = (".jsonl", ".json", ".jsonl.gz", ".txt")


@dataclass
class Members(InputPartition):
    path: str
    names: list[str]


class ZipMembers(DataSource):
    """Lines of the .jsonl, .json, .jsonl.gz and .txt members of zip files (path as for byte windows): path, member, line, value.

    Only the directory at an archive's end is read to plan; members are dealt to tasks by their packed sizes, up
    to partitionBytes (32 MB) each, and their lines are streamed. Blank lines are left out; what is no zip file
    has no line.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "path string, member string, line long, value string"

    def reader(self, schema: object) -> DataSourceReader:
        return ZipReader(dict(self.options))


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = paths(options)
        self.size = int({k.lower(): v for k, v in options.items()}.get("partitionbytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in (f for p in self.paths for f, _ in listed(p) if f.lower().endswith(".zip") or f == p):
            try:
                with opened(path) as f, zipfile.ZipFile(f) as z:
                    infos = [i for i in z.infolist() if i.filename.lower().endswith(MEMBERS)]
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # too small to have a directory, or none
                continue
            names, held = [], 0
            for info in sorted(infos, key=lambda i: i.header_offset):
                if names and held + info.compress_size > self.size:
                    out.append(Members(path, names))
                    names, held = [], 0
                names.append(info.filename)
                held += info.compress_size
            if names:
                out.append(Members(path, names))
        return out or [Members("", [])]

    def read(self, part: Members) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("value", pa.string())])
        if not part.names:
            return
        with opened(part.path) as f, zipfile.ZipFile(f) as z:
            for name in part.names:
                with z.open(name) as packed:
                    plain = io.BufferedReader(gzip.GzipFile(fileobj=packed)) if name.lower().endswith(".gz") else packed
                    rows = ((part.path, name, i, text(line.removesuffix(b"\n"))) for i, line in enumerate(plain) if line.strip())
                    yield from batches(rows, schema)


def read_archives(spark: SparkSession, path: str | list[str], **options: int) -> DataFrame:
    """path, member, line, value of the members of zip files; options as ZipMembers has them."""
    ship(spark)
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(path=path if isinstance(path, str) else json.dumps(path), **options).load()
