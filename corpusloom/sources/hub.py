"""A data source for collections of public datasets, as a hub serves them: named sets with a subset for each language.

A hub is a folder (on any store that Arrow opens) of `repo/subset/…` files of JSON lines. Sets are given as
specifications; one that can't be read gets a status and the reason, and the others are read.
"""

from __future__ import annotations

import fnmatch
import gzip
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamReader

from corpusloom.session import ship
from corpusloom.sources.ranges import _Forward, batches, lines_between, listed, opened, text

#: Files are read in windows of so many bytes.
WINDOW = 64 << 20


@dataclass
class Spec:
    """A set: where it is, how its subset is named (a folder, a named configuration, or a pattern of file names with {code} in it), and the code of each language that it has."""

    name: str
    repo: str
    codes: dict[str, str]
    mode: str = "config"
    pattern: str = "{code}"
    text: str = "text"
    gated: bool = False
    needs_trust: bool = False


@dataclass
class Resolved:
    spec: Spec
    status: str
    error: str | None = None
    subset: str | None = None
    files: list[tuple[str, int]] = field(default_factory=list)


def resolve(root: str, spec: Spec, language: str, accepted: set[str], trust: bool) -> Resolved:
    """What of a set would be read, or why nothing: no such language, terms not accepted, code not trusted, nothing there."""
    code = spec.codes.get(language)
    if code is None:
        return Resolved(spec, "unavailable_for_language")
    subset = spec.pattern.format(code=code)
    if spec.gated and spec.repo not in accepted:
        return Resolved(spec, "load_failed", "gated: accept the terms of this set and log in", subset)
    if spec.needs_trust and not trust:
        return Resolved(spec, "load_failed", "needs trust_remote_code", subset)
    base = f"{root.rstrip('/')}/{spec.repo}"
    if spec.mode == "data_files":
        files = [f for f in listed(base) if fnmatch.fnmatch(f[0].split(f"/{spec.repo}/", 1)[1], subset)]
    else:
        files = listed(f"{base}/{subset}")
    files = [f for f in files if f[0].endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz"))]
    return Resolved(spec, "ok", None, subset, files) if files else Resolved(spec, "load_failed", "not found: the set or its subset is named otherwise", subset)


@dataclass
class Piece(InputPartition):
    source: str
    repo: str
    subset: str
    text: str
    path: str
    start: int
    end: int


class _Options:
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.root, self.language = low["path"], low["language"]
        self.specs = [Spec(**s) for s in json.loads(low["specs"])]
        self.accepted, self.trust = set(filter(None, low.get("accepted", "").split(","))), low.get("trust", "false") == "true"
        self.least, self.report = int(low.get("minchars", 200)), low.get("report", "false") == "true"

    def resolved(self) -> list[Resolved]:
        return [resolve(self.root, s, self.language, self.accepted, self.trust) for s in self.specs]

    def pieces(self, known: dict[str, int] | None = None, upto: dict[str, int] | None = None) -> list[InputPartition]:
        """What there is beyond the known bytes of each file, up to given ones. Compressed files are read whole, once."""
        out: list[InputPartition] = []
        for r in self.resolved():
            for path, size in r.files:
                start, end = (known or {}).get(path, 0), size if upto is None else upto.get(path, 0)
                windows = [(0, -1)] if path.endswith(".gz") else [(a, min(a + WINDOW, end)) for a in range(start, end, WINDOW)]
                out += [Piece(r.spec.name, r.spec.repo, r.subset or "", r.spec.text, path, a, b) for a, b in windows if end > start]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source", pa.string()), ("repo", pa.string()), ("subset", pa.string()), ("text", pa.string())])

        def rows() -> Iterator[tuple[str, str, str, str]]:
            with opened(piece.path) as f:
                found = lines_between(_Forward(gzip.GzipFile(fileobj=f)), 0, 1 << 62) if piece.end < 0 else lines_between(f, piece.start, piece.end)
                for _, line in found:
                    try:
                        record = json.loads(text(line))
                    except ValueError:
                        continue
                    value = record.get(piece.text) if isinstance(record, dict) else None
                    if isinstance(value, str) and len(value := value.strip()) >= self.least:
                        yield piece.source, piece.repo, piece.subset, value

        if piece.path:
            yield from batches(rows(), schema)


class Hub(DataSource):
    """Options: path (the hub), specs (a JSON list of specifications), language, accepted (repos whose terms are, by commas), trust, minChars (200), report.

    Rows are source, repo, subset, text; texts are trimmed, and shorter ones left out. With report they are
    source, status, error, files, one for each set.
    """

    @classmethod
    def name(cls) -> str:
        return "hub"

    def schema(self) -> str:
        return "source string, status string, error string, files long" if _Options(dict(self.options)).report else "source string, repo string, subset string, text string"

    def reader(self, schema: object) -> DataSourceReader:
        return HubReader(_Options(dict(self.options)))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return HubStream(_Options(dict(self.options)))


class HubReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Piece("", "", "", "", "", 0, 0)] if self.options.report else self.options.pieces() or [Piece("", "", "", "", "", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch | tuple]:
        if self.options.report:
            yield from ((r.spec.name, r.status, r.error, len(r.files)) for r in self.options.resolved())
        else:
            yield from self.options.read(piece)


class HubStream(DataSourceStreamReader):
    """Offsets are the bytes known of each file, so what is appended to files in whole lines, and new files, come with the next batch."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: size for r in self.options.resolved() for path, size in r.files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.options.pieces(start, end)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        yield from self.options.read(piece)


def _given(reader, root: str, specs: list[Spec], language: str, options: dict[str, str | int]):  # noqa: ANN001, ANN202
    return reader.format("hub").options(path=root, specs=json.dumps([asdict(s) for s in specs]), language=language, **options)


def read_hub(spark: SparkSession, root: str, specs: list[Spec], language: str, **options: str | int) -> DataFrame:
    """The texts of all sets that can be read."""
    ship(spark)
    spark.dataSource.register(Hub)
    return _given(spark.read, root, specs, language, options).load()


def hub_report(spark: SparkSession, root: str, specs: list[Spec], language: str, **options: str | int) -> DataFrame:
    """source, status, error, files of each set."""
    return read_hub(spark, root, specs, language, **options | {"report": "true"})


def stream_hub(spark: SparkSession, root: str, specs: list[Spec], language: str, **options: str | int) -> DataFrame:
    """The texts as a stream."""
    ship(spark)
    spark.dataSource.register(Hub)
    reader: DataStreamReader = spark.readStream
    return _given(reader, root, specs, language, options).load()
