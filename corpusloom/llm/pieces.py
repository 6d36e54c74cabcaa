"""SentencePiece encoding with byte offsets into the original text, and decoding.

The library gives the ids. Beside it, the text is normalised here as the model says, by longest-prefix
matches in its compiled character map (a double array, then the replacements as zero-ended strings), and
every normalised byte remembers the original byte it came from. A piece's share of the normalised text thus
becomes a span of bytes in the original.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, slices

SPACE = "▁".encode()
#: Texts longer than this many bytes are encoded in parts, cut at single spaces between words.
PART = 1 << 20


class CharacterMap:
    """The compiled map of a model: a double array over UTF-8 bytes whose values are places in a block of strings."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units, self.strings = np.frombuffer(blob, "<u4", n // 4, 4).tolist(), blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest key that data has at `at`, and its replacement."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        return found and (found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])])


class PieceCodec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.spec, self.suffix = proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.own = sorted((p.piece.encode() for p in proto.pieces if p.type == kind.USER_DEFINED), key=len, reverse=True)
        #: Normalised bytes of each id; -1 where that depends on the text (unknown).
        self.sizes = np.array([1 if p.type == kind.BYTE else -1 if p.type == kind.UNKNOWN else 0 if p.type == kind.CONTROL else len(p.piece.encode()) for p in proto.pieces])
        self.plain = not self.map.units and not self.own and not self.spec.remove_extra_whitespaces and self.spec.escape_whitespaces and self.spec.add_dummy_prefix and not self.suffix
        inside = any("▁" in p.piece.lstrip("▁") for p in proto.pieces)
        self.cuttable = self.plain and not inside

    def _parts(self, text: str) -> list[str]:
        """text, or parts whose ids in turn are the text's: no piece goes on after a space, and the dummy prefix stands for the one that is cut out."""
        if len(text) <= PART or not self.cuttable:
            return [text]
        parts, begin = [], 0
        while len(text) - begin > PART:
            at = text.find(" ", begin + PART)
            while at > 0 and (text[at - 1] in " ▁" or text[at + 1 : at + 2] in ("", " ", "▁")):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            parts.append(text[begin:at])
            begin = at + 1
        return [*parts, text[begin:]]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text (null: empty), without begin or end ids."""
        parts = [self._parts(t or "") for t in texts]
        flat = iter(self.model.encode([p for ps in parts for p in ps], num_threads=1))
        return [ids[0] if len(ids := [next(flat) for _ in ps]) == 1 else sum(ids, []) for ps in parts]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the original byte."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            width = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
            return SPACE + data.replace(b" ", SPACE), np.concatenate([np.zeros(3, np.int64), np.repeat(np.arange(len(data)), width), [len(data)]])
        space = SPACE if self.spec.escape_whitespaces else b" "
        found, at = [], 0
        while at < len(data):
            n, to = self._prefix(data, at)
            found.append((at, at + n, to))
            at += n
        squeeze = self.spec.remove_extra_whitespaces
        while squeeze and found and found[0][2] == b" ":
            found.pop(0)
        if not found:
            return b"", np.zeros(1, np.int64)
        out, align = bytearray(), []

        def add(piece: bytes, begin: int) -> None:
            out.extend(piece)
            align.extend([begin] * len(piece))

        if self.spec.add_dummy_prefix and not self.suffix:
            add(space, found[0][0])
        last = squeeze
        for begin, _, to in found:
            if last:
                to = to.lstrip(b" ")
            for c in to.split(b" ")[0:1]:
                add(c, begin)
            for c in to.split(b" ")[1:]:
                add(space, begin)
                add(c, begin)
            if to:
                last = to.endswith(b" ")
            if not squeeze:
                last = False
        end = len(data)
        while squeeze and out.endswith(space):
            end = align[-len(space)]
            del out[-len(space) :], align[-len(space) :]
        if self.spec.add_dummy_prefix and self.suffix:
            add(space, end)
        return bytes(out), np.array([*align, end])

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        for w in self.own:
            if data.startswith(w, at):
                return len(w), w
        if match := self.map.longest(data, at):
            return match
        n = 1 + sum(data[at] >= x for x in (0xC0, 0xE0, 0xF0))
        return n, data[at : at + n]

    def spans(self, text: str | None, ids: list[int]) -> np.ndarray:
        """An array (pieces, 2): where each piece begins and ends in the text's UTF-8 bytes."""
        text = text or ""
        normal, align = self.normalise(text)
        sizes = self.sizes[np.array(ids, dtype=np.int64)]
        if (sizes < 0).any():
            sizes = np.array([len(p.surface.encode()) if p.id == self.model.unk_id() else self.sizes[p.id] for p in self.model.encode(normal.decode().replace("▁", " ").strip(" "), return_type="proto").pieces])
        ends = np.cumsum(sizes, dtype=np.int64)
        if (int(ends[-1]) if len(ends) else 0) != len(normal):
            raise ValueError("the pieces don't cover the normalised text")
        return np.stack([align[ends - sizes], align[ends]], axis=1)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@functools.cache
def codec(path: str) -> PieceCodec:
    """One codec for each file and worker process."""
    return PieceCodec(path)


def encoded(docs: DataFrame, find: Callable[[], str]) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, ids, begins, ends (of each piece, in the text's UTF-8 bytes) and decoded.

    find gives the model file's path, in each worker. Null texts count as empty, which have no piece and decode
    to the empty text; a null doc_id stays null; repeated rows come out as often as they go in; other columns
    (of any name) are not looked at; an empty table gives none. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(find())
        for batch in slices(batches, "text", rows=128):
            texts = batch.column("text").to_pylist()
            ids = c.encode(texts)
            spans = [c.spans(t, x) for t, x in zip(texts, ids, strict=True)]
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            both = np.concatenate([s.reshape(-1, 2) for s in spans])
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (np.concatenate([np.array(x, np.int32) for x in ids]), both[:, 0].astype(np.int64), both[:, 1].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, pa.array([c.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string")
