"""Subword pieces of a given vocabulary, counted by way of distinct words.

No piece of such a vocabulary goes on after a word mark, so a text's pieces are those of its marked words in
turn. Words are counted first; each distinct word is encoded once, and its ids come back by a join. What is
asked of a corpus (tokens of a class, frequencies of pieces, rates of bytes, round trips) are sums over that
word table; no text is encoded as a whole.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.scratch import Scratch

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: numbers with their values (whole numbers, or the bytes of anything else)."""

    def number(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return n, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_vocabulary(path: str) -> list[tuple[int, str, float, int]]:
    """id, piece, score, kind of a byte-pair piece model with a plain normaliser (no character map, spaces kept and marked, a mark put before the text)."""
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    spec = dict(next(_fields_of(message, 3), []))
    trainer = dict(next(_fields_of(message, 2), []))
    plain = not spec.get(2) and spec.get(3, 1) and not spec.get(4, 1) and spec.get(5, 1) and not trainer.get(24)
    if trainer.get(3, 1) != 2 or not plain:
        raise ValueError("only byte-pair models with a plain normaliser are read")
    rows = []
    for k, fields in enumerate(dict(f) for f in _fields_of(message, 1)):
        rows.append((k, fields[1].decode(), struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0, fields.get(3, NORMAL)))
    if any(MARK in p.lstrip(MARK) or (len(p) > 1 and "\n" in p) or kind == USER for _, p, _, kind in rows):
        raise ValueError("a piece goes beyond a word")
    return rows


def _fields_of(message: list[tuple[int, int | bytes]], number: int) -> Iterator[list[tuple[int, int | bytes]]]:
    return (list(_fields(value)) for n, value in message if n == number)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """id, piece, score, kind, is_byte, is_unknown: one row for each piece, tens of thousands, read by the driver."""
    rows = spark.createDataFrame(read_vocabulary(path), "id int, piece string, score double, kind int")
    return rows.select("*", (F.col("kind") == BYTE).alias("is_byte"), (F.col("kind") == UNKNOWN).alias("is_unknown"))


def merged(word: str, scores: dict[str, float], used: list[str] | None = None) -> list[str]:
    """The parts of a word after all merges: of all neighbours that are a piece together those with the highest score first, the leftmost of equal ones. used takes every piece that was made."""
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    open_: list[tuple[float, int, str, str]] = []

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < len(parts) and (score := scores.get(parts[i] + parts[j])) is not None:
            heapq.heappush(open_, (-score, i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while open_:
        _, i, left, right = heapq.heappop(open_)
        j = after[i]
        if parts[i] != left or j >= len(parts) or parts[j] != right:
            continue
        parts[i], parts[j], after[i] = left + right, None, after[j]
        if used is not None:
            used.append(left + right)
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p is not None]


def marked_words(text: Column) -> Column:
    """The words of a text, each with the marks before it; line ends stand by themselves. An empty or null text has none."""
    marked = F.when(F.coalesce(text, F.lit("")) != "", F.replace(F.concat(F.lit(" "), text), F.lit(" "), F.lit(MARK)))
    return F.coalesce(F.regexp_extract_all(marked, F.lit(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"), F.lit(0)), F.array().cast("array<string>"))


def encoded_words(found: DataFrame, path: str) -> DataFrame:
    """word, ids, n_bytes, n_unknown of found (word; each once): the ids of its pieces and how many of those are bytes or unknown.

    Characters without a piece become bytes where the model has all byte pieces, else one unknown for each row
    of them.
    """
    vocab = read_vocabulary(path)
    scores = {p: s for _, p, s, kind in vocab if kind in (NORMAL, UNUSED)}
    ids = {p: k for k, p, _, kind in vocab if kind in (NORMAL, UNUSED)}
    bytes_ = {int(p[3:-1], 16): k for k, p, _, kind in vocab if kind == BYTE}
    unknown = next((k for k, _, _, kind in vocab if kind == UNKNOWN), 0)

    def encode(word: str) -> tuple[list[int], int, int]:
        out, n_bytes, n_unknown, last = [], 0, 0, False
        for part in merged(word, scores):
            known = ids.get(part)
            if known is not None:
                out.append(known)
            elif len(bytes_) == 256:
                out += [bytes_[b] for b in part.encode()]
                n_bytes += len(part.encode())
            elif not last:
                out.append(unknown)
                n_unknown += 1
            last = known is None
        return out, n_bytes, n_unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = zip(*map(encode, batch.column("word").to_pylist()), strict=True)
                kinds = (pa.list_(pa.int32()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("word"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=["word", "ids", "n_bytes", "n_unknown"])

    return found.select("word").mapInArrow(run, "word string, ids array<int>, n_bytes long, n_unknown long")


def sweep(df: DataFrame, path: str, sizes: tuple[int, ...]) -> DataFrame:
    """vocab_size, words, tokens, fertility, unk_rate, byte_fallback_rate of df (text) under a vocabulary cut to each size.

    A smaller vocabulary of the same merges has the first of them, and all single characters and bytes. The texts
    are read once, for the counts of their words; each distinct word is then encoded with every size, anew only
    where the next larger size made a piece that the smaller one lacks.
    """
    vocab, sizes = read_vocabulary(path), tuple(sorted(sizes, reverse=True))
    own = [(p, s) for _, p, s, kind in vocab if kind in (NORMAL, UNUSED)]
    made, has_bytes = [x for x in own if len(x[0]) > 1], sum(kind == BYTE for *_, kind in vocab) == 256
    turn = {p: k for k, (p, _) in enumerate(made)}
    most = {size: max(0, size - len(vocab) + len(made)) for size in sizes}
    scores = {size: dict([x for x in own if len(x[0]) == 1] + made[: most[size]]) for size in sizes}

    def measure(word: str) -> list[tuple[int, int, int, int]]:
        out, last, row = [], None, None
        for size in sizes:
            if last is None or last >= most[size]:
                used: list[str] = []
                parts, known = merged(word, scores[size], used), scores[size]
                last = max((turn[p] for p in used), default=-1)
                lost = [p for p in parts if p not in known]
                n_bytes = sum(len(p.encode()) for p in lost) if has_bytes else 0
                gaps = 0 if has_bytes else sum(p not in known and (not i or parts[i - 1] in known) for i, p in enumerate(parts))
                row = (len(parts) - len(lost) + n_bytes + gaps, n_bytes, gaps)
            out.append((size, *row))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *m) for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True) for m in measure(word)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["n", "vocab_size", "tokens", "n_bytes", "n_unknown"])

    rows = df.select("text", F.size(words(F.col("text"))).alias("_w")).filter("_w > 0")
    scratch = Scratch(df.sparkSession, "sweep")
    counts = scratch.table(rows.select(F.explode(marked_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    total = lambda c: F.sum(F.col("n") * F.col(c))
    found = counts.mapInArrow(run, "n long, vocab_size long, tokens long, n_bytes long, n_unknown long")
    found = found.groupBy("vocab_size").agg(total("tokens").alias("tokens"), total("n_bytes").alias("f"), total("n_unknown").alias("u"))
    # One row for all texts beside each size.
    worded = rows.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("words"))
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return found.crossJoin(F.broadcast(worded)).select("vocab_size", "words", "tokens", share("tokens", "words").alias("fertility"), share("u", "tokens").alias("unk_rate"), share("f", "tokens").alias("byte_fallback_rate"))


def word_pieces(df: DataFrame, path: str, by: list[str], scratch: Scratch) -> DataFrame:
    """by, word, n, ids, n_bytes, n_unknown: the marked words of df (text) in each group, and what each distinct one is encoded as. A written table."""
    counts = df.select(*by, F.explode(marked_words(F.col("text"))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    counts = scratch.table(counts, "words")
    return scratch.table(counts.join(encoded_words(counts.select("word").distinct(), path), "word"), "encoded")


def piece_totals(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """documents, n_tokens, n_chars, n_bytes by the given columns."""
    tokens = word_pieces(df, path, by, Scratch(df.sparkSession, "pieces")).groupBy(*by).agg(F.sum(F.col("n") * F.size("ids")).alias("n_tokens"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("text")).alias("n_bytes"))
    return _beside(sizes, tokens, by).select(*by, "documents", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "n_chars", "n_bytes")


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with the columns of right, by equal values of by (nulls are equal)."""
    right = right.select(*(F.col(c).alias(f"{c}_") for c in by), *(c for c in right.columns if c not in by))
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row each
    return left.join(right, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by], "left").drop(*(f"{c}_" for c in by))


def piece_frequency(df: DataFrame, path: str) -> DataFrame:
    """token (an id), n: how often each piece stands in df (text), from the counts of words alone."""
    rows = word_pieces(df, path, [], Scratch(df.sparkSession, "pieces"))
    return rows.select("n", F.explode("ids").alias("token")).groupBy("token").agg(F.sum("n").alias("n"))


def piece_measures(df: DataFrame, path: str, by: list[str], least: int = 1) -> DataFrame:
    """documents, tokens, fertility, characters and bytes a token, tokens a document, and the rates of unknown and byte pieces, of texts with a word; of groups only those with enough documents."""
    rows = df.select(*by, "text", F.size(words(F.col("text"))).alias("_w")).filter("_w > 0")
    found = word_pieces(rows, path, by, Scratch(df.sparkSession, "pieces")).groupBy(*by)
    found = found.agg(F.sum(F.col("n") * F.size("ids")).alias("tokens"), F.sum(F.col("n") * F.col("n_unknown")).alias("u"), F.sum(F.col("n") * F.col("n_bytes")).alias("f"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("documents"), F.sum("_w").alias("w"), F.sum(F.length("text")).alias("c"), F.sum(F.octet_length("text")).alias("b")).filter(F.col("documents") >= least)
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return _beside(sizes, found, by).select(
        *by, "documents", "tokens",
        share("tokens", "w").alias("fertility"), share("c", "tokens").alias("chars_per_token"), share("b", "tokens").alias("bytes_per_token"),
        share("tokens", "documents").alias("tokens_per_document"), share("u", "tokens").alias("unk_rate"), share("f", "tokens").alias("byte_fallback_rate"),
    )


def round_trips(df: DataFrame, path: str) -> DataFrame:
    """doc_id, same: whether a text's pieces, put together, are the text again.

    They aren't where a text holds the word mark itself, which comes back as a space, or a word of which a
    character is lost. Words that don't come back are few, and are looked for by a join on words.
    """
    scratch = Scratch(df.sparkSession, "trips")
    vocab = vocabulary(df.sparkSession, path).select(F.col("id").alias("token"), "piece", "is_byte", "is_unknown")
    own = scratch.table(df.select("doc_id", F.explode(F.array_distinct(marked_words(F.col("text")))).alias("word")), "own")
    each = scratch.table(encoded_words(own.select("word").distinct(), path), "each")
    parts = each.select("word", F.posexplode("ids").alias("at", "token")).join(F.broadcast(vocab), "token")
    value = F.when(F.col("is_unknown"), F.unhex(F.lit(""))).when(F.col("is_byte"), F.unhex(F.substring("piece", 4, 2))).otherwise(F.encode("piece", "UTF-8"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.hex(value).alias("v")))), lambda x: x["v"]), "")
    lost = parts.groupBy("word").agg(joined.alias("v")).filter(F.col("v") != F.hex(F.encode("word", "UTF-8"))).select("word")
    bad = own.join(lost, "word", "left_semi").select(F.col("doc_id").alias("_bad")).distinct()
    rows = df.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left")
    return rows.select("doc_id", (F.col("_bad").isNull() & ~F.coalesce(F.col("text").contains(MARK), F.lit(False))).alias("same"))

