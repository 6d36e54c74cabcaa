"""Exact token counts at every prefix of a text, by dynamic programming over its words.

Byte-pair encoding has one property that makes prefixes cheap: a row of tokens is what the merges give for
their bytes exactly if each two neighbours are what the merges give for the bytes of those two. So each
prefix of a word is known by the last token of its encoding and the count: the last token is the one that
ends there and stays apart from the last token of the prefix before it. Counts of all prefixes of a text
are kept as the number that each code point adds (often 0, at times negative, as a letter may let tokens
merge). From those, the count of a text, the longest prefix within a budget and the place where a corpus
uses up a budget are sums; nothing is encoded again.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, lean, slices
from corpusloom.llm.running import running

#: The pre-tokenizer that the scan below follows; a file with another is refused.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER, LONE, CLOSED = range(6)
#: After an apostrophe: letters that close a contraction, and those that need one more.
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}
#: Words whose pre-tokens are found by a pattern: these letters never compose with what stands before them, and neither apostrophes nor special tokens are among the marks.
PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+").fullmatch
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+").findall
NEVER = 1 << 40
#: White space in ASCII parts words; each such character is a step of 0.
BLANKS = "\t\n\x0b\x0c\r"


def _byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.cache
def _composes(c: str) -> bool:
    """May normal form C join or reorder c with what stands before it?"""
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) > 0 or c in _seconds() or first in _seconds()


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters that stand second in a canonical decomposition, and the Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x30000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


class _Words(dict):
    """Steps of words met before, in two generations."""

    def __init__(self, make: Callable[[str], bytes | None], most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> bytes | None:
        found = self.old[word] if word in self.old else self.make(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class PrefixCounter:
    """Counts as the tokenizers library gives them with the file's defaults (strings of special tokens are those tokens), without added ids."""

    def __init__(self, path: str, words: int = 250_000):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or split["pattern"]["Regex"] != PATTERN or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("prefix counts need byte-level BPE with the word pattern above")
        library = Tokenizer.from_file(path)
        self.normal, self.split = functools.cache(library.normalizer.normalize_str), library.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(sorted((re.escape(t["content"]) for t in spec["added_tokens"]), key=len, reverse=True)) or r"(?!)")
        self._load(model)
        self.longest = max(map(len, [*self.inner, *self.final]))
        #: Finds all tokens that end at each byte: (length, id inside a word or -1, id at its end or -1).
        self.tokens = ahocorasick.Automaton()
        for b in {*self.inner, *self.final}:
            self.tokens.add_word(b.decode("latin-1"), (len(b), self.inner.get(b, -1), self.final.get(b, -1)))
        self.tokens.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self._word, words)

    def _load(self, model: dict) -> None:
        """Tokens by their bytes: inside a word and at its end. Only tokens that the merges make of their own bytes count."""
        ids, end, byte = model["vocab"], model["end_of_word_suffix"], _byte_alphabet()
        self.rank, self.parts, self.merges = [-1] * (max(ids.values()) + 1), {}, {}
        for k, (a, b) in enumerate(model["merges"]):
            a, b, made = ids[a], ids[b], ids[a + b]
            if made in self.parts or max(self.rank[a], self.rank[b]) >= k:
                raise ValueError("merges must make new tokens, in order")
            self.rank[made], self.parts[made], self.merges[a, b] = k, (a, b), k
        whole: set[int] = set()
        for t in sorted(ids.values(), key=self.rank.__getitem__):
            if t not in self.parts or (whole.issuperset(self.parts[t]) and self._stay_apart(*self.parts[t], below=True)):
                whole.add(t)
        self.inner, self.final = {}, {}
        for s, t in ids.items():
            if t in whole:
                last = s.endswith(end)
                (self.final if last else self.inner)[bytes(byte[c] for c in (s[: -len(end)] if last else s))] = t

    def _stay_apart(self, a: int, b: int, below: bool = False) -> bool:
        """Do the merges give a and b for their bytes together? (below: but for the merge of a and b themselves.)

        Merges go by rank, and from the left within one. Walking back in time, the symbols at the border are a
        and b, then the parts next to the border of whichever was made last. Each two that stand there at one
        time must not merge before either goes into another symbol.
        """
        rank, merges, parts = self.rank, self.merges, self.parts
        a_goes = b_goes = NEVER
        while True:
            m = merges.get((a, b), NEVER)
            if m < a_goes and m <= b_goes and not below:
                return False
            below = False
            if rank[a] > rank[b]:
                a_goes, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                b_goes, b = rank[b], parts[b][0]
            else:
                return True

    def _apart(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            found = self.pairs[key] = self._stay_apart(a, b)
        return found

    def _grow(self, data: bytes, last: list[int], count: list[int]) -> None:
        """Extend last and count, which hold the last token and the count of each prefix of data, over all of data."""
        inner, apart, longest = self.inner.get, self._apart, self.longest
        for i in range(len(last), len(data) + 1):
            for j in range(max(0, i - longest), i):
                t = inner(data[j:i])
                if t is not None and (not j or apart(last[j], t)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break

    def _ended(self, data: bytes, i: int, last: list[int], count: list[int]) -> int:
        """The count of data[:i] as a whole word."""
        final, apart = self.final.get, self._apart
        for j in range(max(0, i - self.longest), i):
            t = final(data[j:i])
            if t is not None and (not j or apart(last[j], t)):
                return count[j] + 1
        raise ValueError("no token ends here")

    def _run(self, run: str) -> list[int]:
        """The count of each prefix of one pre-token: at each byte, the one token that stays apart from the last token before it."""
        data = run.encode()
        size, pairs, apart = len(data) + 1, self.pairs, self._apart
        last, count, ended = [-1] * size, [0] * size, [0] * size
        for end, (n, inner, final) in self.tokens.iter(data.decode("latin-1")):
            i = end + 1
            j = i - n
            before = last[j]
            if inner >= 0 and not count[i] and (not j or ((ok := pairs.get(before << 20 | inner)) is None and apart(before, inner)) or ok):
                last[i], count[i] = inner, count[j] + 1
            if final >= 0 and not ended[i] and (not j or ((ok := pairs.get(before << 20 | final)) is None and apart(before, final)) or ok):
                ended[i] = count[j] + 1
        return ended[1:] if len(data) == len(run) else [e for e, b in zip(ended[1:], data[1:] + b"a", strict=True) if b & 192 != 128]

    def _word(self, word: str) -> bytes | None:
        """What each code point of a word without ASCII white space adds, as signed bytes (None if one doesn't fit)."""
        try:
            if not PLAIN(word):
                return array("b", self.wide(word)).tobytes()
            runs = RUNS(word)
            if len(runs) > 1:
                return None if None in (found := [self.words[r] for r in runs]) else b"".join(found)
            counts = self._run("".join(map(str.lower, word)))
            return array("b", map(int.__sub__, counts, [0, *counts[:-1]])).tobytes()
        except OverflowError:
            return None

    @functools.cache  # noqa: B019 (one counter lives in a worker)
    def kind(self, c: str) -> int:
        """The class of a normalised character, as the library's pattern has it."""
        if not (after := self.split(f"a{c}"))[1:]:
            return SPACE if after[0][1][1] == 1 else LETTER
        return NUMBER if self.split(f"!{c}")[1:] else OTHER

    def wide(self, word: str) -> list[int]:
        """The steps of any text, by a scan that keeps the state of the word at hand."""
        scan, out, before, at = _Scan(self), [], 0, 0

        def step(n: int) -> None:
            nonlocal before
            out.append(n - before)
            before = n

        def ordinary(piece: str) -> None:
            nonlocal scan
            i = 0
            while i < len(piece):
                j = i + 1
                while j < len(piece) and _composes(piece[j]):
                    j += 1
                start = scan
                for k in range(i + 1, j + 1):
                    scan = start.copy() if j > i + 1 else start
                    for c in self.normal(piece[i:k]):
                        scan.push(c)
                    step(scan.tokens())
                i = j

        for match in self.special.finditer(word):
            ordinary(word[at : match.start()])
            done = before
            ordinary(match[0][:-1])
            step(done + 1)
            scan, at = _Scan(self, done + 1), match.end()
        ordinary(word[at:])
        return out

    def steps(self, text: str | None) -> tuple[bytes, int]:
        """How many tokens each code point of text adds, as little-endian signed integers, and the bytes of one (1, or 4 where one doesn't fit)."""
        text = text or ""
        for c in BLANKS:
            text = text.replace(c, " ")
        if text.isascii() and not self.special.search(text):
            text = text.lower()
        words = text.split(" ")
        found = list(map(self.words.__getitem__, words))
        if None not in found:
            return b"\0".join(found), 1
        wide = [np.array(self.wide(w) if s is None else np.frombuffer(s, np.int8), "<i4") for w, s in zip(words, found, strict=True)]
        return b"\0\0\0\0".join(w.tobytes() for w in wide), 4


class _Scan:
    """A prefix of a text: the tokens of finished pre-tokens, and the last token and count at each byte of the open one."""

    def __init__(self, owner: PrefixCounter, done: int = 0):
        self.owner, self.done, self.kind, self.waits = owner, done, SPACE, ""
        self.data, self.last, self.count = b"", [-1], [0]

    def copy(self) -> _Scan:
        new = _Scan(self.owner, self.done)
        new.kind, new.waits, new.data, new.last, new.count = self.kind, self.waits, self.data, list(self.last), list(self.count)
        return new

    def tokens(self) -> int:
        return self.done + (self.owner._ended(self.data, len(self.data), self.last, self.count) if self.data else 0)

    def _open(self, kind: int) -> None:
        self.done, self.kind, self.data, self.last, self.count = self.tokens(), kind, b"", [-1], [0]

    def _add(self, c: str) -> None:
        self.data += c.encode()
        self.owner._grow(self.data, self.last, self.count)

    def push(self, c: str) -> None:
        kind, waits, self.waits = self.owner.kind(c), self.waits, ""
        if self.kind == LONE and c in SHORT:
            self.kind = CLOSED
        elif self.kind == LONE and c in LONG:
            self._open(LETTER)
            self.waits = c
        elif waits and c == LONG[waits]:
            # The apostrophe and the letter were two; with this one the three are one pre-token.
            apostrophe = _Scan(self.owner)
            apostrophe._add("'")
            self.done, self.data = self.done - apostrophe.tokens(), b""
            self._open(CLOSED)
            self._add(f"'{waits}")
        elif self.kind == LONE and kind == OTHER:
            self.kind = OTHER
        elif kind != self.kind or kind not in (LETTER, OTHER):
            self._open(LONE if c == "'" else kind)
        if kind != SPACE:
            self._add(c)


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One counter for each file and worker process."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, find: Callable[[], str]) -> DataFrame:
    """The counts of all prefixes of every row of docs (doc_id, text): doc_id, n_bytes, width, steps.

    steps holds, for each code point of the text, the tokens that it adds, as little-endian signed integers of
    width bytes: the count of a prefix is the sum of its steps. find gives the tokenizer's file in each worker.
    Null texts count as empty; a null doc_id stays null; repeated rows come out as often as they go in; other
    columns (of any name) are not looked at; an empty table gives none. Texts of any length are scanned whole,
    in time proportional to their length but for a base with very many combining marks (the square of those).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(find())
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            found = [c.steps(t) for t in texts.to_pylist()]
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array([w for _, w in found], pa.int32()), pa.array([s for s, _ in found], pa.binary())], names=["doc_id", "n_bytes", "width", "steps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_bytes long, width int, steps binary")


def within(prefixes: DataFrame, limit: int) -> DataFrame:
    """prefixes with n_tokens, over_limit, cut_chars and cut_tokens in place of width and steps: each text's count, and its longest prefix of at most `limit` tokens with that prefix's count.

    A prefix may have more tokens than a longer one, so the longest that fits isn't always the one before the first
    that doesn't. Other columns stay.
    """
    others = [c for c in prefixes.columns if c not in ("width", "steps")]

    def answer(width: int, data: pa.Scalar) -> tuple[int, bool, int, int]:
        steps = np.frombuffer(data.as_buffer(), f"<i{width}")
        n = int(steps.sum(dtype=np.int64))
        if n <= limit:
            return n, False, len(steps), n
        counts = np.cumsum(steps, dtype=np.int64)
        fits = np.flatnonzero(counts <= limit)
        return (n, True, int(fits[-1]) + 1, int(counts[fits[-1]])) if len(fits) else (n, True, 0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "steps"):
            found = zip(*map(answer, batch.column("width").to_pylist(), batch.column("steps")), strict=True)
            columns = [pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], names=[*others, "n_tokens", "over_limit", "cut_chars", "cut_tokens"])

    types = dict(prefixes.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in others) + ", n_tokens long, over_limit boolean, cut_chars long, cut_tokens long"
    return prefixes.mapInArrow(lean(run), schema)


def spend(prefixes: DataFrame, budget: int) -> DataFrame:
    """Documents in the order of doc_id (null first) until `budget` tokens are used up: doc_id, start, n_tokens, taken, cut_chars.

    start counts the tokens of all documents before. A document that fits whole is taken whole; the first that
    doesn't is cut to the longest prefix that does (taken tokens, cut_chars code points); those after it take
    none. Rows of one doc_id go by a hash of their steps. Totals come from range partitions and prefix sums over
    them; the one document at the border is looked up by itself.
    """
    scratch = Scratch(prefixes.sparkSession, "spend")
    stored = scratch.table(prefixes.select("doc_id", "width", "steps", F.xxhash64("width", "steps").alias("tie")), "prefixes")
    placed = running(within(stored, budget), ["doc_id", "tie"], ["n_tokens"], scratch, "placed")
    placed = placed.withColumn("start", F.col("run_n_tokens") - F.col("n_tokens"))
    border = placed.filter((F.col("start") < budget) & (F.col("run_n_tokens") > budget)).head()
    chars, tokens = 0, 0
    if border:
        own = stored.filter(F.col("doc_id").eqNullSafe(F.lit(border.doc_id)) & (F.col("tie") == border.tie))
        cut = within(own, budget - border.start).head()
        chars, tokens = cut.cut_chars, cut.cut_tokens
    whole, part = F.col("run_n_tokens") <= budget, F.col("start") < budget
    pick = lambda all_, some: F.when(whole, all_).when(part, F.lit(some)).otherwise(0).cast("long")
    return placed.select("doc_id", "start", "n_tokens", pick(F.col("n_tokens"), tokens).alias("taken"), pick(F.col("cut_chars"), chars).alias("cut_chars"))
