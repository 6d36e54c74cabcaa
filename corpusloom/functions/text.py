"""Text functions: normalisation, furniture lines, hash forms, ids."""

import ctypes
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import BOILERPLATE

#: White space and line ends as Unicode (and str.split, str.splitlines) know them; the syntax is Java's and RE2's.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINE_END = r"\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}"
FURNITURE = "(?iu)" + BOILERPLATE
#: Everything but letters, numbers, underscore and the Devanagari block.
NOT_WORD = r"[^\p{L}\p{N}_\x{0900}-\x{097F}]+"


def tidied(drop_first: str, drop_after: str, danda: bool) -> Callable[[str | None], str | None]:
    """The normal form of a text: NFC, without some characters (before or after that), lines trimmed, white space collapsed, empty lines dropped."""
    first, after = (dict.fromkeys(map(ord, x)) for x in (drop_first, drop_after))
    spaced = re.compile(r"\s*([।॥])\s*")

    def tidy(text: str | None) -> str | None:
        if text is None:
            return None
        if not text.isascii():
            if first:
                text = text.translate(first)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if after:
                text = text.translate(after)
            if danda and ("।" in text or "॥" in text):
                text = spaced.sub(r"\1 ", text)
        return "\n".join([line for x in text.splitlines() if (line := " ".join(x.split()))])

    return tidy


#: Texts, and about how many bytes of them, that an Arrow pass turns into Python strings at once (one text, if it is longer).
TEXTS, BYTES = 512, 2 << 20


def in_slices(run: Callable[[list[str | None]], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """An Arrow UDF that gives what run makes of a column of texts, a slice of a batch at a time.

    Batches have up to 10,000 texts or 64 MB; as Python strings, before and after, beside Arrow's copies of both,
    they would be several times that in each worker. So a worker holds a batch and a slice's strings and results,
    and gives back at the end what it doesn't need any more, as it lives on.
    """

    def sliced(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for part in parts:
                held, size = [], 0
                for text in part:
                    held.append(text := text.as_py())
                    size += len(text or "")
                    if len(held) >= TEXTS or size >= BYTES:
                        yield run(held)
                        held, size = [], 0
                yield run(held)
                part = held = text = None
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return sliced


def _tidied(drop_first: str, drop_after: str, danda: bool) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    tidy = tidied(drop_first, drop_after, danda)

    @in_slices
    def run(texts: list[str | None]) -> pa.Array:
        return pa.array(map(tidy, texts), pa.string())

    return run


def furniture_lines() -> Callable[[str], bool]:
    """Whether a line is page furniture, as strip_boilerplate has it."""
    found = re.compile(BOILERPLATE.replace(r"\p{Nd}", r"\d"), re.I).search
    return lambda line: len(line) < 120 and found(line) is not None


def normalize(df: DataFrame, column: str = "text") -> DataFrame:
    """Without zero-width characters and soft hyphens, in NFC, dandas with one space after and none before, lines trimmed, white space collapsed, empty lines dropped.

    Spark has no NFC. One Arrow UDF makes all of it in one pass over the scan: splitting by lines and words
    there takes about a fifth of the CPU time of the JVM's regular expressions over Unicode white space.
    """
    return df.withColumn(column, F.arrow_udf(_tidied("\ufeff\u200b\xad", "", True), "string")(column))


def normalize_fetched(df: DataFrame, column: str = "text") -> DataFrame:
    """The form of fetched pages: NFC first, then without zero-width characters, tidied without regard to dandas."""
    return df.withColumn(column, F.arrow_udf(_tidied("", "\u200b\ufeff", False), "string")(column))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def words(text: Column) -> Column:
    """Words of a tidied text: single spaces and line ends part them."""
    return F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")


def dense(text: Column) -> Column:
    """A tidied text without its spaces and line ends."""
    return F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))


def count_chars(text: Column, of: str) -> Column:
    """How many characters of a text a character class has, by what is left without its runs."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{of}+", ""))


def strip_boilerplate(text: Column) -> tuple[Column, Column]:
    """A tidied text without short lines of page furniture, and how many went."""
    kept = F.filter(lines(text), lambda line: ~((F.length(line) < 120) & line.rlike(FURNITURE)))
    return F.array_join(kept, "\n"), F.size(lines(text)) - F.size(kept)


def hash_form(text: Column) -> Column:
    """What exact dedup compares: lower-case letters and digits, without dandas."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x{964}\x{965}\x{970}]", ""), NOT_WORD, "")


def content_hash(text: Column) -> Column:
    """Of the text's letters, digits and Devanagari signs (dandas among them) in lower case."""
    return F.md5(F.regexp_replace(F.lower(text), NOT_WORD, ""))


def doc_id(text: Column) -> Column:
    return F.substring(content_hash(text), 1, 20)


def shuffle_key(key: Column, seed: int) -> Column:
    """A fixed random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
