"""Spelling variants of words without pairs of words: wildcard groups and deletions.

Two words differ by one replaced code point exactly if they are the same without the one at some place: they
share (place, what is before it, what is after it). Such a group is kept as its members, which are at most as
many as there are letters; its size tells every member how many replacements it has there, and its two most
frequent words tell it the best one, so that no pair is ever made. Two words differ by one inserted or deleted
code point exactly if a deletion of the longer is the shorter: deletions are joined with the vocabulary, and
either side is combined by itself. A word's form is the most frequent word near it, if that is much more
frequent; forms lead to roots by pointer jumping.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, hot_keys, keyed_join, lean, slices

#: Runs of letters, as the contract has them, and the lowering of ASCII letters alone.
RUN = re.compile("[A-Za-zÀ-ÿ]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: So many distinct words are counted in a task before their counts are handed on.
HELD = 300_000


def misspelt(every: int) -> Callable[[str, str], str]:
    """The rule that takes a code point from a run wherever `every` divides the hash of document and run."""

    def change(doc: str, run: str) -> str:
        h = zlib.crc32(f"{doc}:{run}".encode())
        return run if h % every else run[: (at := h % len(run))] + run[at + 1 :]

    return change


def word_counts(docs: DataFrame, smallest: int = 6, least: int = 5, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """word, n: the words of at least `smallest` code points and `least` occurrences in docs (doc_id, text).

    Words are runs of letters with ASCII letters lowered, or what `change` makes of (doc_id as text, run). Null
    texts have none; a null doc_id counts as the empty text; rows count as often as they come; other columns
    (of any name) are not looked at; an empty table gives none. Counts are combined in each task, then summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def drain() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                runs = Counter(RUN(text.translate(LOWER) if not text.isascii() else text.lower()))
                if change is None:
                    for w, n in runs.items():
                        if len(w) >= smallest:
                            held[w] += n
                    continue
                doc = "" if doc is None else str(doc)
                for w, n in runs.items():
                    if len(w) >= smallest:
                        w = change(doc, w)
                        if len(w) >= smallest:
                            held[w] += n
            if len(held) > HELD:
                yield drain()
        yield drain()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _rank(n: Column, word: Column) -> Column:
    """Smaller for a word of more occurrences, then for the word that comes first."""
    return F.struct((-n).alias("minus_n"), word.alias("word"))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n_near, best (minus_n, word): how many words of `words` (word, n; each once) are near each, and the first of those by count, then by code points. Words near none are left out."""
    places = F.sequence(F.lit(1), F.length("word"))
    gaps = words.select("word", "n", F.explode(places).alias("gap"))
    # substring(…) of 1-based places; the rest is the word without the code point at the gap.
    rest = F.concat(F.expr("substring(word, 1, gap - 1)"), F.expr("substring(word, gap + 1)"))
    keyed = scratch.table(gaps.select("word", "n", "gap", rest.alias("rest")).repartition("rest"), "gaps")

    # Members differ in one letter, so a group is no larger than the alphabet.
    groups = keyed.groupBy("rest", "gap").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(_rank(F.col("n"), F.col("word")))).alias("members")).filter("size > 1")
    replaced = groups.select((F.col("size") - 1).alias("n_near"), F.col("members")[0].alias("first"), F.col("members")[1].alias("second"), F.explode("members").alias("m"))
    replaced = replaced.select(F.col("m.word").alias("word"), "n_near", F.when(F.col("m.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))

    # Within a row of equal letters every deletion gives the same word: the first stands for them.
    single = F.expr("gap = 1 or substring(word, gap, 1) <> substring(word, gap - 1, 1)")
    links = keyed.filter(single).join(words.select(F.col("word").alias("rest"), F.col("n").alias("rest_n")), "rest")
    links = scratch.table(links.select("word", "n", "rest", "rest_n"), "deletions")
    longer = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(_rank(F.col("rest_n"), F.col("rest"))).alias("best"))
    shorter = links.groupBy(F.col("rest").alias("word")).agg(F.count("*").alias("n_near"), F.min(_rank(F.col("n"), F.col("word"))).alias("best"))
    return replaced.union(longer).union(shorter).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: where the forms of each word lead. forms: (word, form), form null at the end of its row; no row goes in a circle, as forms are more frequent.

    Every round doubles the way that a word has gone, so rounds follow the logarithm of the longest row. Words that many lead to are hot keys.
    """
    ends = forms.filter("form is null").select("word", F.col("word").alias("root"))
    ways = scratch.table(forms.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "ways-0")
    for k in itertools.count(1):
        going = ways.filter("open")
        n = going.count()
        if not n:
            return ends.union(ways.select("word", "root"))
        hot = hot_keys(going.groupBy("root").agg(F.count("*").alias("n")), n, scratch, f"hot-{k}")
        # Where the way stops now may have been led to its end already, so those that have arrived are asked, too.
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = keyed_join(going.select("word", "root"), onward, "root", hot, "left")
        stepped = stepped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        ways = scratch.table(stepped.union(ways.filter("not open")), f"ways-{k}")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for each of words (word, n; each once).

    near words differ by one inserted, deleted or replaced code point. form is the near word of largest n (of
    equal ones the first by code points), if that n is at least `ratio` (above 1) times the word's; root is the
    last of the forms from it on, the word itself where it has none. Words without near ones have 0 and nulls.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.table(words.select("word", "n"), "words")
    near = near_words(words, scratch).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.minus_n")).alias("best_n"))
    takes = F.col("best_n") >= F.lit(ratio) * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"))
    rows = scratch.table(rows, "forms")
    return rows.join(roots(rows.select("word", "form"), scratch), "word")
