"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of the n-grams (1 to 3 characters of its words, with word ends) that are
most frequent in a sample of its texts. A document's own n-grams are ranked by frequency over its whole
text, and a language's distance is the sum, over them, of how far each is out of place in the profile.
N-grams that no profile holds would add the same to every distance, so a document's ranks are those among
the n-grams that some profile holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, slices

#: About so many labelled texts of each language are learned from (all, where there are fewer).
TEXTS_PER_LANGUAGE = 2000
#: N-grams in a profile.
PROFILE = 400
LONGEST = 3
WORD = re.compile(r"[^\W\d_]+")
Profiles = dict[str, list[str]]


def grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) + 1 - n) if w[i : i + n] != "_"]


def learn(docs: DataFrame, texts: int = TEXTS_PER_LANGUAGE, size: int = PROFILE) -> Profiles:
    """Profiles from docs (text, lang); rows that lack either are passed over. The languages must be few.

    Of each language a share of the rows is taken, by a hash of their text, so that about `texts` are
    expected. The profiles that come to the driver have at most `size` n-grams for each language.
    """
    known = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, texts / n))]), F.col("lang"))
    sample = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                own = found.setdefault(lang, Counter())
                for word, n in Counter(WORD.findall(text.lower())).items():
                    for g in grams(word):
                        own[g] += n
        rows = [(k, g, n) for k, c in found.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

    total = sample.mapInArrow(lean(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    profiles: Profiles = {k: [] for k in sorted(counts)}
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.rank)):
        profiles[r.lang].append(r.gram)
    return profiles


class Identifier:
    """Tells texts' languages from profiles.

    Letters are coded so that the n-grams of a whole batch of texts are found by lookups in arrays: 0 ends
    words, 1 is a letter that no profile has, the others are those of the profiles' n-grams.
    """

    def __init__(self, profiles: Profiles):
        self.names = sorted(profiles)
        known = sorted({g for p in profiles.values() for g in p})
        letters = sorted({c for g in known for c in g if c != "_"})
        self.base, self.size = len(letters) + 2, len(known)
        self.worst = max(map(len, profiles.values()), default=0)
        self.code = np.array([chr(i).isalpha() for i in range(0x10000)], np.int32)
        place = {"_": 0}
        for k, c in enumerate(letters):
            place[c] = k + 2
            if ord(c) < 0x10000:
                self.code[ord(c)] = k + 2
        #: For each length the number of the n-gram in `known` by the codes of its letters; `size` where it has none.
        self.number = [np.full(self.base**n, self.size, np.int32) for n in range(1, LONGEST + 1)]
        for k, g in enumerate(known):
            self.number[len(g) - 1][sum(place[c] * self.base**i for i, c in enumerate(reversed(g)))] = k
        #: The rank of each n-gram in each profile; -1 where it has none.
        self.rank = np.full((len(self.names), self.size), -1, np.int32)
        for k, name in enumerate(self.names):
            self.rank[k, np.searchsorted(known, profiles[name])] = np.arange(len(profiles[name]))

    def counts(self, texts: list[str]) -> np.ndarray:
        """How often each text has each known n-gram."""
        lowered = [t.lower() for t in texts]
        raw = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), "<u4")
        code = self.code[np.minimum(raw, 0xFFFF)]
        code[raw > 0xFFFF] = 1
        of = np.repeat(np.arange(len(texts), dtype=np.int64), np.fromiter((len(t) + 1 for t in lowered), np.int64, len(texts)))[: len(code)]
        # One word end between words: each end after a letter, and one before the first letter.
        keep = np.concatenate([[True], (code[1:] > 0) | (code[:-1] > 0)]) if len(code) else np.zeros(0, bool)
        code, of = np.concatenate([[0], code[keep], [0]]), np.concatenate([of[:1], of[keep], of[-1:]])
        n = np.zeros(len(texts) * (self.size + 1), np.int64)
        value = np.zeros(len(code), np.int64)
        for k in range(LONGEST):
            value = value[: len(code) - k] * self.base + code[k:]
            # An n-gram belongs to the text of its first letter; texts are parted by a word end.
            owner = of[: len(value)] if k == 0 else np.where(code[: len(value)] > 0, of[: len(value)], of[1 : len(value) + 1])
            n += np.bincount(owner * (self.size + 1) + self.number[k][value], minlength=len(n))
        return n.reshape(len(texts), -1)[:, : self.size]

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of each text the language and a score from 0 to 1: the lead over the second nearest profile. Without a letter: und, 0."""
        if not self.names:
            return [("und", 0.0)] * len(texts)
        n = self.counts([t or "" for t in texts])
        rank = np.empty(n.shape, np.int32)
        np.put_along_axis(rank, np.argsort(-n, axis=1, kind="stable"), np.arange(self.size, dtype=np.int32)[None, :], axis=1)
        counted = (n > 0) & (rank < self.worst)
        out = np.stack([np.where(counted, np.where(own < 0, self.worst, np.abs(own - rank)), 0).sum(axis=1) for own in self.rank])
        near = np.argsort(out, axis=0, kind="stable")
        found = []
        for i, text in enumerate(texts):
            if not counted[i].any():
                found.append((self.names[0] if any(c.isalpha() for c in text or "") else "und", 0.0))
                continue
            best = float(out[near[0, i], i])
            second = float(out[near[1, i], i]) if len(self.names) > 1 else float(self.worst * counted[i].sum())
            found.append((self.names[near[0, i]], (second - best) / second if second else 0.0))
        return found


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs (doc_id, text, and held_out if it is there) with lang_pred and score.

    A null text or one without a letter is `und` with score 0, as is every text where there are no profiles.
    Ties go to the language first in the alphabet. A null doc_id stays null, repeated rows come out as often as
    they go in, other columns (of any name) are dropped, and an empty table gives none.
    """
    keep = [c for c in ("doc_id", "held_out") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(profiles)
        for batch in slices(batches, "text", rows=256, size=2 << 20):
            found = identifier.identify(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    types = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(lean(run), ", ".join(f"{c} {types[c]}" for c in keep) + ", lang_pred string, score double")
