"""Token counts at prefixes, spelling variants and the conversation trie against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

PATH = public_tokenizers.path("word_bpe_49k.json") if hasattr(public_tokenizers, "path") else ""
ODD = ["'", "l", "ll", "r", "e", "s", "A", "é", "é", "̧", "ß", "İ", " ", " ", "\n", "7", "!", "..", "ing", "H", "̱", "<|endoftext|>", "<|", "漢", "か", "゙", "각", "ᄀ", "ᅡ", "ᆨ", "😀", "ཱི", "Σ", "\x1c", "\x00", "aaaa", "ab", "²", "ﬁ", "क़"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


# --- 11: token counts ---


def test_counts_of_all_prefixes_are_the_librarys(library):
    from corpusloom.llm.token_counts import counter

    rng, c = random.Random(11), counter(PATH)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    texts += ["".join(rng.choice("ab") for _ in range(40)) for _ in range(20)] + ["Restes the, ersteres blä.", "x" * 500, "'re 'll it's we've ''s"]
    for text in texts:
        steps, width = c.steps(text)
        assert np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64).tolist() == [library(text[:i]) for i in range(1, len(text) + 1)]


def test_wide_steps(library):
    """Steps that don't fit a byte are kept in four."""
    from corpusloom.llm.token_counts import PrefixCounter

    c = PrefixCounter(PATH)
    c.words["jump"] = None
    steps, width = c.steps("a jump b")
    assert width == 4 and np.frombuffer(steps, "<i4").sum() == library("a jump b") and len(steps) == 32


def test_answers_without_encoding(spark, library):
    from corpusloom.llm.token_counts import prefix_counts, spend, within

    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, "Hello, world! it's"), (2, None), (3, ""), (4, long), (5, "a b c d e f"), (5, "a b c d e f"), (None, "x y"), (6, " \t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("steps", "width", "n_tokens", "tie", "start")})
    found = prefix_counts(docs, lambda: PATH)
    got = within(found, 5).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        t = text[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), library(t), library(t) > 5)
        best = max(i for i in range(min(len(t), 60) + 1) if library(t[:i]) <= 5)
        assert (r.cut_chars, r.cut_tokens) == (best, library(t[:best]))
    assert within(prefix_counts(docs.limit(0), lambda: PATH), 5).count() == 0

    order = [None, 1, 2, 3, 4, 5, 5, 6]
    for budget in (0, 3, 7, 100, 10**9):
        used, want = 0, []
        for d in order:
            t = text[d] or ""
            n = library(t)
            if used + n <= budget:
                want.append((d, used, n, n, len(t)))
            elif used < budget:
                cut = max(i for i in range(min(len(t), 300) + 1) if library(t[:i]) <= budget - used)
                want.append((d, used, n, library(t[:cut]), cut))
            else:
                want.append((d, used, n, 0, 0))
            used += n
        k = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(map(k, map(tuple, spend(found, budget).collect()))) == sorted(map(k, want))


def test_counts_query(spark, sf, library):
    from corpusloom.llm.queries import op11_token_counts

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


# --- running totals ---


def test_running_totals(spark):
    from corpusloom.llm.common import Scratch
    from corpusloom.llm.running import MASK, running

    rng = random.Random(3)
    rows = [(rng.choice([7] * 5 + [1, 2, 3, 9]), i, rng.choice([0, 1, MASK])) for i in range(900)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(5)
    for group in (None, "g"):
        want, total = {}, Counter()
        for g, k, v in sorted(rows):
            total[g if group else 0] = (total[g if group else 0] + v) & MASK
            want[k] = total[g if group else 0]
        got = running(df, ["g", "k"], ["v"], Scratch(spark, "test"), "r", group).collect()
        assert {r.k: r.run_v for r in got} == want and len(got) == len(rows)
    assert running(df.limit(0), ["g", "k"], ["v"], Scratch(spark, "test"), "r", "g").count() == 0


# --- 12: spelling ---


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_variants_against_all_pairs(spark):
    from corpusloom.llm.spelling import variants

    rng = random.Random(12)
    words = {"".join(rng.choice("aabéx") for _ in range(rng.randint(3, 6))): rng.choice([5, 5, 6, 30, 30, 200, 1100, 6000]) for _ in range(500)} | {"aaaa": 7, "aaaaa": 7, "qqqqqq": 9}
    got = {r.word: r for r in variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)).collect()}
    assert got.keys() == words.keys()
    forms = {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = close[0] if close and -close[0][0] >= 5 * n else None
        forms[w] = form and form[1]
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n, len(close), form and form[1], form and -form[0])
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        assert got[w].root == root
    assert variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_word_counts(spark):
    from corpusloom.llm.spelling import misspelt, word_counts

    rows = [(i % 40 or None, t) for i in range(400) for t in ("Bücher bücher BÜCHER lettering, short x\nlettering×÷ naïveté", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("z"), "n": F.lit(1)})
    want = Counter()
    for doc, text in rows:
        word = ""
        for c in [*(text or ""), " "]:
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                word += c.lower() if c.isascii() else c
            elif word:
                h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
                want[word if h % 7 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
                word = ""
    got = {r.word: r.n for r in word_counts(docs.repartition(3), change=misspelt(7)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5} and len(got) > 5
    assert word_counts(docs.limit(0)).count() == 0


# --- 13: the trie ---


def brute(convs: dict[int, list[tuple[str, str]]]) -> dict[tuple[int, int], tuple]:
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out[min(m), len(p)] = (parent, len(m), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def test_trie_against_brute_force(spark):
    from corpusloom.llm.common import Scratch
    from corpusloom.llm.prefix_trie import last_turns, placed_turns, prefix_trie

    rng, rows = random.Random(13), []
    shared = [("user", f"start {i}") for i in range(60)]
    for c in range(150):
        n = rng.choice([1, 2, 3, 5, 8, 60])
        turns = shared[:n] if c % 3 else [(rng.choice(["user", None]), rng.choice(["é", "b", "", None])) for _ in range(min(n, 5))]
        for i, (role, text) in enumerate(turns):
            rows.append((c - 5, None if i == 0 and c % 2 else i + 1, role, text))
    rows += [(None, 1, "user", "no conversation"), (4, 1, "user", "again"), (4, 1, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("place", "digest", "node", "lane", "one", "depth")}).repartition(3)
    sha = lambda r, t: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).digest()
    convs = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, sha(r[2], r[3]))):
        convs[c].append((role or "", text or ""))
    convs[1000] = []
    scratch = Scratch(spark, "test")
    turns = placed_turns(df, scratch)
    ids = turns.select("conv_id").distinct().union(spark.createDataFrame([(1000,)], "conv_id long"))
    nodes = prefix_trie(turns, ids, scratch)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_bytes, r.ends_sha256) for r in nodes.collect()}
    assert got == brute(convs)
    placed = nodes.orderBy("preorder").collect()
    assert [r.preorder for r in placed] == list(range(len(placed)))
    open_ = []
    for r in placed:
        while open_ and open_[-1].subtree_end < r.preorder:
            open_.pop()
        assert len(open_) == r.depth and all(o.subtree_end >= r.subtree_end for o in open_)
        open_.append(r)
    assert {(r.role, r.text) for r in last_turns(nodes, df).collect()} == {(None, None)} | {t for turns in convs.values() for t in turns}


def test_trie_names_beginnings_anew_when_sums_collide(spark, monkeypatch):
    from corpusloom.llm import prefix_trie as module
    from corpusloom.llm.common import Scratch

    plain = module._beginnings

    def weak(turns, salt, scratch):
        rows = plain(turns, salt, scratch)
        return rows if salt else rows.withColumn("node", F.concat(F.lit("x"), F.col("depth")))

    monkeypatch.setattr(module, "_beginnings", weak)
    df = spark.createDataFrame([(c, i, "user", f"{c % 2} {i}") for c in range(6) for i in range(3)], "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "test")
    turns = module.placed_turns(df, scratch)
    assert module.prefix_trie(turns, turns.select("conv_id").distinct(), scratch).count() == 7


def test_trie_of_nothing(spark):
    from corpusloom.llm.common import Scratch
    from corpusloom.llm.prefix_trie import placed_turns, prefix_trie
    from corpusloom.llm.queries import rebuilt

    scratch = Scratch(spark, "test")
    ids, turns = rebuilt(placed_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), scratch), scratch)
    assert prefix_trie(turns, ids, scratch).count() == 0
