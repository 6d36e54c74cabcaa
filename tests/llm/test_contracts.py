"""The registered queries of operators 1, 3, 5, 6 and 8 over the smallest tables: every column of their contracts against brute force."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: t.encode(x, add_special_tokens=False).ids for d, x in texts.items()}


def crc(x) -> int:
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_op1(spark, sf, ids):
    from corpusloom.llm.queries import op1_token_files

    start, want = 0, {}
    for d in sorted(ids):
        own = [*ids[d], 1]
        want[d] = (start, len(own), crc(own))
        start += len(own)
    rows = op1_token_files(spark, sf).collect()
    assert len(rows) == len(want) and {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want


def test_op3(spark, sf, ids):
    from corpusloom.llm.queries import op3_packing

    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in op3_packing(spark, sf).collect():
        own = [*ids[r.doc_id], 2]
        assert r.doc_tokens == len(own) and r.length > 0 and r.ids_crc32 == crc(own[r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for d, cut in pieces.items():
        ends = [0, *np.cumsum([n for _, n in sorted(cut)]).tolist()]
        assert [a for a, _ in sorted(cut)] == ends[:-1] and ends[-1] == len(ids[d]) + 1
    sizes = []
    for cut in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(cut)]).tolist()]
        assert [a for a, _ in sorted(cut)] == ends[:-1] and ends[-1] <= 4096
        sizes.append(ends[-1])
    assert sorted(sizes)[1:] == [4096] * (len(sizes) - 1)


def test_op5(spark, sf):
    from corpusloom.llm.queries import op5_neighbours

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in rows if r.embedding is not None and None not in r.embedding}
    vectors = {k: v for k, v in vectors.items() if np.isfinite(v).all() and v.any()}
    got = defaultdict(list)
    for r in op5_neighbours(spark, sf).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {k for k in vectors if k % 100 == 0}
    hits = 0
    for q, found in got.items():
        exact = {k: float(np.sqrt(((v - vectors[q]) ** 2).sum())) for k, v in vectors.items() if k != q}
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and len({v for _, v, _ in found}) == 10
        assert all(abs(s - exact[v]) <= 1e-12 * max(1, s) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(sorted(exact, key=lambda k: (exact[k], k))[:10]))
    assert hits >= 0.9 * 10 * len(got)


def test_op6(spark, sf, texts):
    from corpusloom.llm.queries import op6_quality

    rows = op6_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    kept = [r.sampling_key for r in rows if r.kept]
    gone = [r.sampling_key for r in rows if not r.kept]
    assert kept and gone and min(kept) >= max(gone)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    labelled = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels]
    assert sum(bool(q) == k for q, k in labelled) >= 0.8 * len(labelled)


def test_op8(spark, sf, texts):
    import xxhash

    from corpusloom.llm.queries import op8_simhash

    prints = {}
    for d, t in texts.items():
        ws = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
        shingles = [b" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or ([b" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = op8_simhash(spark, sf).collect()
    assert len(rows) == len(prints) and {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


# --- near duplicates of the pipeline: what links within a group ---


def templated(rng: np.random.Generator, n: int, words: int, changed: int) -> list[str]:
    base, out = [f"w{rng.integers(5000)}" for _ in range(words)], []
    for _ in range(n):
        t = list(base)
        for p in rng.choice(words, changed, replace=False):
            t[p] = f"x{rng.integers(10**7)}"
        out.append(" ".join(t[: words - int(rng.integers(0, words // 10 + 1))]))
    return out


@pytest.mark.parametrize(("words", "changed"), [(200, 4), (200, 5), (60, 1), (60, 2), (30, 1), (12, 1), (9, 0), (6, 0), (200, 20)])
def test_links_within_a_group_are_all_links(words, changed):
    from corpusloom.llm.near import forest, shingles

    rng = np.random.default_rng(words + changed)
    sets = [shingles(t) for _ in range(3) for t in templated(rng, 50, words, changed)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    want = {frozenset(x for x in range(len(sets)) if find(x) == find(y)) for y in range(len(sets))}
    edges = forest(list(range(len(sets))), [s.tobytes() for s in sets])
    assert len(edges) == len(sets) - len(want)
    root = list(range(len(sets)))
    for a, b in edges:
        root[find(a)] = find(b)
    assert {frozenset(x for x in range(len(sets)) if find(x) == find(y)) for y in range(len(sets))} == want


def test_a_template_below_the_threshold_is_not_compared_pair_by_pair():
    """2,000 texts of one template at a similarity of a half take a small part of the time that 2,000,000 comparisons would."""
    import time

    from corpusloom.llm.near import forest, shingles

    data = [shingles(t).tobytes() for t in templated(np.random.default_rng(2), 2000, 200, 14)]
    began = time.process_time()
    assert forest(list(range(len(data))), data) == []
    assert time.process_time() - began < 2


@pytest.mark.parametrize("changed", [0, 1, 3, 4, 6, 9, 20])
def test_large_groups_part_without_losing_links(spark, changed):
    """Templates at similarities from 1 down to 0.3, in groups that are cut into blocks of 15."""
    from corpusloom.llm.common import Scratch
    from corpusloom.llm.near import distinct_sets, finer, links, shingles, signatures

    rng = np.random.default_rng(changed)
    texts = [t for words in (40, 80) for t in templated(rng, 50, words, changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "test")
    rows = scratch.table(signatures(docs), "signatures")
    sets = {r.node: set(shingles(texts[r.doc_id]).tolist()) for r in rows.collect()}
    nodes = sorted(sets)
    linked = {(a, b) for a in nodes for b in nodes if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    member = spark.createDataFrame([(1, n, np.array(sorted(sets[n]), "<u8").tobytes()) for n in nodes], "component long, node long, set binary")
    group = {r.node: r.finer for r in finer(Scratch(spark, "test"), member).collect()}
    assert all(group.get(a, a) == group.get(b, b + 1) for a, b in linked)
    assert not group or changed < 6
    found = {tuple(sorted((r.a, r.b))) for r in links(scratch, docs, scratch.table(distinct_sets(rows), "distinct"), block=15).collect()}

    def groups(edges):
        root = {n: n for n in nodes}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(m for m in nodes if find(m) == find(n)) for n in nodes}

    assert found <= linked and groups(found) == groups(linked)
