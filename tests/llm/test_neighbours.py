"""The forest: what the queue meets, how much work a search is, exact ranking of doubles."""

from __future__ import annotations

import numpy as np
import pytest


def test_the_queue_meets_leaves_in_the_order_of_their_keys():
    from corpusloom.llm.neighbours import Forest, Tree

    rng = np.random.default_rng(5)
    sample = rng.normal(size=(300, 12)).astype(np.float32)
    forest = Forest(sample, [Tree(sample, 8, np.random.default_rng(k)) for k in range(6)])
    for t, first in zip(forest.trees, forest.first, strict=False):
        leaf = t.find(sample, sample)
        assert leaf.min() >= 0 and leaf.max() < t.leaves and np.bincount(leaf).max() <= 8 and first >= 0
    for x in rng.normal(size=(20, 12)).astype(np.float32):
        keys = forest.keys(x)
        met = forest.probe(x, len(keys))
        assert sorted(met) == list(range(len(keys)))
        assert np.all(np.diff(keys[met]) >= -1e-5) and keys[met[0]] <= 1e-5


def clusters(n: int, dim: int = 32) -> np.ndarray:
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, dim)) * 4
    return centres[rng.integers(0, 60, n)] + rng.normal(size=(n, dim)) * 0.5


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clustered_vectors_take_few_distances(spark, kind):
    from corpusloom.llm.neighbours import nearest

    x = clusters(4000)
    x = x.astype(np.float32) if kind == "float" else x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(4)
    work: dict = {}
    rows = nearest(df, df.filter("vec_id % 100 = 0"), work=work).collect()
    assert work["queries"] == 40 and work["distances"] < 0.05 * 40 * 4000
    d64, hits = x.astype(np.float64), 0
    for q in range(0, 4000, 100):
        far = np.sqrt(((d64 - d64[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        own = [r for r in rows if r.query_id == q]
        assert len(own) == 10 and all(abs(far[r.vec_id] - r.score) <= 1e-13 * far[r.vec_id] for r in own)
        hits += len({r.vec_id for r in own} & set(np.argsort(far)[:10].tolist()))
    assert hits >= 0.9 * 400


def test_one_query_against_many_copies(spark):
    from corpusloom.llm.neighbours import nearest

    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(1000, [1.0, 2.5]), (1100, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, df.filter("vec_id = 1000"), k=3).collect())
    assert got == [(1000, 1, 0, 0.5), (1000, 2, 1, 0.5), (1000, 3, 2, 0.5)]
    assert nearest(df, df.limit(0)).collect() == []
