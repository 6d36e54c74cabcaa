"""Operators on small fixtures, against plain sequential versions."""

from __future__ import annotations

import gzip
import io
import json
import math
import os
import random
import shutil
import subprocess
import sys
import unicodedata
import zipfile
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.config import HINDI, NEPALI, PROFILES, BudgetConfig, DedupConfig, IngestConfig, pick
from corpusloom.functions import text as T
from corpusloom.operators import budget, dedup, gates, scoring, stats, tokens, verify, web
from corpusloom.sources import records, sinks
from corpusloom.streaming.ingest import ingest

ROOT = Path(__file__).resolve().parents[1]


# --- text and gates ---


def test_normalise(spark):
    rows = [("a​b﻿ c­x", "ab cx"), (unicodedata.normalize("NFD", "é क़"), unicodedata.normalize("NFC", "é क़")), ("वाक्य।दूसरा ॥ तीसरा", "वाक्य। दूसरा॥ तीसरा"), (" a   b　c\r\n\n\x0b d e \x1c f", "a b c\nd\ne\nf"), ("", ""), (None, None), ("१२३\n४", "१२३\n४")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, text string")
    got = {r.i: r.text for r in T.normalize(df).collect()}
    assert got == {i: b for i, (_, b) in enumerate(rows)}


def test_boilerplate(spark):
    lines = ["Share this", "शेयर करें", "12", "१२", "Copyright 2020", "x" * 130 + " share", "Comments", "comments here", "Tags: a", "real text"]
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    text, n = T.strip_boilerplate(F.col("text"))
    r = df.select(text.alias("t"), n.alias("n")).head()
    assert r.t.split("\n") == ["x" * 130 + " share", "comments here", "real text"] and r.n == 7


def _prose(words, n=80):
    return " ".join(f"शब्द{chr(0x0915 + i % 30)}{chr(0x0915 + i // 30)}" for i in range(n)) + " " + " ".join(words)


REASONS = {
    "too_short_chars": "क" * 10,
    "too_few_words": "क" * 500,
    "low_script": " ".join(f"मान{'abcdefgh'[i % 8]}{'xyzwvuts' * 2}{i}" for i in range(60)),
    "code_mixed": _prose(HINDI[:6], 80) + " " + "latin " * 16,
    "no_language_markers": _prose([], 80),
    "wrong_language": _prose([*HINDI[:3], *NEPALI[:3]], 80),
    "repetitive": " ".join([*HINDI[:4], *["शब्दशब्द", "दूसराशब्द"] * 60]),
    "bad_mean_word_length": " ".join(["क" * 20 + chr(0x0915 + i % 30) + chr(0x0915 + i // 30) for i in range(60)] + list(HINDI[:4])),
    "symbol_heavy": _prose(HINDI[:6], 60) + " " + " ".join(f"चिह्न{chr(0x0915 + i)}#" for i in range(15)),
    "duplicate_lines": "\n".join([_prose(HINDI[:6], 80), *[f"छोटी पंक्ति {chr(0x0915 + i % 2)}" for i in range(8)]]),
    "ok": _prose(HINDI[:6], 80),
}


def test_a_row_for_each_reason(spark):
    df = spark.createDataFrame([(k, v, "hindi") for k, v in REASONS.items()], "want string, text string, lang string")
    got = {r.want: r.reason for r in gates.gated(df, "devanagari").collect()}
    assert got == {k: k for k in REASONS}


def test_ties_between_languages_reject_and_unknown_languages_have_no_script(spark):
    df = spark.createDataFrame([(REASONS["ok"], "nepali"), (REASONS["ok"], "xx"), (REASONS["wrong_language"], "nepali")], "text string, lang string")
    assert [r.reason for r in gates.gated(df, "devanagari").collect()] == ["wrong_language", "low_script", "wrong_language"]


def test_other_gates(spark):
    rows = [(1, REASONS["ok"]), (2, "x" * 300), (3, "12 " * 100), (4, "क")]
    df = spark.createDataFrame(rows, "i int, text string")
    assert [r.r for r in df.orderBy("i").select(gates.cheap_reason(F.col("text")).alias("r")).collect()] == ["ok", "not_script", "no_letters", "too_short"]
    assert [r.r for r in df.orderBy("i").select(gates.fetched_reason(F.col("text"), "nepali").alias("r")).collect()][0] == "looks_hindi"
    assert df.filter("i = 1").select(gates.page_reason(F.col("text"))).head()[0] == "ok"
    page = spark.createDataFrame([("अच्छी पंक्ति\n।।।।\nab cd\nक\nPage 12",)], "text string")
    assert page.select(gates.clean_recognised(F.col("text"))).head()[0] == "अच्छी पंक्ति"
    prov = spark.createDataFrame([("hindi", "manual", "scrape"), ("x", "manual", "scrape"), ("hindi", None, "ocr"), ("hindi", "downloaded", "ocr"), ("hindi", "manual", "dump"), ("hindi", "manual", "other")], "l string, c string, m string")
    got = [r.r for r in prov.select(gates.provenance_reason(F.col("l"), F.col("c"), F.col("m"), ("hindi",)).alias("r")).collect()]
    assert got == ["ok", "bad_language", "bad_class", "method_implies_manual", "method_implies_downloaded", "ok"]


# --- deduplication ---


def test_geometry():
    b, r = dedup.geometry()
    assert (b, r) == (9, 10) and abs((1 / b) ** (1 / r) - 0.803) < 1e-3


def _sequential(keys: dict[int, set], order: list[int]) -> set[int]:
    owned, kept = set(), set()
    for d in order:
        if not keys[d] & owned:
            owned |= keys[d]
            kept.add(d)
    return kept


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("parts", [1, 5])
def test_near_first_is_the_sequential_pass(spark, monkeypatch, seed, parts):
    """Also where a kept document's neighbour's neighbour must stay."""
    rng = random.Random(seed)
    n = 60
    keys = {d: {(b, rng.randrange(n // 2)) for b in range(3)} for d in range(n)}
    rows = [(d, b, str(k)) for d, ks in keys.items() for b, k in ks]
    member = spark.createDataFrame(rows, "doc_id long, band int, key string").repartition(parts)
    monkeypatch.setattr(dedup, "bands", lambda df, cfg, carried: member.join(df.select("doc_id", *(c.alias(k) for k, c in carried.items())), "doc_id"))
    docs = spark.createDataFrame([(d, rng.randrange(5)) for d in range(n)], "doc_id long, prio int")
    order = [r.doc_id for r in docs.orderBy("prio", "doc_id").collect()]
    for at_once in (0, 20, 200_000):
        got = {r.doc_id for r in dedup.near_first(docs, ["prio"], at_once=at_once).filter("near_kept").collect()}
        assert got == _sequential(keys, order)


@pytest.mark.parametrize("at_once", [9_990, 200_000])
def test_long_chains_end(spark, monkeypatch, at_once):
    """Each of 5,000 documents shares a bucket with the next: every second one stays, by rounds or at once."""
    n = 5000
    chain = spark.range(n).select(F.col("id").alias("doc_id"), F.explode(F.array(F.col("id") - 1, F.col("id"))).alias("at")).select("doc_id", F.lit(0).alias("band"), F.col("at").cast("string").alias("key"))
    monkeypatch.setattr(dedup, "bands", lambda df, cfg, carried: chain.join(df.select("doc_id", *(c.alias(k) for k, c in carried.items())), "doc_id"))
    kept = {r.doc_id for r in dedup.near_first(spark.range(n).select(F.col("id").alias("doc_id")), [], at_once=at_once).filter("near_kept").collect()}
    assert kept == set(range(0, n, 2))


def test_chain_keeps_its_third(spark, monkeypatch):
    member = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (2, 1, "y"), (3, 1, "y")], "doc_id long, band int, key string")
    monkeypatch.setattr(dedup, "bands", lambda df, cfg, carried: member.join(df.select("doc_id", *(c.alias(k) for k, c in carried.items())), "doc_id"))
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {r.doc_id for r in dedup.near_first(docs, []).filter("near_kept").collect()} == {1, 3}


def test_near_duplicates_of_texts(spark):
    words = [f"w{i}" for i in range(400)]
    near = list(words)
    near[200] = "other"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, "a b"), (5, ""), (6, "")], "doc_id long, text string")
    kept = {r.doc_id: r.near_kept for r in dedup.near_first(docs, [], DedupConfig()).collect()}
    assert kept[1] and not kept[2] and kept[3] and kept[4] and kept[5] and not kept[6]


def test_jaccard_pairs_read_once_by_hashes(spark):
    """The documents are read once, and long sets are compared by hashed numbers: arrays of binary values are compared each with each."""
    words = [f"w{i * 7919 % 30011}" for i in range(30_000)]
    texts = [" ".join(words), " ".join(words[:29_000]), " ".join(words[:14_000]), "a b", "", None]
    read = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            read.add(len(part))
            yield part

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").mapInPandas(seen, "doc_id long, text string")
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (x or "" for x in texts)]
    assert {r.doc_id: len(set(r.hashes)) for r in dedup.shingle_sets(df).collect()} == {i: len(s) for i, s in enumerate(sets)}
    before = read.value
    rows = dedup.jaccard_pairs(df).collect()
    assert read.value - before == len(texts)
    assert [(r.a, r.b, r.shared, r.either) for r in rows] == [(0, 1, len(sets[0] & sets[1]), len(sets[0] | sets[1]))]


def test_jaccard_pairs_are_all_pairs(spark):
    rng = random.Random(8)
    texts = ["one two three four five six seven eight"] * 3 + [" ".join(f"w{i}" for i in range(60))] * 2
    texts += [" ".join(f"w{i}" for i in range(60)) + f" end{k}" for k in range(12)] + ["alone among all of these texts here", "", "", "a b", "a b"]
    base = [f"v{i}" for i in range(40)]
    for _ in range(60):
        new = list(base)
        for _ in range(rng.randint(0, 3)):
            new[rng.randrange(len(new))] = rng.choice(["x", "y", "z"])
        texts.append(" ".join(new[: rng.randint(25, 40)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    first = {i: min(j for j in range(len(texts)) if sets[j] == sets[i]) for i in range(len(texts))}
    assert {r.doc_id: (r.class_id, r.class_size) for r in dedup.shingle_classes(df).collect()} == {i: (c, list(first.values()).count(c)) for i, c in first.items()}
    ids = sorted(set(first.values()))
    for threshold, block in ((0.8, 2), (0.8, 1000), (0.5, 5), (1, 1000)):
        want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) * 10 >= threshold * 10 * len(sets[a] | sets[b])}
        rows = dedup.jaccard_pairs(df, threshold=threshold, block=block).collect()
        assert len(rows) == len(want) and {(r.a, r.b): (r.shared, r.either) for r in rows} == want and (want or threshold == 1)
        assert all(r.jaccard == r.shared / r.either for r in rows)
    assert dedup.jaccard_pairs(df.limit(0)).count() == 0


def test_exact_first_and_shards(spark):
    docs = spark.createDataFrame([(1, "A b।"), (2, "ab"), (3, "c"), (4, None), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.exact_kept for r in dedup.exact_first(docs, F.md5(T.hash_form(F.col("text"))), ["doc_id"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}
    new = dedup.append_new(docs.withColumn("k", F.coalesce("text", F.lit("n"))), spark.createDataFrame([("c",)], "k string"), ["doc_id"], "k")
    assert {r.doc_id for r in new.collect()} == {1, 2, 4}
    one = docs.select("doc_id", T.content_hash(F.col("text")).alias("h")).collect()
    assert one[0].h != one[1].h


# --- budgets ---


def _first_fit(sizes, limit):
    kept, total = [], 0
    for i, n in sizes:
        if total + n <= limit:
            kept.append(i)
            total += n
    return kept


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_is_the_sequential_fill(spark, seed):
    rng = random.Random(seed)
    sizes = [(i, rng.choice([0, 1, 5, 20, 100])) for i in range(150)]
    df = spark.createDataFrame(sizes, "i long, n long").repartition(5)
    for limit in (0, 37, 500, 10**6):
        for at_once in (10, 200_000):
            assert sorted(r.i for r in budget.first_fit(df, ["i"], "n", limit, at_once).collect()) == _first_fit(sizes, limit)


def test_three_caps(spark):
    rows = [(i, "manual" if i < 20 else None if i == 20 else "downloaded", i % 3, f"s{i % 3}", 1000) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, provenance_class string, priority int, source string, n_chars long")
    keep, report = budget.apply_budget(df, BudgetConfig(manual_target_tokens=10_000, downloaded_target_tokens=10**6, margin=0.005))
    f = 0.205
    assert report["manual_chars"] == 20_000 and report["downloaded_budget"] == int(5000 * (1 - f) / f * 4) and report["binding"] == "target"
    assert keep.filter("provenance_class = 'downloaded' OR provenance_class IS NULL").count() == report["downloaded_budget"] // 1000
    _, free = budget.apply_budget(df, BudgetConfig(min_manual_fraction=0, margin=0, downloaded_target_tokens=10**6))
    assert free["ratio_cap_chars"] is None


def test_split_by_stratum(spark):
    df = spark.createDataFrame([(i, "a" if i < 19 else "b" if i < 39 else "c") for i in range(539)], "doc_id long, s string")
    got = Counter((r.s, r.split) for r in budget.stratified_split(df, ["s"]).collect())
    assert got == {("a", "train"): 19, ("b", "train"): 18, ("b", "val"): 1, ("b", "test"): 1, ("c", "train"): 490, ("c", "val"): 5, ("c", "test"): 5}


def test_windows_and_prefix(spark):
    df = spark.createDataFrame([(i, "s", 10) for i in range(100)], "doc_id long, source string, n_chars long")
    assert sorted(r.doc_id for r in budget.until_budget(df, ["doc_id"], "n_chars", 95).collect()) == list(range(10))
    got = Counter(r.window for r in budget.strided_windows(df, 5, 250).collect())
    assert got == dict.fromkeys(range(1, 6), 5)
    turns = budget.interleave(spark.createDataFrame([(f"h{i % 3}", f"u{i}") for i in range(9)], "host string, url string"), "host", "url")
    hosts = [r.host for r in turns.orderBy("turn", "place").collect()]
    assert all(len(set(hosts[i : i + 3])) == 3 for i in (0, 3, 6))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_answers_do_not_depend_on_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(i, i * 37 % 101) for i in range(300)], "i long, n long").repartition(parts)
        got = sorted(r.i for r in budget.first_fit(df, ["i"], "n", 5000).collect())
        assert got == _first_fit([(i, i * 37 % 101) for i in range(300)], 5000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- verification, scores, tokens ---


def test_lineage_and_counts_come_from_the_writing_pass(spark, tmp_path):
    to, reads = str(tmp_path), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.range(100).withColumn("split", F.when(F.col("id") < 90, "train").otherwise("val"))
    found = sinks.write_counted(df.mapInArrow(count, df.schema), f"{to}/t", {"n": F.count("*"), "total": F.sum("id")})
    assert found == {"n": 100, "total": 4950} and reads.value == 100
    assert sinks.read_counts(spark, [f"{to}/t", f"{to}/t"]).collect() == [(100, 4950)] * 2
    sinks.write_splits(df, f"{to}/splits")
    splits = spark.read.parquet(f"{to}/splits")
    sinks.write_model(lambda rows: rows.groupBy().agg(F.sum("id").alias("x")), splits.filter("split = 'train'"), f"{to}/m", "m")
    assert spark.read.parquet(f"{to}/m_lineage").collect() == [("m", 90, ["train"])] and spark.read.parquet(f"{to}/m").collect() == [(4005,)]


def test_devanagari_gates(spark):
    """Each outcome of the cascade, for the language of the text, the other one, and one without a profile."""
    hindi, nepali = (p.markers for p in PROFILES["devanagari"])
    letters = [chr(0x0915 + i) for i in range(30)]
    plain = [f"शब्द{letters[i % 30]}{letters[i // 30]}" for i in range(80)]
    rows = {
        "too_short_chars": ["क" * 10],
        "too_few_words": ["क" * 500],
        "low_script": [f"मान{'abcdefgh'[i % 8]}{'xyzwvuts' * 2}{i}" for i in range(60)],
        "code_mixed": [*plain, *hindi[:6], *["latin"] * 16],
        "no_language_markers": plain,
        "wrong_language": [*plain, *hindi[:3], *nepali[:3]],
        "repetitive": [*hindi[:4], *["शब्दशब्द", "दूसराशब्द"] * 60],
        "bad_mean_word_length": [*("क" * 20 + letters[i % 30] + letters[i // 30] for i in range(60)), *hindi[:4]],
        "symbol_heavy": [*plain[:60], *hindi[:6], *(f"चिह्न{letters[i]}#" for i in range(15))],
        "duplicate_lines": [*plain, *hindi[:6], *(f"\nछोटी पंक्ति {letters[i % 2]}" for i in range(8))],
        "ok": [*plain, *hindi[:6], "है।", "(था)"],
    }
    made = spark.createDataFrame([(k, " ".join(v).replace(" \n", "\n"), lang) for k, v in rows.items() for lang in ("hindi", "nepali", "other")], "name string, text string, lang string")
    got = {(r.name, r.lang): r.reason for r in gates.gated(made, "devanagari").collect()}
    assert all(got[k, "hindi"] == k for k in rows) and got["ok", "nepali"] == "wrong_language" and got["ok", "other"] == "low_script"


def test_checks_find_what_is_wrong(spark, tmp_path):
    trained = {"train": f"{tmp_path}/a", "all": f"{tmp_path}/b"}
    spark.createDataFrame([("tokenizer", ["train"])], "name string, splits array<string>").write.parquet(f"{tmp_path}/a_lineage")
    spark.createDataFrame([("tokenizer", ["train", "val"])], "name string, splits array<string>").write.parquet(f"{tmp_path}/b_lineage")
    good = [(1, "abc", "manual", "train"), (2, "abd", "downloaded", "val")]
    schema = "doc_id long, text string, provenance_class string, split string"
    ok = verify.checks(spark.createDataFrame(good, schema), spark.createDataFrame([(9, "zz", "manual", "train")], schema), models=[trained["train"]])
    assert all(r.passed for r in ok.collect()) and ok.count() == 6
    bad = spark.createDataFrame([*good, (1, "x", None, "test"), (3, "A B C", "manual", "test")], schema)
    tokens_ = spark.createDataFrame([("manual", 19_996), ("downloaded", 80_004)], "provenance_class string, n_tokens long")
    failed = {r.name for r in verify.checks(bad, spark.createDataFrame(good[:1], schema), tokens_, models=[trained["all"]]).collect() if not r.passed}
    assert len(failed) == 7


def test_heuristic_score(spark):
    rows = [("short", 0.0), (" ".join(f"word{i}" for i in range(40)), 5.0), (" ".join(["same"] * 40), 3.0), ("\n".join(["one line of words that is here again"] * 8), 1.0)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string").withColumn("ws", T.words(F.col("text")))
    assert [r.s for r in df.orderBy("i").select(scoring.heuristic_score(F.col("text"), F.col("ws")).alias("s")).collect()] == [s for _, s in rows]
    worse = df.filter("i = 1").select(scoring.heuristic_score(F.col("text"), F.col("ws"), F.lit(-13.0)).alias("s")).head().s
    assert worse == 3.0
    docs = df.select(F.col("i").alias("doc_id"), F.lit("manual").alias("provenance_class"), "text")
    assert {r.lp for r in scoring.log_probability(docs, scoring.profile(docs.limit(0))).collect()} == {0.0}
    by_profile = {r.doc_id: r.score for r in scoring.score_all(docs, scoring.profile(docs.filter("i = 3"))).collect()}
    assert by_profile[3] == 1.0 and by_profile[1] == 5.0 and by_profile[0] == 0.0


def test_scorer_batches_resume_and_survive_failures(spark):
    class Rater:
        def score_batch(self, texts):
            if "bad" in texts:
                raise RuntimeError
            return [float(len(t)) for t in texts]

    docs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "ccc")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in scoring.score_with(docs, Rater, spark.createDataFrame([(3,)], "doc_id long"), batch=1).collect()}
    assert got == {1: 1.0, 2: None}
    answers = spark.createDataFrame([("Score: 4.",), ("9 or 7",), (None,)], "a string")
    assert [r[0] for r in answers.select(scoring.parse_rating(F.col("a"))).collect()] == [4.0, None, None]
    assert "Passage:\nabc" in docs.select(scoring.rating_prompt(F.lit(" abc "), "Hindi")).head()[0]


def test_rating_goes_on_and_stops_when_too_slow(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    class Rater:
        def score_batch(self, texts):
            asked.add(len(texts))
            if any(t == "t7" for t in texts):
                raise ValueError("no answer")
            return [float(t[1:]) for t in texts]

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "doc_id long, text string")
    to = f"{tmp_path}/scores"
    with pytest.raises(scoring.TooSlow):
        scoring.rate(docs, Rater, to, sample=40, max_hours=0.0, trial=10, chunk=7, batch=1)
    assert asked.value == 10
    got = scoring.rate(docs, Rater, to, sample=40, trial=10, chunk=7, batch=1).collect()
    again = scoring.rate(docs, Rater, to, sample=40, trial=10, chunk=7, batch=1)
    wanted = {r.doc_id for r in budget.sample(docs, 40).collect()} - {7}
    assert {r.doc_id: r.score for r in got} == {i: float(i) for i in wanted} and again.count() == len(wanted) == len(got)
    assert asked.value <= 40 + 3


def test_thresholds_keep_the_unscored(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    scores = spark.createDataFrame([(1, 3.0), (2, 1.0)], "doc_id long, quality_score double")
    assert {r.doc_id for r in scoring.apply_threshold(docs, scores).collect()} == {1, 3}


def test_distillation(spark):
    rows = [(i, ("good prose text " if i % 2 else "zzz qqq xxx ") * 5 + f"n{i}", float(i % 2 * 5)) for i in range(240)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, score double")
    scored, report = scoring.distil(labelled, labelled.select("doc_id", "text"))
    assert report["mae"] < 1 and report["pearson_r"] > 0.9 and scored.count() == 240
    with pytest.raises(ValueError, match="labelled"):
        scoring.distil(labelled.limit(10), labelled)


def test_elbow(spark):
    rows = [("a", 1000, 2.0, 0.0, 0.0), ("a", 2000, 1.5, 0.0, 0.0), ("a", 4000, 1.49, 0.0, 0.0), ("b", 1000, 2.0, 0.5, 0.0), ("b", 2000, 1.0, 0.4, 0.0), ("c", 1, 2.0, 0.0, 0.0), ("c", 2, 2.1, 0.0, 0.0), ("d", 1, 2.0, 0.0, 0.0), ("d", 2, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model_type string, vocab_size int, fertility double, byte_fallback_rate double, unk_rate double")
    assert {(r.model_type, r.vocab_size) for r in tokens.elbow(df).filter("selected").collect()} == {("a", 2000), ("b", 2000), ("c", 1), ("d", 2)}
    assert spark.range(1).select(tokens.scaling_law_vocab(F.lit(15_000_000), F.lit(512))).head()[0] == 3311


def test_a_forced_size_keeps_its_reason(spark):
    rows = [("a", 1000, 2.0, False), ("b", 1000, 1.9, False), ("a", 2000, 1.5, True)]
    df = spark.createDataFrame(rows, "model_type string, vocab_size int, fertility double, selected boolean")
    assert tokens.choose(df).head().vocab_size == 2000
    forced = tokens.choose(df, 1000, "small model").head()
    assert (forced.model_type, forced.reason) == ("b", "forced: small model")
    with pytest.raises(ValueError, match="swept"):
        tokens.choose(df, 3000)


def test_frequency_measures(spark):
    df = spark.createDataFrame([("a a a b b c",)], "text string")
    freq = tokens.frequency(df)
    assert [(r["rank"], r.token, r.n) for r in tokens.ranked(freq).orderBy("rank").collect()] == [(1, "a", 3), (2, "b", 2), (3, "c", 1)]
    assert tuple(tokens.coverage(freq, (1, 2)).head()) == (3, 5, 6)
    assert tokens.zipf_slope(freq).head()[0] is None
    many = spark.createDataFrame([(f"t{i}", int(1000 / i)) for i in range(1, 30)], "token string, n long")
    xs = [(math.log(i), math.log(int(1000 / i))) for i in range(1, 30)]
    mx, my = (sum(c) / len(xs) for c in zip(*xs, strict=True))
    assert abs(tokens.zipf_slope(many).head()[0] - sum((x - mx) * (y - my) for x, y in xs) / sum((x - mx) ** 2 for x, _ in xs)) < 1e-9


def test_arithmetic(spark):
    one = spark.createDataFrame([(4100, 500_000, 100)], "m long, u long, h long")
    r = one.select(*(c.alias(k) for k, c in stats.ceiling(F.col("m"), 4.0, 0.205).items())).head()
    assert abs(r.ceiling / r.manual_tokens - 1 / 0.205) < 1e-9
    p = one.select(*(c.alias(k) for k, c in stats.plan(F.col("u"), F.col("h")).items())).head()
    assert p.fetchable == 500_000 and p.manual_tokens == 500_000 * 0.45 * 600


# --- web and records ---


def test_web(spark):
    html = "<p class=a>One &amp; <b>two</b></p><script>'<p>no</p>'</script><P>three</P><noscript><p>n</p></noscript><a HREF='b?x#y'>"
    df = spark.createDataFrame([(html, "https://h.org/d/a.PDF?q=1")], "html string, url string")
    assert df.select(web.paragraphs(F.col("html"))).head()[0] == ["One & two", "three"]
    assert df.select(web.paragraphs(F.lit("<p>caf&eacute; &#8217;&ndash; &hellip;</p><p>&nbsp;x&nbsp;</p><p></p>"))).head()[0] == ["café ’– …", "x", ""]
    assert df.select(web.paragraphs(F.lit("<div>none</div>"))).head()[0] == []
    assert df.select(web.hrefs(F.col("html"))).head()[0] == ["b?x#y"]
    assert [r.link for r in web.links(df.withColumn("page_id", F.lit(1))).collect()] == ["https://h.org/d/b?x"]
    assert df.select(web.unescape(F.lit("&eacute;&#x41;"))).head()[0] == "éA"
    r = df.select(web.is_pdf(F.col("url")), web.safe_name(F.col("url")), web.authority(F.col("url")), web.valid_pdf(F.lit(b"%PDF" + b"x" * 20_000)), web.fetch_outcome(F.lit(429), F.lit("text/html"), F.lit(1)), web.fetch_outcome(F.lit(200), F.lit("text/plain"), F.lit(1)), web.safe_name(F.lit("https://h.org/My%20Report%202020.pdf")), web.unquoted(F.lit("a%zz%C3%A9+%"))).head()
    assert r[0] and r[1].startswith("a__") and r[1].endswith(".pdf") and r[2:6] == ("h.org", True, "http_429", "content_type")
    assert r[6].startswith("My_Report_2020__") and r[7] == "a%zzé+%"
    xml = spark.createDataFrame([("<sitemapindex><loc> a </loc></sitemapindex>",), ("<urlset><loc>b</loc><loc>c</loc></urlset>",), ("http://x\nno\n http://y",)], "x string")
    children, urls = web.sitemap(F.col("x"))
    assert [tuple(r) for r in xml.select(children, urls).collect()] == [(["a"], []), ([], ["b", "c"]), ([], ["http://x", "http://y"])]


def test_sources(spark, tmp_path):
    from corpusloom.sources.ranges import read_archives

    good = {"text": "t", "doc_id": "1"}
    (tmp_path / "b.jsonl").write_text(json.dumps(good) + "\n\n{broken\n[1]\n")
    with gzip.open(tmp_path / "manual_x.jsonl.gz", "wt") as f:
        f.write(json.dumps(good | {"doc_id": "2"}) + "\n")
    assert sorted(r.doc_id for r in records.read_records(spark, str(tmp_path)).collect()) == ["1", "2"]
    ordered = records.read_ordered(spark, str(tmp_path)).filter("doc_id IS NOT NULL").orderBy("file_rank").collect()
    assert [r.doc_id for r in ordered] == ["2", "1"]
    audited = Counter(r.record_reason for r in records.read_audited(spark, str(tmp_path)).collect())
    assert audited == {"ok": 2, "bad_json": 1, "not_object": 1}
    (tmp_path / "seeds").mkdir()
    (tmp_path / "seeds" / "s.txt").write_text("# c\n\nexample.org\nhttp://x.org\n")
    assert [r.url for r in records.read_list(spark, str(tmp_path / "seeds")).collect()] == ["https://example.org", "http://x.org"]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.jsonl", '{"text": "x"}\n{"text": "y"}\n')
        z.writestr("b.txt", "line\n\n")
        z.writestr("c.bin", "no")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.zip").write_bytes(data.getvalue())
    assert [r.value for r in read_archives(spark, str(tmp_path / "z")).orderBy("member", "line").collect()] == ['{"text": "x"}', '{"text": "y"}', "line"]
    assert [r.key for r in records.resolve_sources(spark, None, [{"key": "b", "priority": 2, "path": "p"}, {"key": "a", "priority": 1, "path": "q"}]).collect()] == ["a", "b"]
    assert pick(None, 0, 3) == 0
    found = {Path(r.path).name: r.n_bytes for r in records.discover(spark, str(tmp_path)).collect()}
    assert set(found) == {"b.jsonl", "manual_x.jsonl.gz", "a.zip"} and found["a.zip"] == len(data.getvalue())
    assert records.folder_bytes(spark, str(tmp_path / "z")) == len(data.getvalue()) and records.folder_bytes(spark, str(tmp_path / "no")) == 0
    blobs = spark.createDataFrame([(gzip.compress(b"abc"),), (b"abc",), (None,)], "b binary")
    assert [r[0] and bytes(r[0]) for r in blobs.select(records.gunzipped(F.col("b"))).collect()] == [b"abc", b"abc", None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "train"), ("1", "y", "train"), ("2", "z", "val")], "doc_id string, text string, split string")
    to = str(tmp_path / "shard")
    sinks.append_records(df, to, ["text"])
    sinks.append_records(spark.createDataFrame([("2", "q", "val"), ("3", "r", "val")], df.schema), to, ["text"])
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(to).collect()) == [("1", "x"), ("2", "z"), ("3", "r")]
    sinks.write_splits(df, str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).filter("split = 'val'").count() == 1
    sinks.write_statistics({"summary": stats.corpus_summary(df.withColumn("provenance_class", F.lit(None).cast("string")))}, str(tmp_path / "s"))
    assert json.loads(spark.read.text(str(tmp_path / "s")).head()[0])["summary"][0]["provenance_class"] == "UNLABELLED"
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_lines(df, str(tmp_path / "lines"), "text", "gzip")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3 and spark.read.text(str(tmp_path / "lines")).count() == 3


def test_streaming_ingest(spark, tmp_path):
    source, to, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    text = REASONS["ok"]
    run = lambda **k: ingest(spark, str(source), str(to), str(state), gates.DEVANAGARI, IngestConfig(), **k).awaitTermination()

    def put(name, rows):
        (source / name).write_text("".join(json.dumps({"text": t, "doc_id": d}) + "\n" for d, t in rows))

    put("1.jsonl", [("a", text), ("a", text), ("b", text), ("c", "short")])
    run()
    put("2.jsonl", [("a", text), ("d", text)])
    run()
    assert sorted(r.doc_id for r in spark.read.parquet(str(to)).collect()) == ["a", "b", "d"]
    put("3.jsonl", [("e", text)])
    run(budget=10)
    assert spark.read.parquet(str(to)).count() == 3


def test_streaming_ingest_by_source(spark, tmp_path, monkeypatch):
    from corpusloom.streaming import ingest as module

    source, to, state = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/state"
    source.mkdir()
    text = REASONS["ok"]
    n, taken = len(text), []

    def put(name, rows):
        (source / name).write_text("".join(json.dumps({"text": text, "doc_id": d, "source": s, "collected_at": at}) + "\n" for d, s, at in rows))

    def run():
        module.ingest_sources(spark, str(source), to, state, gates.DEVANAGARI, budget=3 * n, expire="10 days").awaitTermination()
        return sorted((r.source, r.doc_id) for r in spark.read.parquet(to).collect())

    day = lambda d: f"2024-01-{d:02d}T00:00:00Z"
    put("1.jsonl", [("a", "x", day(1)), ("a", "x", day(1)), ("b", "x", day(2)), ("a", "y", day(1)), (None, "y", day(2)), ("c", None, day(2))])
    taken = run()
    assert len(taken) == 5 and ("unknown", "c") in taken and taken.count(("x", "a")) == 1
    # Two more of x, of which the first crosses its budget; a is known still.
    put("2.jsonl", [("d", "x", day(4)), ("e", "x", day(5)), ("a", "x", day(3)), ("z", "y", day(4))])
    real, calls = module.running_total, []

    def fails_once(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(module, "running_total", fails_once)
    with pytest.raises(Exception, match="lost"):
        run()
    again = run()
    assert sorted(set(again) - set(taken)) == [("x", "d"), ("y", "z")] and len(again) == 7
    sums = {r.source: (r.documents, r.n_chars, r.reached.day) for r in module.held_by_source(spark, to).collect()}
    assert sums == {"x": (3, 3 * n, 4), "y": (3, 3 * n, 4), "unknown": (1, n, 2)}
    # Much later the ids of the first days are forgotten; sources whose budget is used up get nothing more.
    put("3.jsonl", [("q", "new", day(28)), ("g", "x", day(28))])
    run()
    put("4.jsonl", [("c", None, day(29)), ("q", "new", day(29))])
    last = run()
    assert last.count(("unknown", "c")) == 2 and last.count(("new", "q")) == 1 and ("x", "g") not in last


def test_all_else_works_without_the_training_data_operators(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'reason_histogram' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q; print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 50
    core = [p for p in (ROOT / "corpusloom").rglob("*.py") if "llm" not in p.parts]
    assert not any("corpusloom.llm" in p.read_text() for p in core)
