"""Steps that stay bounded, or read their input once, however large it is."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from corpusloom import queries as core
from corpusloom.operators import budget, scoring


def test_own_grams_come_in_bounded_batches():
    import pyarrow as pa

    texts = ["".join(chr(0x4E00 + (i * 37 + k * k) % 20_000) for k in range(5000)) for i in range(60)] + ["short", None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(scoring._own_grams(4000)(iter([batch])))
    assert max(b.num_rows for b in out) < scoring.TOGETHER + 4000 < sum(b.num_rows for b in out)
    got = Counter()
    for b in out:
        for d, g, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[d, g] += n
    want = Counter({(i, t[:4000][k : k + 5]): 0 for i, t in enumerate(texts[:60]) for k in range(3996)})
    for i, t in enumerate(texts[:60]):
        want.update((i, t[k : k + 5]) for k in range(3996))
    assert got == want | Counter({(i, None): 0 for i in (60, 61, 62)}) and all((i, None) in got for i in (60, 61, 62))


def _shared_urls(spark, tmp_path):
    """Pages of which many have another's URL."""
    urls = [f"https://h{i % 3}.example/{'tag/' if i % 5 == 0 else 'a/'}{i}" for i in range(40)]
    rows = [(i, urls[i * 7 % (11 if i % 2 else 40)], "") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{next((tmp_path / 'pages.parquet').glob('part-*'))}'")
    return pages, con


def test_sitemap_walk_has_every_page(spark, tmp_path):
    _, con = _shared_urls(spark, tmp_path)
    got = core.QUERIES["sitemap_walk"](spark, str(tmp_path)).select("origin", "url", "map", "depth").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(core.ORACLE["sitemap_walk"]).fetchall())


def test_host_interleave_orders_pages_of_one_url(spark, tmp_path):
    pages, con = _shared_urls(spark, tmp_path)
    sql = core.ORACLE["host_interleave"].replace("url) AS turn", "url, page_id) AS turn")
    want = sorted(con.execute(sql).fetchall())
    assert sorted(map(tuple, core.QUERIES["host_interleave"](spark, str(tmp_path)).collect())) == want
    rows = pages.withColumn("host", core.web.authority(core.F.col("url"))).orderBy(core.F.desc("page_id"))
    assert sorted(map(tuple, budget.interleave(rows, "host", "url", ties=["page_id"]).select("page_id", "turn", "place").collect())) == want


def _passes(spark, monkeypatch, name, sf):
    """How many times a query has its texts tidied and measured, by rows."""
    seen, made = spark.sparkContext.accumulator(0), core.clean

    def counted(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    def clean(spark, sf):
        rows = made(spark, sf)
        return rows.mapInArrow(counted, rows.schema)

    monkeypatch.setattr(core, "clean", clean)
    core.QUERIES[name](spark, sf).collect()
    return seen.value / made(spark, sf).count()


READ_ONCE = ("stratified_split", "split_class_stats", "leakage_text", "leakage_ids", "verification", "training_lineage", "counted_sink", "split_sink", "token_rollup", "budget_prefix", "budget_fill", "token_count_sp", "piece_efficiency", "vocab_sweep")


@pytest.mark.parametrize("name", READ_ONCE)
def test_texts_are_measured_once(spark, monkeypatch, sf, name):
    if name in ("token_count_sp", "piece_efficiency", "vocab_sweep"):
        pytest.importorskip("public_tokenizers")
    assert _passes(spark, monkeypatch, name, sf) == 1


def test_small_windows_are_dealt_to_few_tasks(spark, tmp_path, monkeypatch):
    from corpusloom.sources import ranges

    monkeypatch.setattr(ranges, "TASKS", 7)
    lines = [f"{i} " + "x" * (i * 37 % 400) for i in range(500)]
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    reader = ranges.ByteWindowReader({"path": str(tmp_path), "windowBytes": "300"})
    parts = reader.partitions()
    assert len(parts) <= 8 and all(p.step == 300 for p in parts)
    got = [(x["path"], x["value"]) for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert got == [(str(tmp_path / f"{name}.jsonl"), line) for name in "ab" for line in lines]


@pytest.mark.parametrize("of", ["tidied", "measured", "measured as they are"])
def test_text_passes_hold_a_slice_of_a_batch(of):
    """Strings of one slice at a time: what a batch has more is not made until the slice before was handed on."""
    import pyarrow as pa

    from corpusloom.functions import text
    from corpusloom.operators import gates

    run = text._tidied("", "", True) if of == "tidied" else gates._measured("latin", of == "measured")
    long = "a  b\n" * (text.BYTES // 5 + 1)
    texts = [f"x  {i}\n\n y" for i in range(3 * text.TEXTS + 7)] + [None, "", *[long] * 3]
    read = []

    def batches():
        for k, part in enumerate((texts, [], texts[:5])):
            read.append(k)
            yield pa.array(part, pa.string())

    sizes, rows, when = [], [], []
    for out in run(batches()):
        when.append(len(read))
        sizes.append(len(out))
        rows += out.to_pylist()
    assert max(sizes) == text.TEXTS and when[:6] == [1] * 6
    got = [r if of == "tidied" or r is None else r["text"] for r in rows]
    tidy = text.tidied("", "", True)
    want = [tidy(t) for t in texts + texts[:5]]
    assert got == (want if of != "measured as they are" else [None if t is None else "" for t in want])
    if of != "tidied":
        assert [r["n_chars"] for r in rows] == [None if t is None else len(tidy(t) if of == "measured" else t) for t in texts + texts[:5]]


ODD_TEXTS = ["a b  a", "", None, " \u3000x\u2028Y ", "नमस्ते दुनिया नमस्ते", "\U0001f600 \U0001f600\U0001f600 ab", "It's  THE the\tthe", "İI ß", "a", "abcdefghij " * 50, "1 22 333 4444"] * 2


@pytest.mark.parametrize("most", [40, 10_000])
def test_gram_vectors_are_those_of_arrays_of_grams(spark, monkeypatch, most):
    """Vocabulary and counts as CountVectorizer has them from word_grams, and few of them handed on together."""
    from pyspark.ml.feature import CountVectorizer

    monkeypatch.setattr(scoring, "GRAMS_TOGETHER", 10)
    monkeypatch.setattr(scoring, "WORDS_TOGETHER", 7)
    texts = [*ODD_TEXTS, "only here", "only here too: only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    arrays = df.withColumn("grams", scoring.word_grams(core.F.coalesce("text", core.F.lit(""))))
    model = CountVectorizer(inputCol="grams", outputCol="counts", minDF=2, vocabSize=most).fit(arrays)
    known = scoring.gram_vocabulary(df, most)
    freq = Counter(g for r in arrays.collect() for g in r.grams)
    assert [freq[g] for g in known] == [freq[g] for g in model.vocabulary] and "too" not in known
    assert set(known) == set(model.vocabulary) or most == 40
    want = {r.doc_id: (list(r.counts.indices), list(r.counts.values)) for r in model.transform(arrays).collect()}
    assert {r.doc_id: (r.indices, r.counts) for r in scoring.gram_counts(df, model.vocabulary).collect()} == want


def test_distil_reads_vectors_a_row_at_a_time(spark, monkeypatch):
    """No task holds the vectors of a batch of rows, and only labelled texts become vectors in a table."""
    from pyspark.ml.feature import IDF
    from pyspark.ml.regression import LinearRegression

    plans, blocks, written, table = [], [], [], scoring.Scratch.table
    for of in (IDF, LinearRegression):
        monkeypatch.setattr(of, "fit", lambda self, df, f=of.fit: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(self, df))[1])
    kept = LinearRegression.fit
    monkeypatch.setattr(LinearRegression, "fit", lambda self, df: (blocks.append(self.getMaxBlockSizeInMB()), kept(self, df))[1])
    monkeypatch.setattr(scoring.Scratch, "table", lambda self, df, name, *a, **b: written.append((name, df.count())) or table(self, df, name, *a, **b))
    before = spark.conf.get(scoring.LISTS_IN_BATCHES)
    docs = spark.createDataFrame([(i, ("good prose text " if i % 2 else "zzz qqq xxx ") * 5 + f"n{i}") for i in range(240)] + [(240, None), (241, "")], "doc_id long, text string")
    labelled = docs.filter("doc_id < 60").withColumn("score", (core.F.col("doc_id") % 2 * 5).cast("double"))
    scored, report = scoring.distil(labelled, docs, least=60)
    assert written == [("labelled", 60)] and len(plans) == 2 and all("Batched: false" in p for p in plans)
    assert spark.conf.get(scoring.LISTS_IN_BATCHES) == before
    assert 0 < blocks[-1] * 100 <= 16  # what Java holds of blocks that a task reads from disk
    got = {r.doc_id: r.quality_score for r in scored.collect()}
    assert len(got) == 242 and got[240] == got[241] and report["labels"] == 60
    assert all(abs(got[i] - i % 2 * 5) < 1 for i in range(60, 240))
