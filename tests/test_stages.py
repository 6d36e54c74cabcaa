"""The stages of a corpus folder from end to end, and the command line."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.plans.report import MISSING, report
from corpusloom.plans.stages import Corpus, resolve, run


def test_stages(spark, sf, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/c", f"{sf}/documents.parquet", target=1000)
    took = run(c, ["every"])
    assert list(took) == ["existing", "ingest", "build", "rebuild", "score", "apply", "count", "tokenizers", "verify", "audit", "plan", "report"]
    splits = c.read("splits")
    assert splits.count() == c.read("clean").count() > 0 and {r.split for r in splits.select("split").distinct().collect()} <= {"train", "val", "test"}
    text = "\n".join(r.value for r in spark.read.text(c.at("report")).collect())
    assert "## reasons" in text and MISSING not in text
    reasons = {r.reason for r in c.read("stats/reasons").collect()}
    assert {"ok", "exact_duplicate"} <= reasons
    assert c.read("stats/checks").count() == 4


def test_optional_inputs(spark, sf, tmp_path):
    import public_tokenizers

    (tmp_path / "files" / "deep").mkdir(parents=True)
    prose = [" ".join(f"word{(i * 7 + j * j) % 97} and then the people of place{j} said it was well" for j in range(40)) for i in range(3)]
    lines = [f'{{"content": "{p}", "language": "en", "source": "own{i}"}}' for i, p in enumerate(prose)] + ["no json", '["list"]', '{"text": "short"}']
    (tmp_path / "files" / "deep" / "oscar-part.jsonl").write_text("\n".join(lines))
    c = Corpus(spark, f"file://{tmp_path}/c", f"{sf}/documents.parquet", existing=f"file://{tmp_path}/files", provenance="manual", models=(public_tokenizers.path("piece_bpe_32k.model"),), sample_split="train", sample=50, strided=True)
    with pytest.raises(ValueError, match="justification"):
        run(c, ["existing"])
    c.justification = "typed by hand"
    with pytest.warns(UserWarning, match="public corpora"):
        run(c, ["existing"])
    assert {r.justification for r in c.read("existing").collect()} == {"typed by hand"} and c.read("existing").count() == 3
    assert {r.reason: r.documents for r in c.read("stats/existing").filter("source = 'oscar'").collect()}.keys() >= {"bad_json", "not_object"}
    c.provenance, c.justification = "downloaded", None
    run(c, ["existing", "ingest", "build", "tokenizers", "report"])
    one = c.read("stats/tokenizer").head()
    assert one.vocab_size == 32_000 and one.reason == "elbow" and one.documents > 0 and c.read("stats/pieces").count() == 50
    run(c, ["score", "apply"])
    assert c.read("scores").count() == c.read("clean").count() and c.read("filtered").count() <= c.read("splits").count()
    labels = c.read("clean").selectExpr("doc_id", "CAST(length(text) % 6 AS DOUBLE) AS score")
    labels.write.parquet(f"file://{tmp_path}/labels")
    c.labels = f"file://{tmp_path}/labels"
    with pytest.raises(ValueError, match="labelled documents"):
        c.least_labels = labels.count() + 1
        run(c, ["score"])
    c.least_labels = labels.count()
    run(c, ["score"])
    assert c.read("stats/distilled").head().labels == labels.count() and c.read("scores").count() == c.read("clean").count()


def test_strided_ingest(spark, sf, tmp_path):
    from corpusloom.config import IngestConfig

    small = IngestConfig(windows=2, target_tokens=500, overcollect=1.0)
    whole, part = (Corpus(spark, f"file://{tmp_path}/{n}", f"{sf}/documents.parquet", ingest=small, strided=n == "part") for n in ("whole", "part"))
    for c in (whole, part):
        run(c, ["ingest"])
    kept = part.read("raw")
    assert 0 < kept.count() < whole.read("raw").count()
    assert kept.join(whole.read("raw"), "doc_id", "left_anti").isEmpty()


def test_lines_by_windows_and_variants(spark, sf, tmp_path):
    from corpusloom.config import BuildConfig, IngestConfig

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source", F.col("lang").alias("language"), F.when(F.col("doc_id") % 3 == 0, "manual").otherwise("downloaded").alias("provenance_class"))
    kept.coalesce(1).write.json(f"{tmp_path}/lines")
    make = lambda n, **k: Corpus(spark, f"file://{tmp_path}/{n}", f"{tmp_path}/lines", lines=True, **k)
    whole, part = make("whole"), make("part", ingest=IngestConfig(windows=5, target_tokens=3000, overcollect=1.0))
    for c in (whole, part):
        run(c, ["ingest"])
    every = {r.doc_id for r in whole.read("raw").collect()}
    some = {r.doc_id for r in part.read("raw").collect()}
    assert 0 < len(some) < len(every) and some < every
    assert {r.provenance_class for r in whole.read("raw").select("provenance_class").distinct().collect()} == {"manual", "downloaded"}
    other = make("whole", variant="nocap", config=BuildConfig(budget=None, near_dup=False))
    run(other, ["build"])
    assert other.read("splits").count() > 0 and (tmp_path / "whole" / "variants" / "nocap" / "splits").is_dir() and not (tmp_path / "whole" / "splits").exists()


def test_command_line(tmp_path, capsys, spark, sf):
    assert main(["--raw", "x", "--root", "y", "--dry-run", "--min-chars", "10", "all"]) == 0
    assert capsys.readouterr().out.split() == ["ingest", "build", "count", "verify", "report"]
    (tmp_path / "c.yaml").write_text("gates: {min_words: 5}\nbudget: {min_manual_fraction: 0.9}\n")
    code = main(["--raw", f"{sf}/documents.parquet", "--root", f"file://{tmp_path}/c", "--config", str(tmp_path / "c.yaml"), "--no-near-dedup", "--no-budget", "ingest", "build", "count"])
    assert code == 1
    with pytest.raises(ValueError, match="unknown"):
        resolve(["nothing"])


def test_plans_by_measured_tokens_and_urls(spark, sf, tmp_path):
    (tmp_path / "urls").mkdir()
    (tmp_path / "urls" / "u.txt").write_text("".join(f"https://h{i % 4}.org/{i}\n" for i in range(1000)))
    c = Corpus(spark, f"file://{tmp_path}/c", f"{sf}/documents.parquet", manual_tokens=1000, urls=f"{tmp_path}/urls", crawl={"hours": 1, "delay": 20.0, "acceptance": 0.5, "tokens_per_doc": 100.0}, target=10_000_000)
    run(c, ["ingest", "plan"])
    own = c.read("stats/plan").head()
    assert (own.manual_tokens, own.ceiling) == (1000, pytest.approx(5000))
    r = c.read("stats/crawl_plan").head()
    assert (r.urls, r.hosts, r.fetchable, r.manual_tokens, r.max_total) == (1000, 4, 720.0, 36_000.0, pytest.approx(180_000.0))


def test_report_says_what_is_missing():
    assert MISSING in report("t", {"a": None, "b": {"x": None, "y": 1200}}) and "1,200" in report("t", {"b": {"y": 1200}})
