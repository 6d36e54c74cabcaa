"""Named stages over a corpus folder, run in order with timing; each reads and writes tables below the folder."""

from __future__ import annotations

import os
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import SOURCE_MARKERS, TEXT_KEYS, BuildConfig, IngestConfig
from corpusloom.functions.text import content_hash, words
from corpusloom.operators import budget, pieces, scoring, stats, tokens, verify, web
from corpusloom.operators.gates import cheap_reason
from corpusloom.plans.build import build, from_clean, with_provenance
from corpusloom.plans.report import report
from corpusloom.scratch import Scratch
from corpusloom.sources import ranges, records, sinks


@dataclass
class Corpus:
    """A corpus folder, on any store that Spark writes to, and how it is built."""

    spark: SparkSession
    root: str
    raw: str
    config: BuildConfig = field(default_factory=BuildConfig)
    ingest: IngestConfig = field(default_factory=IngestConfig)
    script: str = "[A-Za-z]"
    target: int = 500_000_000
    min_manual_fraction: float = 0.20
    #: Read raw documents by windows over each source, up to the characters that the ingest configuration asks for.
    strided: bool = False
    #: Build below variants/<name>, with settings of its own, from the raw documents of this corpus.
    variant: str | None = None
    #: The raw documents are files of JSON lines, read by windows of bytes where they hold much more than is asked for.
    lines: bool = False
    #: A folder of JSON lines to take in beside the raw table, their provenance, and why they count as manual.
    existing: str | None = None
    provenance: str = "downloaded"
    justification: str | None = None
    #: A table of ratings (doc_id, score) to distil, how many it must have, and the least score that stays.
    labels: str | None = None
    least_labels: int = 200
    min_score: float = 2.5
    #: SentencePiece model files to measure, a vocabulary size to force and why, and the documents they are measured on.
    models: tuple[str, ...] = ()
    force_size: int | None = None
    force_reason: str | None = None
    sample_split: str = "test"
    sample: int = 20_000
    #: Manual tokens that were measured, a list of URLs to plan a crawl of, and its rates (delay, hours, acceptance, tokens_per_doc).
    manual_tokens: int | None = None
    urls: str | None = None
    crawl: dict[str, float] = field(default_factory=dict)
    #: The corpus folder of another language, compared if it has splits.
    other: str | None = None
    passed: bool = True

    def at(self, name: str) -> str:
        shared = self.variant is None or name.split("/")[0] in ("raw", "existing")
        return f"{self.root.rstrip('/')}/{name}" if shared else f"{self.root.rstrip('/')}/variants/{self.variant}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.at(name))


def existing(c: Corpus) -> None:
    """Records of files that are there already, with one provenance; manual ones need a justification, which each record keeps."""
    if c.existing is None:
        return
    if c.provenance not in ("manual", "downloaded"):
        raise ValueError(f"unknown provenance: {c.provenance}")
    if c.provenance == "manual" and not (c.justification or "").strip():
        raise ValueError("manual documents need a justification")
    schema = records.DOCUMENT + "".join(f", {k} string" for k in TEXT_KEYS if k != "text")
    files = c.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,jsonl.gz}").text(c.existing)
    found = records.parse_lines(files.select("value", F.col("_metadata.file_path").alias("file")).filter(F.btrim("value") != ""), schema)
    rows = found.withColumn("text", records.text_of(found)).withColumn("source", F.coalesce("source", records.source_of(F.col("file"))))
    rows = rows.withColumn("reason", F.when(F.col("record_reason") != "ok", F.col("record_reason")).otherwise(cheap_reason(F.col("text"), c.script, c.ingest)))
    if c.provenance == "manual" and not rows.filter(F.col("source").isin(*SOURCE_MARKERS)).isEmpty():
        warnings.warn("files taken in as manual are named like public corpora", stacklevel=2)
    manual = c.provenance == "manual"
    taken = rows.filter("reason = 'ok'").select(
        F.coalesce("doc_id", F.substring(content_hash(F.col("text")), 1, 20)).alias("doc_id"), F.col("language").alias("lang"), "text", "source",
        F.lit(c.provenance).alias("provenance_class"), F.lit(0 if manual else 1).alias("priority"), F.lit(0 if manual else 1).alias("class_rank"), F.lit(c.justification).alias("justification"),
    )
    taken.write.mode("overwrite").parquet(c.at("existing"))
    rows.groupBy("source", "reason").agg(F.count("*").alias("documents")).write.mode("overwrite").parquet(c.at("stats/existing"))


def wanted_chars(cfg: IngestConfig) -> int:
    """The characters to collect of a source, so that enough is left after the gates."""
    return int(cfg.target_tokens * cfg.overcollect * cfg.chars_per_token)


def ingest(c: Corpus) -> None:
    """Raw documents that pass the shallow gate, and why the others don't."""
    if c.lines:
        lines = ranges.read_budget(c.spark, c.raw, wanted_chars(c.ingest), c.ingest.windows).filter(F.btrim("value") != "")
        rows = records.parse_lines(lines, records.DOCUMENT).filter("record_reason = 'ok'").drop("path", "offset", "record_reason")
        rows = rows.withColumns({"source": F.coalesce("source", F.lit("unknown")), "lang": F.col("language"), "doc_id": F.coalesce("doc_id", F.substring(content_hash(F.col("text")), 1, 20))})
        manual = F.coalesce(F.col("provenance_class") == "manual", F.lit(False))
        rows = rows.withColumns({"provenance_class": F.coalesce("provenance_class", F.lit("downloaded")), "priority": F.when(manual, 0).otherwise(1), "class_rank": F.when(manual, 0).otherwise(1)})
    else:
        rows = with_provenance(c.spark.read.parquet(c.raw))
    rows = rows.withColumn("reason", cheap_reason(F.col("text"), c.script, c.ingest))
    good = rows.filter("reason = 'ok'").drop("reason")
    if c.strided:
        # Windows are chosen on ids and sizes; the texts are joined once.
        sizes = good.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"))
        good = good.join(budget.strided_windows(sizes, c.ingest.windows, wanted_chars(c.ingest)).select("doc_id"), "doc_id", "left_semi")
    good.write.mode("overwrite").parquet(c.at("raw"))
    rows.groupBy("source", "reason").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("n_chars")).write.mode("overwrite").parquet(c.at("stats/ingest"))


def make(c: Corpus) -> None:
    """The corpus build, written by split, of the raw documents and of those of existing files."""
    rows = c.read("raw")
    if c.existing is not None and records.exists(c.spark, c.at("existing")):
        own = c.read("existing").withColumn("n_chars", F.length("text").cast("long"))
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(own, allowMissingColumns=True)
    built = build(rows, c.config)
    built.clean.write.mode("overwrite").parquet(c.at("clean"))
    sinks.write_splits(built.corpus, c.at("splits"))
    built.reasons.write.mode("overwrite").parquet(c.at("stats/reasons"))


def rebuild(c: Corpus) -> None:
    """Budget and split again from the deduplicated documents of an earlier build."""
    scratch = Scratch(c.spark, "rebuild")
    corpus, _ = from_clean(c.read("clean"), c.config, scratch)
    sinks.write_splits(corpus, c.at("splits"))


def score(c: Corpus) -> None:
    """A quality score of every clean document: distilled from ratings if there are any, else the heuristic one."""
    rows = c.read("clean")
    if c.labels is not None:
        labels = c.spark.read.parquet(c.labels).select(F.col("doc_id").cast(dict(rows.dtypes)["doc_id"]).alias("doc_id"), "score").filter("score IS NOT NULL")
        scores, measured = scoring.distil(rows.select("doc_id", "text").join(labels, "doc_id"), rows, least=c.least_labels)
        scores.write.mode("overwrite").parquet(c.at("scores"))
        c.spark.createDataFrame([(float(measured["mae"]), measured["pearson_r"], int(measured["labels"]))], "mae double, pearson_r double, labels long").write.mode("overwrite").parquet(c.at("stats/distilled"))
    else:
        found = scoring.score_all(rows, scoring.profile(rows.filter("provenance_class = 'manual'")))
        found.select("doc_id", F.col("score").alias("quality_score")).write.mode("overwrite").parquet(c.at("scores"))
    stats.score_summary(c.read("scores").withColumnRenamed("quality_score", "score")).write.mode("overwrite").parquet(c.at("stats/quality"))


def apply(c: Corpus) -> None:
    """The splits without documents whose score is too low, and what stays of each class."""
    scores, rows = c.read("scores"), c.read("splits")
    sinks.write_splits(scoring.apply_threshold(rows, scores, c.min_score), c.at("filtered"))
    totals = [t.groupBy("split", "provenance_class").agg(F.count("*").alias(n)) for n, t in (("documents", rows), ("kept", c.read("filtered")))]
    totals[0].join(totals[1], ["split", "provenance_class"], "left").fillna(0, ["kept"]).write.mode("overwrite").parquet(c.at("stats/threshold"))


def tokenizers(c: Corpus) -> None:
    """What each given model makes of a sample of one split, which size is chosen, and how often the chosen model's pieces come."""
    if not c.models:
        return
    scratch = Scratch(c.spark, "tokenizers")
    rows = scratch.table(budget.sample(c.read("splits").filter(F.col("split") == c.sample_split), c.sample).select("doc_id", "provenance_class", "text"), "sample")
    measured, vocabularies = [], {}
    for m in c.models:
        vocabularies[m] = pieces.vocabulary(c.spark, m)
        size = vocabularies[m].count()
        measured.append(pieces.piece_measures(rows, m, []).select("*", F.lit(m).alias("model"), F.lit(os.path.basename(m).split("_")[0]).alias("model_type"), F.lit(size).alias("vocab_size")))
    every = measured[0]
    for more in measured[1:]:
        every = every.unionByName(more)
    tokens.elbow(scratch.table(every, "measures")).write.mode("overwrite").parquet(c.at("stats/tokenizers"))
    chosen = scratch.table(tokens.choose(c.read("stats/tokenizers"), c.force_size, c.force_reason), "chosen")
    chosen.write.mode("overwrite").parquet(c.at("stats/tokenizer"))
    if (best := chosen.head()) is None:
        return
    vocab = vocabularies[best.model]
    freq = scratch.table(pieces.piece_frequency(rows, best.model), "freq")
    tables = {
        "pieces": tokens.named(tokens.ranked(freq, 50), vocab).orderBy("rank"),
        "piece_use": tokens.vocabulary_use(freq).crossJoin(tokens.zipf_slope(freq)),
        "piece_coverage": tokens.coverage(freq),
        "piece_lengths": tokens.piece_lengths(freq, vocab),
        "piece_classes": pieces.piece_measures(rows, best.model, ["provenance_class"]),
    }
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(c.at(f"stats/{name}"))


def plan(c: Corpus) -> None:
    """The largest corpus that the manual characters collected so far permit at the least manual share; and, with a list of URLs, what crawling them can yield by the given rates.

    Manual tokens that were measured take the place of the estimates by characters.
    """
    chars = c.read("raw").agg(F.coalesce(F.sum(F.when(F.col("provenance_class") == "manual", F.length("text"))), F.lit(0)).alias("manual_chars"))
    measured = F.col("manual_chars") if c.manual_tokens is None else F.lit(c.manual_tokens * c.ingest.chars_per_token)
    found = stats.ceiling(measured, c.ingest.chars_per_token, c.min_manual_fraction)
    short = F.greatest(F.lit(0.0), F.lit(float(c.target)) - found["ceiling"])
    chars.select("manual_chars", *(v.alias(k) for k, v in found.items()), short.alias("short_of_target")).write.mode("overwrite").parquet(c.at("stats/plan"))
    if c.urls is not None:
        one = records.read_list(c.spark, c.urls).agg(F.count_distinct("url").alias("urls"), F.count_distinct(web.authority(F.col("url"))).alias("hosts"))
        yields = stats.plan(F.col("urls"), F.col("hosts"), fraction=c.min_manual_fraction, target=float(c.target), **c.crawl)
        one.select("urls", "hosts", *(v.alias(k) for k, v in yields.items())).write.mode("overwrite").parquet(c.at("stats/crawl_plan"))


def count(c: Corpus) -> None:
    """Tokens by split and class, and whether the requirements hold: pieces of the chosen model, or else of the first one given; words without any."""
    rows, by = c.read("splits"), ["split", "provenance_class"]
    if c.models:
        chosen = c.read("stats/tokenizer").head() if records.exists(c.spark, c.at("stats/tokenizer")) else None
        found = pieces.piece_totals(rows, chosen.model if chosen else c.models[0], by)
    else:
        found = tokens.totals(rows, F.size(words(F.col("text"))), by)
    found = Scratch(c.spark, "count").table(found, "tokens")
    sums = [F.sum(n).alias(n) for n in ("documents", "n_tokens", "n_chars")]
    found.rollup(*by).agg(*sums).write.mode("overwrite").parquet(c.at("stats/tokens"))
    tokens.requirements(found.groupBy("provenance_class").agg(*sums), c.target, c.min_manual_fraction).write.mode("overwrite").parquet(c.at("stats/requirements"))
    r = c.read("stats/requirements").head()
    c.passed = c.passed and not (r.fails_unlabelled or r.fails_fraction)


def check(c: Corpus) -> None:
    """The constraints of a finished corpus, also against another language's if that has been built."""
    rows, other = c.read("splits"), None
    if c.other is not None and records.exists(c.spark, f"{c.other.rstrip('/')}/splits"):
        other = c.spark.read.parquet(f"{c.other.rstrip('/')}/splits")
    verify.checks(rows, other, tokens=rows.select("provenance_class", F.size(words(F.col("text"))).alias("n_tokens")), min_fraction=c.min_manual_fraction).write.mode("overwrite").parquet(c.at("stats/checks"))
    c.passed = c.passed and c.read("stats/checks").filter("not passed").isEmpty()


def audit(c: Corpus) -> None:
    """What is raw, by class and source."""
    stats.audit(c.read("raw").withColumn("file", F.col("source"))).write.mode("overwrite").parquet(c.at("stats/audit"))


#: The reports and the measured tables that each shows.
REPORTS: dict[str, tuple[str, ...]] = {
    "collection": ("existing", "ingest", "audit", "plan"),
    "build": ("reasons",),
    "tokens": ("tokens", "requirements"),
    "quality": ("distilled", "quality", "threshold"),
    "tokenizer": ("tokenizers", "tokenizer", "pieces", "piece_use", "piece_coverage", "piece_lengths", "piece_classes"),
    "verification": ("checks",),
}


def describe(c: Corpus) -> None:
    """Markdown reports of what has been measured and of what hasn't yet, in one folder for each; what was not asked for is left out."""

    def there(name: str) -> DataFrame | None:
        return c.read(name) if records.exists(c.spark, c.at(name)) else None

    unasked = {n for n, asked in (("existing", c.existing), ("distilled", c.labels), *((t, c.models) for t in REPORTS["tokenizer"])) if not asked}
    texts = [(name, report(name.capitalize(), {n: there(f"stats/{n}") for n in shown if n not in unasked})) for name, shown in REPORTS.items() if set(shown) - unasked]
    texts.append(("index", "# Corpus\n\n" + "".join(f"- {name}\n" for name, _ in texts)))
    c.spark.createDataFrame(texts, "report string, value string").repartition("report").write.mode("overwrite").partitionBy("report").text(c.at("report"))


STAGES: dict[str, Callable[[Corpus], None]] = {
    "existing": existing, "ingest": ingest, "build": make, "rebuild": rebuild, "score": score, "apply": apply, "count": count,
    "tokenizers": tokenizers, "verify": check, "audit": audit, "plan": plan, "report": describe,
}
#: What `all` runs; `every` runs all stages. rebuild takes the place of build where only budget or split change.
USUAL = ("ingest", "build", "count", "verify", "report")


def resolve(names: list[str]) -> list[str]:
    """Stage names in order, with all and every spelled out; unknown ones raise."""
    out: list[str] = []
    for n in names:
        out += USUAL if n == "all" else STAGES if n == "every" else [n]
    if unknown := set(out) - set(STAGES):
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    return list(dict.fromkeys(out))


def run(c: Corpus, names: list[str], dry_run: bool = False) -> dict[str, float]:
    """Seconds of each stage; with dry_run the stages are only named."""
    took: dict[str, float] = {}
    for n in resolve(names):
        began = time.time()
        if not dry_run:
            STAGES[n](c)
        took[n] = time.time() - began
    return took
