"""The corpus build as one plan: normalise, gate, deduplicate, trim to budget, split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import BuildConfig
from corpusloom.functions.text import hash_form
from corpusloom.operators.budget import apply_budget, stratified_split
from corpusloom.operators.dedup import exact_first, near_first
from corpusloom.operators.gates import gated
from corpusloom.operators.stats import reason_histogram
from corpusloom.scratch import Scratch

ORDER = ["class_rank", "priority", "source", "doc_id"]


def with_provenance(docs: DataFrame) -> DataFrame:
    """documents with provenance_class, priority and class_rank from the number of their source: every fifth source is manual."""
    number = F.substring("source", 4, 10).cast("int") % 5
    rows = docs.withColumn("priority", number).withColumn("provenance_class", F.when(number == 0, "manual").otherwise("downloaded"))
    return rows.withColumn("class_rank", (number != 0).cast("int"))


def cleaned(docs: DataFrame, cfg: BuildConfig = BuildConfig()) -> DataFrame:
    """docs with tidied text, n_boilerplate and the gates' reason."""
    return gated(docs, cfg.group, cfg.gates, clean=True)


@dataclass
class Built:
    """What a build makes. The texts are written with the gates' reasons and with the corpus; all between are narrow tables."""

    clean: DataFrame
    corpus: DataFrame
    report: dict
    reasons: DataFrame


def duplicates(ok: DataFrame, cfg: BuildConfig, scratch: Scratch) -> DataFrame:
    """doc_id and why (exact_duplicate or near_duplicate) of the rows of ok (with exact_key) that aren't first in order, as a written table."""
    narrow = ok.select("doc_id", *(c for c in ORDER if c != "doc_id"), "exact_key")
    exact = scratch.table(exact_first(narrow, F.col("exact_key"), ORDER), "exact")
    gone = exact.filter("not exact_kept").select("doc_id", F.lit("exact_duplicate").alias("why"))
    if cfg.near_dup:
        # Signatures of exact copies are made in vain, but no text is shuffled to leave them out.
        near = near_first(ok, ORDER, cfg.dedup, among=exact.filter("exact_kept"))
        gone = gone.union(near.filter("not near_kept").select("doc_id", F.lit("near_duplicate").alias("why")))
    return scratch.table(gone, "gone")


def from_clean(clean: DataFrame, cfg: BuildConfig, scratch: Scratch) -> tuple[DataFrame, dict]:
    """The corpus (with split) that budget and split make of deduplicated documents, and the budget's report.

    Budget and split work on ids and sizes; the texts are joined once, with the ids that don't just go to train.
    """
    narrow = clean.select("doc_id", "provenance_class", "priority", "source", "n_chars")
    kept, report = narrow, {}
    if cfg.budget is not None:
        kept, report = apply_budget(narrow, cfg.budget, cfg.seed)
        kept = scratch.table(kept.select("doc_id", "provenance_class", "source"), "within")
    split = stratified_split(kept.select("doc_id", "provenance_class", "source"), ["provenance_class", "source"], cfg.split_ratios, seed=cfg.seed)
    marks = split.filter("split <> 'train'").select("doc_id", F.col("split").alias("mark"))
    if cfg.budget is not None:
        marks = marks.union(narrow.select("doc_id").join(kept, "doc_id", "left_anti").select("doc_id", F.lit("over budget").alias("mark")))
    marked = clean.join(scratch.table(marks, "marks"), "doc_id", "left").withColumn("split", F.coalesce("mark", F.lit("train"))).drop("mark")
    return scratch.table(marked.filter("split <> 'over budget'"), "corpus"), report


def build(docs: DataFrame, cfg: BuildConfig = BuildConfig()) -> Built:
    """The whole build over documents (doc_id, text, lang, source, provenance_class, priority, class_rank)."""
    scratch = Scratch(docs.sparkSession, "build")
    rows = cleaned(docs, cfg).withColumn("n_chars", F.length("text").cast("long"))
    checked = scratch.table(rows.withColumn("exact_key", F.when(F.col("reason") == "ok", F.md5(hash_form(F.col("text"))))), "gated")
    ok = checked.filter("reason = 'ok'")
    gone = duplicates(ok, cfg, scratch)
    every = checked.select("doc_id", "lang", "reason", "n_boilerplate").join(gone, "doc_id", "left")
    reasons = reason_histogram(every.withColumn("reason", F.coalesce("why", "reason")), ["lang"])
    clean = ok.drop("reason", "n_boilerplate", "exact_key").join(gone, "doc_id", "left_anti")
    corpus, report = from_clean(clean, cfg, scratch)
    return Built(clean, corpus, report, reasons)
