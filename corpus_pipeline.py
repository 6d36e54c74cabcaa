"""From documents to packed sequences: the stages of one training corpus, in order.

Each stage takes (spark, docs, sf_dir) and returns what goes on: documents with all their columns, and at
the end the pieces of packed sequences. Every stage takes tables with further columns of any name, with nulls in
any column, with repeated rows and without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, table, without
from corpusloom.llm.exact_dedup import keep_first
from corpusloom.llm.near import jaccard_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import resample
from corpusloom.llm.queries import word_encode
from corpusloom.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resample keeps.

    Null texts count as empty ones; rows equal in doc_id and text stay or go together; a table without rows
    stays so, and without labels of both classes every row stays.
    """
    found = resample(docs, table(spark, sf_dir, "labels")).filter("not kept")
    return without(docs, found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest doc_id.

    Null texts count as empty, a null doc_id comes last; of rows equal in doc_id and text one stays.
    """
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that links of 0.8 or more in five-word shingles join, the document with the smallest doc_id.

    Null texts count as empty; texts without a word are one group. A group without any doc_id stays; rows equal
    in doc_id and text stay or go together.
    """
    found = jaccard_duplicates(docs).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without(docs, found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that stand more than once; n_chars follows the text.

    Null texts stay null; a document that loses all its words stays as an empty one; repeated rows repeat each
    other's passages, so of rows that stand twice all long passages go.
    """
    found = remove_repeats(docs, texts=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(f"others.`{c}`") for c in docs.columns if c not in ("doc_id", "text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(columns["n_chars"])
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 4096 tokens. Null and empty texts are an end token each; repeated rows are packed as often as they come."""
    return pack(docs, word_encode(2))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Tokens, MinHash and the quality model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of documents, each stage's documents being written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
