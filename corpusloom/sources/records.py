"""Reading records: JSON lines and text lists; and what they are called."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import SOURCE_MARKERS, TEXT_KEYS

DOCUMENT = "text string, language string, provenance_class string, source string, collection_method string, doc_id string, collected_at string, url string, title string, extra map<string,string>"


def read_records(spark: SparkSession, path: str | list[str], schema: str = DOCUMENT) -> DataFrame:
    """JSON lines (also .gz); blank and malformed lines are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.coalesce(*(F.col(f"`{f.name}`").cast("string") for f in spark.createDataFrame([], schema).schema.fields if not f.dataType.typeName() == "map")).isNotNull())


def read_ordered(spark: SparkSession, path: str | list[str], schema: str = DOCUMENT) -> DataFrame:
    """Records with file and file_rank: manual files come first, then by name."""
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select("*", F.col("_metadata.file_name").alias("file"))
    return raw.withColumn("file_rank", F.struct(~F.col("file").startswith("manual"), F.col("file")))


def read_audited(spark: SparkSession, path: str | list[str], schema: str = DOCUMENT) -> DataFrame:
    """Records with file and bad: whether the line is no JSON object."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).filter(F.btrim("value") != "")
    return parse_lines(lines, schema)


def parse_lines(lines: DataFrame, schema: str = DOCUMENT) -> DataFrame:
    """lines (value, ...) parsed, with record_reason: bad_json, not_object or ok."""
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    reason = F.when(v.isNull(), "bad_json").when(~kind.startswith("OBJECT"), "not_object").otherwise("ok")
    parsed = F.when(reason == "ok", F.from_json("value", schema))
    return lines.withColumn("record_reason", reason).withColumn("record", parsed).select("*", "record.*").drop("record", "value")


def read_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """url: the entries of a list, one a line; # starts a comment line, and https is the default scheme."""
    rows = spark.read.text(path).select(F.btrim("value").alias("v")).filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    return rows.select(F.when(F.col("v").startswith("http"), F.col("v")).otherwise(F.concat(F.lit("https://"), F.col("v"))).alias("url"))


def text_of(record: DataFrame, keys: tuple[str, ...] = TEXT_KEYS) -> Column:
    """The first of the named columns that isn't blank, as it is; else empty."""
    there = [k for k in keys if k in record.columns]
    return F.coalesce(*(F.when(F.btrim(F.regexp_replace(k, r"\s+", " ")) != "", F.col(k)) for k in there), F.lit(""))


def source_of(path: Column) -> Column:
    """The public corpus a path names, first marker wins; else the file's stem."""
    plain = F.translate(F.lower(path), "-", "_")
    stem = F.substring(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), 1, 60)
    first, *rest = SOURCE_MARKERS
    return reduce(lambda c, m: c.when(plain.contains(m), m), rest, F.when(plain.contains(first), first)).otherwise(stem)


def resolve_sources(spark: SparkSession, configured: list[dict] | None, default: list[dict]) -> DataFrame:
    """key, priority, path: the configured sources, or the default ones, in order of priority."""
    rows = [(s["key"], int(s["priority"]), s["path"]) for s in (configured or default)]
    return spark.createDataFrame(rows, "key string, priority int, path string").orderBy("priority", "key")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path, on any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".zip", ".jsonl", ".json", ".jsonl.gz")) -> DataFrame:
    """path and n_bytes of the files below a folder, at any depth, whose names end so. Their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    wanted = reduce(lambda a, b: a | b, (F.lower("path").endswith(s) for s in suffixes))
    return files.filter(wanted).select("path", F.col("length").alias("n_bytes"))


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """The bytes of all files below a folder; 0 where there is none."""
    if not exists(spark, folder):
        return 0
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]


def integrity(lines: DataFrame, by: list[str], schema: str = DOCUMENT) -> DataFrame:
    """lines, failures of each group: how many lines (value, ...) there are, and how many are no JSON object."""
    return parse_lines(lines, schema).groupBy(*by).agg(F.count("*").alias("lines"), F.count_if(F.col("record_reason") != "ok").alias("failures"))


def page_groups(pages: DataFrame, by: str, page: str, text: str, size: int) -> DataFrame:
    """by, page_group, text, pages: each `size` consecutive pages (counted from 0) of a document as one text, in order, by lines."""
    rows = pages.groupBy(by, F.floor(F.col(page) / size).alias("page_group"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct(page, text))), lambda x: x[text])
    return rows.agg(F.array_join(texts, "\n").alias("text"), F.count("*").alias("pages"))


def _gunzip(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import gzip

    for s in parts:
        yield pd.Series([gzip.decompress(b) if b is not None and b[:2] == b"\x1f\x8b" else b for b in s], dtype=object)


def gunzipped(content: Column) -> Column:
    """Binary content, decompressed where its first bytes say it is gzip, whatever its name."""
    return F.pandas_udf(_gunzip, "binary")(content)
