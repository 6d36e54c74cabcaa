"""Writing corpora, statistics and lists."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.dedup import append_new


def append_records(df: DataFrame, to: str, order: list[str]) -> None:
    """Append the records whose doc_id the Parquet table at `to` doesn't have."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(to)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    existing = spark.read.parquet(to) if there else df.limit(0)
    append_new(df, existing, order).write.mode("append").parquet(to)


def write_counted(df: DataFrame, to: str, counts: dict[str, Column]) -> dict:
    """Write df, and beside it (at `to`_counts) one row of aggregates that the same pass took."""
    watch = Observation()
    df.observe(watch, *(c.alias(k) for k, c in counts.items())).write.mode("overwrite").parquet(to)
    found = watch.get
    df.sparkSession.createDataFrame([tuple(found[k] for k in counts)], list(counts)).coalesce(1).write.mode("overwrite").parquet(f"{to}_counts")
    return found


def read_counts(spark: SparkSession, written: list[str]) -> DataFrame:
    """The rows of counts beside written tables."""
    return reduce(DataFrame.unionByName, (spark.read.parquet(f"{w}_counts") for w in written))


#: The folder of a split in the path of a file.
SPLIT = "/split=([^/]*)/"


def write_model(make: Callable[[DataFrame], DataFrame], rows: DataFrame, to: str, name: str) -> None:
    """Write what `make` makes of rows read from splits, and beside it (at `to`_lineage) its name, the rows that it read and the splits that their files belong to, as seen while it was made."""
    watch = Observation()
    seen = F.regexp_extract(F.col("_metadata.file_path"), SPLIT, 1)
    watched = rows.withColumn("_split", seen).observe(watch, F.count("*").alias("n_rows"), F.collect_set("_split").alias("splits")).drop("_split")
    make(watched).write.mode("overwrite").parquet(to)
    found = watch.get
    one = rows.sparkSession.createDataFrame([(name, found["n_rows"], sorted(found["splits"] or []))], "name string, n_rows long, splits array<string>")
    one.coalesce(1).write.mode("overwrite").parquet(f"{to}_lineage")


def write_splits(df: DataFrame, to: str, form: str = "parquet") -> None:
    """Write df by its split column, so that a split is read without the others."""
    df.write.mode("overwrite").partitionBy("split").format(form).save(to)


def write_statistics(tables: dict[str, DataFrame], to: str) -> None:
    """Write small aggregated tables as one JSON object (one row of text)."""
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps({name: [json.loads(x) for x in df.toJSON().collect()] for name, df in tables.items()}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(to)


def write_csv(df: DataFrame, to: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(to)


def write_lines(df: DataFrame, to: str, column: str = "line", compression: str = "none") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("compression", compression).text(to)
