"""Continuous ingest: new files of records are gated, freed of known ids and appended, with a checkpoint to resume from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.config import IngestConfig
from corpusloom.functions.text import content_hash
from corpusloom.operators.budget import running_total
from corpusloom.operators.gates import cheap_reason
from corpusloom.scratch import Scratch
from corpusloom.sources.records import DOCUMENT, exists


def ingest(spark: SparkSession, source: str, to: str, checkpoint: str, script: str, cfg: IngestConfig = IngestConfig(), budget: int | None = None, schema: str = DOCUMENT, files_per_batch: int = 100) -> StreamingQuery:
    """Append what is new in `source` (a folder of JSON lines) to the Parquet table `to`, once; run again to go on.

    Ids already seen in this or earlier runs are dropped by the stream's state. With a budget of characters,
    what comes once the table holds that many is read but not written; the batch that crosses it is written whole.
    """
    # The ids seen grow with the source, so they are kept on disk.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    rows = rows.filter(cheap_reason(F.col("text"), script, cfg) == "ok")
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.substring(content_hash(F.col("text")), 1, 20))).dropDuplicates(["doc_id"])

    def write(batch: DataFrame, number: int) -> None:
        if budget is not None and held(batch.sparkSession, to, number) >= budget:
            # The batch must be read for the stream's state to be kept.
            batch.write.format("noop").mode("overwrite").save()
            return
        # A batch that runs again after a failure replaces its own folder, and its own sum.
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")
        own = batch.sparkSession.read.parquet(f"{to}/batch={number}").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))
        own.coalesce(1).write.mode("overwrite").parquet(f"{to}_held/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_sources(spark: SparkSession, source: str, to: str, checkpoint: str, script: str, budget: int, expire: str = "30 days", cfg: IngestConfig = IngestConfig(), schema: str = DOCUMENT, files_per_batch: int = 100) -> StreamingQuery:
    """Append what is new in `source` (a folder of JSON lines) to the table `to`, each source of documents up to its own budget of characters; run again to go on.

    The ids of a source are remembered until the documents seen are `expire` older than the newest one, by
    collected_at (documents without it count as seen now; those that come later than that are passed over), so
    the state doesn't grow for ever. In each batch a source's documents go by collected_at and doc_id until its
    sum reaches the budget, with the one that crosses. Beside the table lie the sums of each source and batch
    (documents, characters, and the latest collected_at as the place it has got to): a batch that runs again
    after a stop replaces its own rows and sums, and sees those of earlier batches only. Running totals are
    spread over tasks, so a source that holds most of a batch is not summed by one.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    rows = rows.filter(cheap_reason(F.col("text"), script, cfg) == "ok").withColumn("source", F.coalesce("source", F.lit("unknown")))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.substring(content_hash(F.col("text")), 1, 20)))
    rows = rows.withColumn("seen_at", F.coalesce(F.try_to_timestamp("collected_at"), F.current_timestamp())).withWatermark("seen_at", expire)
    rows = rows.dropDuplicatesWithinWatermark(["source", "doc_id"])

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # Written once, so that the stream's state is read and kept once.
        staged = f"{to}_staged/batch={number}"
        batch.write.mode("overwrite").parquet(staged)
        new = session.read.parquet(staged)
        before = held_by_source(session, to, number).select("source", F.col("n_chars").alias("held"))
        sizes = new.select("source", "seen_at", "doc_id", F.length("text").cast("long").alias("n_chars")).join(before, "source", "left").filter(F.coalesce("held", F.lit(0)) < budget)
        total = running_total(sizes, ["seen_at", "doc_id"], "n_chars", Scratch(session, "ingest"), f"batch-{number}", ["source"])
        taken = total.filter(F.coalesce("held", F.lit(0)) + F.col("total") - F.col("n_chars") < budget).select("source", "doc_id")
        new.join(taken, ["source", "doc_id"], "left_semi").write.mode("overwrite").parquet(f"{to}/batch={number}")
        own = session.read.schema(new.schema).parquet(f"{to}/batch={number}")
        own.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text").cast("long")).alias("n_chars"), F.max("seen_at").alias("reached")).write.mode("overwrite").parquet(f"{to}_sources/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SUMS = "source string, documents long, n_chars long, reached timestamp, batch long"


def held_by_source(spark: SparkSession, to: str, before: int | None = None) -> DataFrame:
    """source, documents, n_chars, reached: what the table has of each source (from batches before a number)."""
    sums = spark.read.schema(SUMS).parquet(f"{to}_sources") if exists(spark, f"{to}_sources") else spark.createDataFrame([], SUMS)
    sums = sums if before is None else sums.filter(F.col("batch") < before)
    return sums.groupBy("source").agg(F.sum("documents").alias("documents"), F.sum("n_chars").alias("n_chars"), F.max("reached").alias("reached"))


def held(spark: SparkSession, to: str, before: int | None = None) -> int:
    """Characters in the table so far (of batches before a number), from the one-row sums that batches leave beside it."""
    if not exists(spark, f"{to}_held"):
        return 0
    sums = spark.read.parquet(f"{to}_held")
    return (sums if before is None else sums.filter(F.col("batch") < before)).agg(F.coalesce(F.sum("n_chars"), F.lit(0))).head()[0]


def run_until(query: StreamingQuery, hours: float) -> bool:
    """Wait for a stream, but not longer than so; whether it ended by itself. What is left is taken up by the next run."""
    ended = query.awaitTermination(int(hours * 3600))
    if not ended:
        query.stop()
    return bool(ended)
