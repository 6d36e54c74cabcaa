"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import ship


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in a single local JVM."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_local_root()}"


_scratches: list[Scratch] = []

#: Makes Spark delete the shuffle files of a query at its end; else they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run in the shared folder. A written table cuts lineage and outlives any executor."""

    def __init__(self, spark: SparkSession, tag: str):
        ship(spark)
        self.spark, self.path = spark, f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
        _scratches.append(self)

    def table(self, df: DataFrame, name: str, by: list[str] | None = None, **options: str) -> DataFrame:
        """Write df (by the values of some columns, so that one value's rows are read without the others) and read it back. What its shuffles left on disk is deleted, as the table stands for it."""
        to = f"{self.path}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**{"compression": "zstd"} | options).partitionBy(*(by or [])).parquet(to)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing lazy reads any more (or, without a name, all of them)."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _drop_all() -> None:
    for s in _scratches:
        try:
            s.drop()
        except Exception:  # the session may have ended already, or the folder may be gone
            continue
