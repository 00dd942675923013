"""Session defaults, and tables written out to cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A file's size says little of the rows it holds, so no table is broadcast for it: joins are planned as shuffles, and
# adaptive execution broadcasts a side once its measured rows are small.
JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760",
}

SETTINGS = {
    **JOINS,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "voxelloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a private one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` once and read it back: later passes start from files that outlive executors.

    A task closes a file every ``voxelloom.rowsPerFile`` rows, so a source that came as one split is
    read back by many tasks without a shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("maxRecordsPerFile", spark.conf.get("voxelloom.rowsPerFile", "4000000")).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FEW = 10_000


def few(table: DataFrame, rows: int = FEW) -> DataFrame:
    """A written ``table`` of at most ``rows`` rows, marked for broadcast, so that what it meets is not shuffled; else as it is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
