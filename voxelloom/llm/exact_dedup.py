"""Exact de-duplication as a stream: keyed state without expiry, and full bytes compared on every hit."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.session import materialise, scratch_path

_STATE = {  # state on the executors' disks, with bounded memory beside them
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # executors let go of the state soon after the stream's end
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition of the state reserves megabytes of log
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", "")


def arrivals(docs: DataFrame, text: str = "text") -> DataFrame:
    """row_id, doc (all columns as a struct), n_points and text_sha256 of each row."""
    t = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), F.length(F.coalesce(t, F.lit(""))).cast("long").alias("n_points"),
        F.sha2(normalised(t).cast("binary"), 256).alias("text_sha256"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def stream_state(stream: DataFrame, checkpoint: str, digest_chars: int = 64) -> DataFrame:
    """Runs a stream of arrivals to its end and returns the state it leaves: digest, members, best.

    The state holds for each digest how many rows came and the row that stays: its length, id, row_id and the file it
    lies in. It never expires. A later stream over new arrivals with the same checkpoint goes on from it.
    """
    spark = stream.sparkSession
    best = F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_id", F.col("_metadata.file_path").alias("file"))
    keyed = stream.select(F.unhex(F.left("text_sha256", F.lit(digest_chars))).alias("digest"), best.alias("best"))
    state = keyed.groupBy("digest").agg(F.min("best").alias("best"), F.count("*").alias("members"))
    with _settings(spark, _STATE):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
        names = kept.schema["value"].dataType.fieldNames()
        return materialise(kept.select("key.digest", F.col("value")[names[0]].alias("best"), F.col("value")[names[1]].alias("members")), "digests")


def find_copies(docs: DataFrame, text: str = "text", digest_chars: int = 64, bytes_per_batch: int = 64 << 30) -> tuple[DataFrame, DataFrame]:
    """(staged rows, decisions). Decisions: row_id, doc_id, keep_row, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are equal without the characters space, tab, line feed, vertical tab, form feed and
    carriage return. Of equal texts the longest original (code points) stays, then the smallest doc_id, a null doc_id
    last, then the earlier row. A null text is an empty one, and all empty texts are equal. Repeated rows are copies:
    one of them stays. An empty table gives no rows.

    Rows are staged once with a row number; the stream reads their digests from there. Whole texts are compared
    between every copy and the row that stays for it; digests whose texts differ are grouped again by the text itself.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "arrivals")
    arrivals(docs, text).write.parquet(path)
    staged = spark.read.parquet(path)
    thin = "row_id", "doc_id", "n_points", "text_sha256"
    stream = spark.readStream.schema(staged.select(*thin).schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(path)
    state = stream_state(stream, scratch_path(spark, "dedup-state"), digest_chars)

    rows = staged.select(*thin, F.unhex(F.left("text_sha256", F.lit(digest_chars))).alias("digest"))
    decided = materialise(rows.join(state, "digest").select(
        "row_id", "doc_id", F.col("best.row_id").alias("keep_row"), F.col("best.doc_id").alias("keep_id"), F.col("members").alias("group_size"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256", "digest"), "decided")

    hits = decided.filter("group_size > 1").select("row_id", "keep_row", "kept", "digest")
    texts = materialise(staged.select("row_id", F.col(f"doc.`{text}`").cast("string").alias("text")).join(hits, "row_id").select("row_id", "keep_row", "kept", "digest", normalised(F.col("text")).alias("body")), "hits")
    stays = texts.filter("kept").select("keep_row", F.col("body").alias("stays"))
    differ = materialise(texts.filter("not kept").join(stays, "keep_row").filter("body != stays").select("digest").distinct(), "collisions")
    if not differ.isEmpty():  # different texts under one digest
        decided = decided.join(differ, "digest", "left_anti").unionByName(_by_text(staged, decided.join(differ, "digest", "left_semi"), texts))
    return staged, decided.drop("digest")


def _by_text(staged: DataFrame, decided: DataFrame, texts: DataFrame) -> DataFrame:
    """Decisions for rows of colliding digests, grouped by their texts."""
    rows = decided.select("row_id", "doc_id", "text_sha256", "digest").join(texts.select("row_id", "body"), "row_id").join(staged.select("row_id", "n_points"), "row_id")
    best = F.min(F.struct((-F.col("n_points")).alias("s"), F.col("doc_id").isNull().alias("n"), "doc_id", "row_id"))
    groups = rows.groupBy("body").agg(best.alias("best"), F.count("*").alias("group_size"))
    return rows.join(groups, "body").select("row_id", "doc_id", F.col("best.row_id").alias("keep_row"), F.col("best.doc_id").alias("keep_id"), "group_size",
                                            (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256", "digest")


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    staged, decided = find_copies(docs, text)
    return staged.select("row_id", "doc").join(decided.filter("kept").select("row_id"), "row_id", "left_semi").select("doc.*")
