"""Stateless and windowed stream operators, and replay of files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.session import scratch_path


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """The files of one table as a stream, with the schema its files declare."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(frames: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return frames.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def window_stats(frames: DataFrame, by: list[str], value: str, length: str, ts: str = "ts", late: str | None = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean, min and max per tumbling or sliding window."""
    src = frames.withWatermark(ts, late) if late else frames
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return src.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(
        *by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "min", "max")


def session_summaries(frames: DataFrame, by: list[str], gap: str, ts: str = "ts", late: str | None = "10 minutes") -> DataFrame:
    src = frames.withWatermark(ts, late) if late else frames
    return src.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def camera_health(frames: DataFrame, by: list[str], ok: str, error: str, give_up: int = 50) -> DataFrame:
    """Frames, failures, up to ten distinct errors, mean rate; a camera above ``give_up`` failures is given up."""
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(~F.col(ok)).alias("failures"), F.slice(F.array_sort(F.collect_set(F.when(~F.col(ok), F.col(error)))), 1, 10).alias("errors"),
        F.when(seconds > 0, (F.count(F.lit(1)) - 1) / seconds).alias("mean_fps")).withColumn("given_up", F.col("failures") > give_up)


def acquisition_window(sets: DataFrame, by: list[str], length: str = "60 seconds", ts: str = "ts", late: str | None = None) -> DataFrame:
    """Complete and incomplete (rejected) sets per measured window."""
    src = sets.withWatermark(ts, late) if late else sets
    return src.groupBy(F.window(ts, length).alias("w"), *by).agg(F.count_if("accepted").alias("complete"), F.count_if(~F.col("accepted")).alias("incomplete")).select(
        *by, F.col("w.start").alias("start"), "complete", "incomplete")


def with_static(frames: DataFrame, static: DataFrame, on: list[str]) -> DataFrame:
    """Frames joined with a static correction or camera table."""
    return frames.join(static, on)


def append_log(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink: a batch owns its folder, so a replay after a failure replaces its rows."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all available input and returns its rows; the last batch only in complete mode."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: append_log(b, i, out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = "batch int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rows = spark.read.schema(schema).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(last, "batch")
    return rows.drop("batch")
