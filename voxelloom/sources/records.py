"""Readers and writers of calibration, capture, parcel and log records (JSON, CSV, Parquet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTRINSICS = "camera string, lens_id string, camera_matrix array<array<double>>, dist_coeffs array<double>, image_size array<int>"
EXTRINSICS = "lens_id string, reference string, cameras map<string, struct<R: array<array<double>>, t: array<double>>>"
CORRECTION = "model string, lens_id string, shared struct<p: double, q: double, alpha: double, beta: double>, views map<string, struct<alpha: double, beta: double, d_cam: double, n_cam: array<double>>>"
META = "capture_local_time string, cameras map<string, struct<serial: string, t_call_ns: bigint, t_device_ns: bigint, file: string, shape: array<int>>>, exposure struct<exposure_us: double, gain_db: double>, skew_ms double"
SCENE = ("source string, frame string, deck_plane struct<n: array<double>, d: double, tilt_deg: double>, floor_plane struct<n: array<double>, d: double>, "
         "parcels array<struct<id: string, x: double, y: double, L_mm: double, W_mm: double, H_mm: double>>")
BOXES = ("capture bigint, boxes array<struct<id: bigint, n_points: bigint, top_face: struct<height_above_conveyor_m: double, coverage: double, plane_residual_rms_m: double>, "
         "dimensions_m: struct<length: double, width: double, height: double>, pickable: boolean, pick_order: bigint, reasons: array<string>>>")
FRAME = "rig string, capture_id bigint, camera string, seq bigint, ts timestamp, host_ts_ns bigint, dev_ts_ns bigint, spread_ms double, n_boxes int"

# fixed values: columns of the grade table, in order
GRADE_FIELDS = [
    "subset", "n_cams", "res", "depth_grid", "cond", "n_points", "coverage_m2", "coverage_frac", "cells_recon", "p_relief", "q_mm", "line_resid_rms_mm",
    "err_median_mm", "err_rms_mm", "err_p95_mm", "n_cells_tops", "top_err_median_mm", "top_err_rms_mm", "top_err_p95_mm", "deck_offset_mm", "deck_rms_mm", "deck_tilt_deg",
    "accuracy_mm", "completeness_mm", "complete_at_10mm", "layer_belt_spread_mm", "layer_above_spread_mm", "layer_belt_sd_mm", "layer_above_sd_mm", "layer_above_n_views",
    "mv1_m2", "mv2_m2", "mv3_m2", "mv1_frac", "mv2_frac", "layer_belt_frame_sd_mm", "layer_belt_frame_range_mm", "layer_n_views_used", "layer_thin_views",
]


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_cameras(spark: SparkSession, intrinsics: str, extrinsics: str) -> DataFrame:
    """One row per camera; an intrinsics file whose camera has no pose is an error."""
    k = _json(spark, intrinsics, INTRINSICS).withColumn("camera", F.coalesce("camera", F.regexp_extract(F.col("_metadata.file_name"), r"^(?:intrinsics_|calib_)?(.*?)(?:_intrinsics)?\.json$", 1)))
    e = _json(spark, extrinsics, EXTRINSICS).select(F.explode("cameras").alias("camera", "pose"))
    j = k.join(e, "camera", "left")
    missing = F.when(F.col("pose").isNull(), F.raise_error(F.concat(F.lit("no extrinsics for camera "), F.col("camera"))).cast("array<double>"))
    m = F.col("camera_matrix")
    return j.select(
        "camera", "lens_id", m[0][0].alias("fx"), m[1][1].alias("fy"), m[0][2].alias("cx"), m[1][2].alias("cy"), F.col("dist_coeffs").alias("dist"),
        F.col("image_size")[0].alias("width"), F.col("image_size")[1].alias("height"), F.coalesce(missing, F.flatten("pose.R")).alias("R"), F.col("pose.t").alias("t"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, BOXES).select("capture", F.col("_metadata.file_path").alias("file"), F.inline("boxes"))


def read_box_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All ``boxes_log*.csv`` below a folder; columns a log lacks are NULL, so are empty cells."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "boxes_log*.csv").text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    # the first field name marks a header line: a log may drift, and appended parts repeat theirs
    heads = files.filter(F.col("value").startswith("capture,")).select("file", F.split("value", ",").alias("names")).dropDuplicates(["file"])
    body = files.filter(~F.col("value").startswith("capture,")).join(heads, "file")
    cells = F.transform(F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.nullif(F.regexp_replace(c, '^"|"$', ""), F.lit("")))
    return body.select("file", F.map_from_arrays("names", F.slice(cells, 1, F.size("names"))).alias("row"))


def box_log_columns(logs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed columns out of the log rows."""
    return logs.select("file", *[F.get(F.map_values(F.map_filter("row", lambda k, v: k == F.lit(c))), F.lit(0)).try_cast(t).alias(c) for c, t in columns.items()])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME).json(path)


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_scene(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(planes, parcels) of a reference scene."""
    s = _json(spark, path, SCENE)
    planes = s.select("source", F.explode(F.array(F.struct(F.lit("deck").alias("surface"), F.col("deck_plane.n").alias("n"), F.col("deck_plane.d").alias("d")),
                                                  F.struct(F.lit("floor").alias("surface"), F.col("floor_plane.n").alias("n"), F.col("floor_plane.d").alias("d")))).alias("p")).select("source", "p.*")
    return planes, s.select("source", F.inline("parcels"))


def read_capture_meta(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, META).select(F.col("_metadata.file_path").alias("file"), "capture_local_time", "skew_ms", F.explode("cameras").alias("camera", "r")).select(
        "file", "capture_local_time", "skew_ms", "camera", F.col("r.serial").alias("serial"), F.col("r.t_call_ns").alias("host_ts_ns"), F.col("r.t_device_ns").alias("dev_ts_ns"), F.col("r.shape").alias("shape"))


def load_correction(spark: SparkSession, path: str, model: str, cameras: list[str], lens_id: str | None = None, view_terms: bool = True) -> DataFrame:
    """alpha, beta and camera-frame plane per camera; refuses another model or lens, alpha <= 0 and a degenerate normal.

    ``view_terms=False`` uses the shared line for every camera: 1/p and -q/p.
    """
    c = _json(spark, path, CORRECTION)
    rows = c.withColumn("camera", F.explode(F.array(*[F.lit(n) for n in cameras]))).withColumn("v", F.try_element_at("views", "camera"))
    alpha = F.col("v.alpha") if view_terms else 1.0 / F.col("shared.p")
    beta = F.col("v.beta") if view_terms else -F.col("shared.q") / F.col("shared.p")
    n = F.col("v.n_cam")
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])

    def refuse(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(text)).cast("double"))

    checks = [refuse(F.col("model") != model, "correction was fitted to another model"), refuse(F.col("v").isNull(), "correction lacks a camera")]
    if lens_id is not None:
        checks.append(refuse(F.col("lens_id") != lens_id, "correction was fitted with another lens"))
    checks += [refuse(alpha <= 0, "alpha must be positive"), refuse(length < 1e-9, "degenerate plane normal")]
    return rows.select("model", "lens_id", "camera", F.coalesce(*checks, alpha).alias("alpha"), beta.alias("beta"), n.alias("n_cam"), F.col("v.d_cam").alias("d_cam"))


def write_capture(df: DataFrame, path: str) -> None:
    """Partitioned by run, capture and camera; writing a capture again replaces just its partitions."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "capture_id", "camera").parquet(path)


def append_box_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_grades(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The fixed columns only, in order; columns a row set lacks are NULL."""
    have = set(df.columns)
    out = df.select(*[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in GRADE_FIELDS])
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_perf(df: DataFrame, path: str, by: list[str], cameras: list[str], metric: str = "metric", value: str = "value") -> None:
    """Long per-frame rows to one wide row per frame with a column per camera and metric."""
    wide = df.withColumn("_c", F.concat_ws("_", metric, "camera")).groupBy(*by).pivot("_c").agg(F.first(value))
    wide.write.mode("append").parquet(path)


def write_split(chosen: DataFrame, rest: DataFrame, path: str) -> None:
    chosen.write.mode("overwrite").parquet(f"{path}/selected")
    rest.write.mode("overwrite").parquet(f"{path}/rest")
