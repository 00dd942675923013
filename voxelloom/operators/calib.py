"""Audits of calibration data: corners, poses, intrinsics, clocks, coverage by subset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.groups import median, quantiles


def calibration_views(corners: DataFrame, by: list[str], view: str, residual: str, mult: float = 2.0, **kw) -> DataFrame:
    """rms of corner residual per view, and whether it exceeds ``mult`` times the median over views."""
    v = corners.groupBy(*by, view).agg(F.count(F.lit(1)).alias("corners"), F.sqrt(F.sum(F.col(residual) * F.col(residual)) / F.count(F.lit(1))).alias("rms"))
    return v.join(median(v, by, "rms", "median_rms", **kw).drop("n"), by).withColumn("dropped", F.col("rms") > mult * F.col("median_rms"))


def frame_coverage(corners: DataFrame, by: list[str], width: float, height: float, grid: int = 8, u: str = "u", v: str = "v") -> DataFrame:
    """Share of the grid x grid image cells that hold a corner."""
    gu = F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.col(u) * grid / width)))
    gv = F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.col(v) * grid / height)))
    return corners.groupBy(*by).agg((F.count_distinct(gu * grid + gv) / float(grid * grid)).alias("coverage"))


def pair_coverage(corners: DataFrame, by: list[str], camera: str = "camera", frame: str = "frame") -> DataFrame:
    """Frames two cameras of a rig share. Frames hold one row per camera here, so pairs stay few."""
    f = corners.select(*by, F.col(camera).alias("cam_a"), frame).distinct()
    g = f.withColumnRenamed("cam_a", "cam_b")
    return f.join(g, [*by, frame]).filter("cam_a < cam_b").groupBy(*by, "cam_a", "cam_b").agg(F.count(F.lit(1)).alias("shared_frames"))


def focal_spread(cameras: DataFrame, by: list[str], camera: str = "camera", fx: str = "fx") -> DataFrame:
    return cameras.groupBy(*by).agg(
        ((F.max(fx) - F.min(fx)) / F.avg(fx)).alias("spread"), F.min_by(camera, F.struct(fx, camera)).alias("lowest"), F.max_by(camera, F.struct(fx, camera)).alias("highest"))


def matmul3(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def chain_consistency(poses: DataFrame, by: list[str]) -> DataFrame:
    """For a->b, b->c and a->c poses (``cam_a cam_b R t``): angle and distance between composed and direct."""
    from voxelloom.functions.geometry import rotation_angle_deg

    ab = poses.select(*by, F.col("cam_a").alias("a"), F.col("cam_b").alias("b"), F.col("R").alias("R1"), F.col("t").alias("t1"))
    bc = poses.select(*by, F.col("cam_a").alias("b"), F.col("cam_b").alias("c"), F.col("R").alias("R2"), F.col("t").alias("t2"))
    ac = poses.select(*by, F.col("cam_a").alias("a"), F.col("cam_b").alias("c"), F.col("R").alias("R3"), F.col("t").alias("t3"))
    j = ab.join(bc, [*by, "b"]).join(ac, [*by, "a", "c"])
    r = j.withColumn("_R", matmul3(F.col("R2"), F.col("R1")))
    gap = [F.col("R2")[3 * i] * F.col("t1")[0] + F.col("R2")[3 * i + 1] * F.col("t1")[1] + F.col("R2")[3 * i + 2] * F.col("t1")[2] + F.col("t2")[i] - F.col("t3")[i] for i in range(3)]
    return r.select(*by, "a", "b", "c", rotation_angle_deg(F.col("_R"), F.col("R3")).alias("angle_deg"), F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("offset"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def nearest_rotation(m: pd.Series) -> pd.Series:
    """Rotation closest to each summed 3x3 (the chordal mean)."""
    out = []
    for a in m:
        u, _, vt = np.linalg.svd(np.asarray(a, float).reshape(3, 3))
        d = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
        out.append((u @ d @ vt).ravel().tolist())
    return pd.Series(out)


def relative_pose_spread(poses: DataFrame, by: list[str]) -> DataFrame:
    """Deviation angles of per-frame relative rotations from their chordal mean, and sd of the translations."""
    from voxelloom.functions.geometry import rotation_angle_deg

    sums = poses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), F.array(*[F.sum(F.col("R")[i]) for i in range(9)]).alias("_S"),
        *[F.stddev_pop(F.col("t")[i]).alias(f"t{i}_sd") for i in range(3)])
    mean = sums.withColumn("_mean", nearest_rotation("_S")).drop("_S")
    dev = poses.select(*by, "R").join(mean.select(*by, "_mean"), by).withColumn("_a", rotation_angle_deg(F.col("R"), F.col("_mean")))
    stat = dev.groupBy(*by).agg(F.avg("_a").alias("angle_mean"), F.max("_a").alias("angle_max"))
    return mean.drop("_mean").join(stat, by)


def sharpness_percentiles(samples: DataFrame, by: list[str], value: str, min_count: int = 5, **kw) -> DataFrame:
    return quantiles(samples, by, value, {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}, **kw).filter(F.col("n") >= min_count)


def intrinsics_consistency(rows: DataFrame, by: list[str], order: list[str], fx: str, scaled_fx: str, tol: float = 1e-3) -> DataFrame:
    """Focal length against the first subset's, and the ratio to the scaled input with a 2 per cent flag."""
    first = rows.groupBy(*by).agg(F.min_by(fx, F.struct(*order)).alias("_first"))
    j = rows.join(first, by)
    ratio = F.col(fx) / F.col(scaled_fx)
    return j.withColumn("same_as_first", F.abs(F.col(fx) - F.col("_first")) <= tol).withColumn("fx_ratio", ratio).withColumn(
        "flagged", (ratio < 0.98) | (ratio > 1.02)).drop("_first")


def skew_report(frames: DataFrame, by: list[str], camera: str = "camera", device: str = "dev_ts_ns", host: str = "host_ts_ns") -> DataFrame:
    """Largest minus smallest device time per capture (host clock if any is missing) in ms, and the camera whose device clock is latest (none on the host clock)."""
    use_dev = F.count(device) == F.count(F.lit(1))
    agg = frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cameras"), F.when(use_dev, F.lit("device")).otherwise("host").alias("clock"),
        F.when(use_dev, F.max(device) - F.min(device)).otherwise(F.max(host) - F.min(host)).alias("_span"),
        F.when(use_dev, F.max(F.struct(F.col(device).alias("t"), F.col(camera).alias("c")))["c"]).alias("worst_camera"))
    return agg.select(*by, "cameras", "clock", (F.col("_span") / 1e6).alias("skew_ms"), "worst_camera")


def exposure_uniformity(readback: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    agg = readback.groupBy(*by).agg(*[F.count_distinct(c).alias(c + "_values") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(c + "_values") <= 1)
    return agg.withColumn("uniform", same)


def coverage_gated(cells: DataFrame, by: list[str], n_cams: int, cell: float, max_incidence: float = 70.0) -> DataFrame:
    """Subset coverage with and without the incidence gate; ``cells`` carry ``iu iv bit incidence``."""
    from voxelloom.operators.joins import subset_visibility

    free = subset_visibility(cells, by, n_cams, cell).select(*by, "subset", "n_cams", F.col("area").alias("area_all"))
    gated = subset_visibility(cells.filter(F.col("incidence") <= max_incidence), by, n_cams, cell).select(*by, "subset", F.col("area").alias("area_gated"))
    return free.join(gated, [*by, "subset"], "left").na.fill(0.0, ["area_gated"])


def camera_subsets(cameras: DataFrame, by: list[str], camera: str = "camera") -> DataFrame:
    """Every non-empty subset of a rig's cameras, named in canonical order. A rig has few cameras."""
    sets = cameras.groupBy(*by).agg(F.array_sort(F.collect_set(camera)).alias("_all"))
    masks = F.explode(F.sequence(F.lit(1).cast("long"), F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2), F.size("_all")).cast("long") - 1))
    picked = F.expr("filter(_all, (c, i) -> (shiftright(_m, i) & 1) = 1)")
    return sets.withColumn("_m", masks).withColumn("cameras", picked).select(
        *by, F.col("_m").alias("mask"), F.array_join(F.col("cameras"), "+").alias("subset"), F.size("cameras").cast("long").alias("n_cams"))


def visible_views(points: DataFrame, cameras: DataFrame, by: list[str], margin: float = 0.0, distorted: bool = True, pid: str = "pid") -> DataFrame:
    """Number of a rig's cameras that see each point. ``cameras`` share ``by`` with the points."""
    from voxelloom.functions.geometry import project_brown, project_pinhole, vec, visible

    cams = cameras.withColumnRenamed("camera", "_cam")
    j = points.select(*by, pid, "x", "y", "z").join(cams, by) if by else points.select(pid, "x", "y", "z").withColumn("_j", F.lit(0)).join(
        cams.agg(F.collect_list(F.struct(*cams.columns)).alias("_cams")).withColumn("_j", F.lit(0)), "_j").select(pid, "x", "y", "z", F.explode("_cams").alias("_c")).select(pid, "x", "y", "z", "_c.*")
    u, v, _ = (project_brown if distorted else project_pinhole)(vec("x", "y", "z"))
    return j.groupBy(*by, pid).agg(F.count_if(visible(u, v, margin)).alias("n_views"))
