"""Per-camera bias against the other cameras' consensus, pose agreement, and reweighted leave-one-out folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions.geometry import rotation_angle_deg
from voxelloom.operators.groups import median
from voxelloom.operators.planes import classify_camera_bias, smallest_axis, tilt_deg
from voxelloom.operators.robust import huber_weight, reweighted_fit
from voxelloom.session import materialise


def _planes(sums: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    """keys..., n, nx, ny, nz, d from moment sums about a common origin."""
    n = F.col("n")
    cov = F.array(*[F.col(f"s{min(a, b)}{max(a, b)}") / n - F.col(f"s{a}") / n * (F.col(f"s{b}") / n) for a in "xyz" for b in "xyz"])
    e = sums.filter(n >= min_count).withColumn("_e", smallest_axis(cov))
    d = -sum((F.col(f"_e.n{a}") * (F.col(f"s{a}") / n + F.col(f"o{a}")) for a in "yz"), F.col("_e.nx") * (F.col("sx") / n + F.col("ox")))
    return e.select(*keys, "n", "_e.nx", "_e.ny", "_e.nz", d.alias("d"))


def camera_bias(points: DataFrame, cameras: DataFrame, by: list[str], min_count: int = 50) -> DataFrame:
    """Scale, offset and two tilts of every camera against the other cameras' surfaces: by..., camera, scale, offset, near_tilt_deg, far_tilt_deg, verdict.

    ``points``: by..., camera, surface ('near' or 'far'), x, y, z in the rig's frame; ``cameras``: camera, x, y, z of the
    centre. A camera's own planes and those of all other cameras' points together are total least squares fits; the
    latter come from the surface's moments less the camera's own, so nothing is fitted or read twice. Distances from the
    camera to its planes are scale times those to the consensus plus offset, exactly, on both surfaces. A camera or
    consensus without ``min_count`` points on a surface, and surfaces within a micrometre of each other, give NULL.
    """
    origin = points.groupBy(*by, "surface").agg(*[F.avg(c).alias("o" + c) for c in "xyz"])  # sums stay small about it
    rel = points.join(origin, [*by, "surface"]).select(*by, "surface", "camera", "ox", "oy", "oz", *[(F.col(c) - F.col("o" + c)).alias(c) for c in "xyz"])
    names = ["n", *["s" + c for c in "xyz"], *["s" + a + b for a in "xyz" for b in "xyz" if a <= b]]
    sums = rel.groupBy(*by, "surface", "camera").agg(
        F.count(F.lit(1)).alias("n"), *[F.first("o" + c).alias("o" + c) for c in "xyz"], *[F.sum(c).alias("s" + c) for c in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias("s" + a + b) for a in "xyz" for b in "xyz" if a <= b])
    sums = materialise(sums, "bias-moments")
    total = sums.groupBy(*by, "surface").agg(*[F.sum(c).alias("t_" + c) for c in names])
    keys = [*by, "surface", "camera"]
    rest = sums.join(total, [*by, "surface"]).select(*keys, "ox", "oy", "oz", *[(F.col("t_" + c) - F.col(c)).alias(c) for c in names])
    own = _planes(sums, keys, min_count)
    other = _planes(rest, keys, min_count).select(*keys, *[F.col(c).alias("r" + c) for c in ("nx", "ny", "nz", "d")])
    at = cameras.select("camera", *[F.col(c).alias("c" + c) for c in "xyz"])

    def away(p: str):
        return F.abs(sum((F.col(f"{p}n{c}") * F.col("c" + c) for c in "yz"), F.col(f"{p}nx") * F.col("cx")) + F.col(f"{p}d"))

    j = own.join(other, keys).join(at, "camera").select(
        *keys, away("").alias("m"), away("r").alias("r"), tilt_deg((F.col("nx"), F.col("ny"), F.col("nz")), (F.col("rnx"), F.col("rny"), F.col("rnz"))).alias("tilt"))
    wide = j.groupBy(*by, "camera").agg(*[F.max(F.when(F.col("surface") == s, F.col(c))).alias(f"{c}_{s}") for s in ("near", "far") for c in ("m", "r", "tilt")])
    apart = F.col("r_far") - F.col("r_near")
    s = F.when(F.abs(apart) >= 1e-6, (F.col("m_far") - F.col("m_near")) / apart)
    out = wide.withColumn("scale", s).withColumn("offset", F.col("m_far") - F.col("scale") * F.col("r_far"))
    verdict = F.when(F.col("scale").isNotNull(), classify_camera_bias(F.col("scale"), F.col("offset"), F.greatest("tilt_near", "tilt_far")))
    every = points.select(*by, "camera").distinct()
    return every.join(out, [*by, "camera"], "left").select(*by, "camera", "scale", "offset", F.col("tilt_near").alias("near_tilt_deg"), F.col("tilt_far").alias("far_tilt_deg"), verdict.alias("verdict"))


def relative_rotation_error(poses: DataFrame, by: list[str], camera: str = "camera") -> DataFrame:
    """Largest angle, over a run's cameras, between estimated and known rotation relative to the first camera: by..., cameras, rotation_error_deg.

    ``poses``: by..., camera, R_est, R_cal (row-major, rig to camera), one row for each camera. Absolute rotations live in
    different frames; relative ones can be compared. The first camera is the smallest by name; one camera gives 0.
    """
    w = Window.partitionBy(*by).orderBy(camera)  # a rig's cameras
    def relative(r: str):  # R R0^T
        a, b = F.col(r), F.first(r).over(w)
        return F.array(*[sum((a[3 * i + k] * b[3 * j + k] for k in (1, 2)), a[3 * i] * b[3 * j]) for i in range(3) for j in range(3)])

    turned = poses.select(*by, camera, relative("R_est").alias("_e"), relative("R_cal").alias("_c"))
    return turned.groupBy(*by).agg(F.count(F.lit(1)).alias("cameras"), F.max(rotation_angle_deg(F.col("_e"), F.col("_c"))).alias("rotation_error_deg"))


def leave_one_out_reweighted(df: DataFrame, by: list[str], fold: str, x: str, y: str, huber: float = 2.0, iters: int = 6, min_folds: int = 2, scale: str = "median") -> DataFrame:
    """Per fold: the Huber line y = p x + q of the other folds and how it does on this one.

    by..., ``fold``, p, q, n (rows of the fold), median_before, rms_before (of y - x), median_after, rms_after (of the line).
    A row takes part in the fits of all folds but its own, so it is repeated once for each of them: folds are heights or
    planes of a calibration, a handful. Groups with fewer than ``min_folds`` folds are left out, and so are folds whose
    others have no line.
    """
    rows = materialise(df.select(*by, F.col(fold).alias("_fold"), F.col(x).cast("double").alias("_u"), F.col(y).cast("double").alias("_v")).dropna(subset=["_fold", "_u", "_v"]), "fold-rows")
    folds = rows.groupBy(*by).agg(F.collect_set("_fold").alias("_all")).filter(F.size("_all") >= min_folds)
    others = rows.join(folds, by).withColumn("held", F.explode(F.array_except("_all", F.array("_fold")))).select(*by, "held", "_u", "_v")
    keys = [*by, "held"]
    line = reweighted_fit(others, keys, [F.col("_u"), F.lit(1.0)], F.col("_v"), huber_weight(huber), iters, scale=scale)
    line = materialise(line.filter(F.col("coef").isNotNull()).select(*by, F.col("held").alias("_fold"), F.col("coef")[0].alias("p"), F.col("coef")[1].alias("q")), "fold-lines")
    scored = materialise(rows.join(line, [*by, "_fold"]).withColumns({"_b": F.col("_v") - F.col("_u"), "_a": F.col("_v") - F.col("p") * F.col("_u") - F.col("q")}), "fold-scores")
    own = [*by, "_fold"]
    means = scored.groupBy(*own).agg(F.first("p").alias("p"), F.first("q").alias("q"), F.sqrt(F.avg(F.col("_b") * F.col("_b"))).alias("rms_before"), F.sqrt(F.avg(F.col("_a") * F.col("_a"))).alias("rms_after"))
    before, after = median(scored, own, "_b", "median_before"), median(scored, own, "_a", "median_after").drop("n")
    return means.join(before, own).join(after, own).select(*by, F.col("_fold").alias(fold), "p", "q", "n", "median_before", "rms_before", "median_after", "rms_after")
