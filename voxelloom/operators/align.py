"""Registration: rigid and similarity fits from moments, closest-point iterations, gauges, candidate searches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.groups import median, quantiles
from voxelloom.operators.rasters import histogram
from voxelloom.operators.spatial import k_nearest, k_nearest_any, target_cells
from voxelloom.session import few, materialise


FIT = T.StructType([
    T.StructField("R", T.ArrayType(T.DoubleType())), T.StructField("t", T.ArrayType(T.DoubleType())),
    T.StructField("scale", T.DoubleType()), T.StructField("rms", T.DoubleType())])


@F.pandas_udf(FIT)
def _similarity(h: pd.Series, ma: pd.Series, mb: pd.Series, va: pd.Series, vb: pd.Series, with_scale: pd.Series) -> pd.DataFrame:
    rows = []
    for hi, a, b, sa, sb, ws in zip(h, ma, mb, va, vb, with_scale):
        u, s, vt = np.linalg.svd(np.asarray(hi, float).reshape(3, 3))
        sign = np.ones(3)
        if np.linalg.det(vt.T @ u.T) < 0:
            sign[2] = -1.0  # a reflection fits better: take the nearest rotation instead
        r = vt.T @ np.diag(sign) @ u.T
        c = float((s * sign).sum() / sa) if ws and sa > 0 else 1.0
        t = np.asarray(b) - c * r @ np.asarray(a)
        err = sb + c * c * sa - 2 * c * float((s * sign).sum())
        rows.append((r.ravel().tolist(), t.tolist(), c, math.sqrt(max(err, 0.0))))
    return pd.DataFrame(rows, columns=["R", "t", "scale", "rms"])


def similarity(pairs: DataFrame, by: list[str], scale: bool = True, a=("ax", "ay", "az"), b=("bx", "by_", "bz"), min_count: int = 3) -> DataFrame:
    """b = scale R a + t per group from corresponding points; ``scale=False`` fits a rigid motion."""
    agg = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.covar_pop(p, q) for p in a for q in b]).alias("_h"), F.array(*[F.avg(p) for p in a]).alias("_ma"), F.array(*[F.avg(q) for q in b]).alias("_mb"),
        sum((F.var_pop(p) for p in a[1:]), F.var_pop(a[0])).alias("_va"), sum((F.var_pop(q) for q in b[1:]), F.var_pop(b[0])).alias("_vb")).filter(F.col("n") >= min_count)
    return agg.withColumn("_s", _similarity("_h", "_ma", "_mb", "_va", "_vb", F.lit(scale))).select(*by, "n", "_s.*")


def planar_rigid(pairs: DataFrame, by: list[str], a=("ax", "ay"), b=("bx", "by_"), min_count: int = 2) -> DataFrame:
    """Yaw and translation taking a onto b, in closed form."""
    agg = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a[0]).alias("_ax"), F.avg(a[1]).alias("_ay"), F.avg(b[0]).alias("_bx"), F.avg(b[1]).alias("_by"),
        (F.covar_pop(a[0], b[1]) - F.covar_pop(a[1], b[0])).alias("_s"), (F.covar_pop(a[0], b[0]) + F.covar_pop(a[1], b[1])).alias("_c")).filter(F.col("n") >= min_count)
    y = agg.withColumn("yaw", F.atan2("_s", "_c"))
    return y.select(
        *by, "n", "yaw", (F.col("_bx") - (F.cos("yaw") * F.col("_ax") - F.sin("yaw") * F.col("_ay"))).alias("tx"),
        (F.col("_by") - (F.sin("yaw") * F.col("_ax") + F.cos("yaw") * F.col("_ay"))).alias("ty"))


def icp_planar(src: DataFrame, dst: DataFrame, by: list[str], cap: float, iters: int = 40, floor: float = 0.020, keep: float = 0.70, min_pairs: int = 50,
               tol: float = 1e-6, levels: int = 3) -> DataFrame:
    """Closest points, those nearer than max(floor, p70 of all) kept, planar fit, repeat.

    Groups (rigs, or start hypotheses) run together. ``src`` and ``dst`` carry ``pid x y``; ``cap`` is where the
    search starts, not a limit. A group with fewer than ``min_pairs`` keeps its last transform. ``converged``: the
    group's last pass was a fit that moved it by ``tol`` at most.
    """
    s = materialise(src.select(*by, "pid", "x", "y"), "icp-src")
    d = materialise(dst.select(*by, F.col("pid").alias("nn"), F.col("x").alias("bx"), F.col("y").alias("by_")), "icp-dst")
    pose = materialise(s.select(*by).distinct().withColumns({"yaw": F.lit(0.0), "tx": F.lit(0.0), "ty": F.lit(0.0), "rms": F.lit(None).cast("double"), "pairs": F.lit(0).cast("long"), "step": F.lit(1.0), "converged": F.lit(False)}), "icp-pose")
    target = d.withColumnsRenamed({"bx": "x", "by_": "y"})
    index = target_cells(target, by, cap, 1, "nn", ("x", "y"), levels)  # every pass searches the same cells
    for _ in range(iters):
        moved = s.join(pose, by).select(
            *by, "pid", (F.cos("yaw") * F.col("x") - F.sin("yaw") * F.col("y") + F.col("tx")).alias("x"), (F.sin("yaw") * F.col("x") + F.cos("yaw") * F.col("y") + F.col("ty")).alias("y"))
        moved = materialise(moved, "icp-moved")
        nn = k_nearest_any(moved, target, by, cap, 1, "pid", "nn", ("x", "y"), levels, index=index).drop("rank")
        gate = quantiles(nn, by, "dist", {"_g": keep}).drop("n")
        near = nn.join(gate, by).filter(F.col("dist") <= F.greatest(F.col("_g"), F.lit(floor)))
        pairs = near.join(moved, [*by, "pid"]).join(d, [*by, "nn"])
        fit = planar_rigid(pairs.withColumnsRenamed({"x": "ax", "y": "ay"}), by, min_count=min_pairs).select(*by, "n", F.col("yaw").alias("_y"), F.col("tx").alias("_x"), F.col("ty").alias("_t"))
        rms = near.groupBy(*by).agg(F.sqrt(F.avg(F.col("dist") * F.col("dist"))).alias("_rms"))
        j = pose.join(fit, by, "left").join(rms, by, "left")
        ok, step = F.col("_y").isNotNull(), F.greatest(F.abs("_y"), F.abs("_x"), F.abs("_t"))
        pose = materialise(j.select(
            *by, F.when(ok, F.col("yaw") + F.col("_y")).otherwise(F.col("yaw")).alias("yaw"),
            F.when(ok, F.cos("_y") * F.col("tx") - F.sin("_y") * F.col("ty") + F.col("_x")).otherwise(F.col("tx")).alias("tx"),
            F.when(ok, F.sin("_y") * F.col("tx") + F.cos("_y") * F.col("ty") + F.col("_t")).otherwise(F.col("ty")).alias("ty"),
            F.coalesce("_rms", "rms").alias("rms"), F.coalesce("n", "pairs").alias("pairs"),
            F.when(ok, step).otherwise(0.0).alias("step"), (ok & (step <= tol)).alias("converged")), "icp-pose")
        if pose.filter(F.col("step") > tol).isEmpty():
            break
    return pose.drop("step")


def best_start(poses: DataFrame, by: list[str]) -> DataFrame:
    """The hypothesis of least rms per group (``hyp`` is its key)."""
    cols = [c for c in poses.columns if c not in by]
    return poses.groupBy(*by).agg(F.min_by(F.struct(*cols), F.struct(F.col("rms"), F.col("hyp"))).alias("_b")).select(*by, "_b.*")


def ransac_transform(pairs: DataFrame, by: list[str], tol: float, trials: int = 32, seed: int = 0, key: str = "pid", scale: bool = True) -> DataFrame:
    """Three-point similarity hypotheses chosen by hash, counted in one aggregate, refitted on the best one's inliers."""
    a, b = ("ax", "ay", "az"), ("bx", "by_", "bz")
    rows = materialise(pairs.select(*by, key, *a, *b), "ransac-pairs")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)).cast("double") / float(1 << 40)
    pick = rows.join(sizes, by).withColumn("_h", h).filter(F.col("_h") < (18.0 * trials + 60.0) / F.col("_n"))
    w = Window.partitionBy(*by).orderBy("_h", key)
    trip = pick.withColumn("_k", F.row_number().over(w) - 1).filter(F.col("_k") < 3 * trials).withColumn("trial", F.floor(F.col("_k") / 3).cast("int"))
    fits = similarity(trip, [*by, "trial"], scale)
    hyp = fits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("trial", "R", "t", "scale"))).alias("hyp"))

    def err(e: Column) -> Column:
        parts = []
        for i in range(3):
            q = e["R"][3 * i] * F.col("ax") + e["R"][3 * i + 1] * F.col("ay") + e["R"][3 * i + 2] * F.col("az")
            parts.append(F.pow(e["scale"] * q + e["t"][i] - F.col(b[i]), 2))
        return F.sqrt(parts[0] + parts[1] + parts[2])

    counted = rows.join(hyp, by).groupBy(*by).agg(F.first("hyp").alias("hyp"), F.count(F.lit(1)).alias("total"), F.array(*[F.count_if(err(F.get("hyp", F.lit(k))) <= tol) for k in range(trials)]).alias("_c"))
    best = materialise(counted.withColumn("_m", F.array_max("_c")).withColumn("_e", F.get("hyp", (F.array_position("_c", F.col("_m")) - 1).cast("int"))).select(*by, "total", "_e"), "ransac-best")
    near = rows.join(best, by).filter(err(F.col("_e")) <= tol)
    return similarity(near, by, scale).join(best.select(*by, "total"), by).withColumnRenamed("n", "inliers")


def gauge_from_deck(points: DataFrame, by: list[str], along_normal: str, target: Column | float, iters: int = 4, band: float = 0.15, min_points: int = 500, **kw) -> DataFrame:
    """Scale that puts the median of P.n on the deck, refined in a band about it. Equal rows are met once, with a count."""
    goal = target if isinstance(target, Column) else F.lit(float(target))
    rows = points.select(*by, F.col(along_normal).alias("_d"), goal.cast("double").alias("_t"))
    rows = materialise(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_k")), "gauge")
    kw = {"count": "_k", **kw}
    s = materialise(median(rows, by, "_d", "_m", **kw).drop("n").join(rows.groupBy(*by).agg(F.first("_t").alias("_t")), by).select(*by, "_t", (F.col("_t") / F.col("_m")).alias("scale")), "gauge-s")
    for _ in range(iters):
        near = rows.drop("_t").join(few(s), by).filter(F.abs(F.col("scale") * F.col("_d") - F.col("_t")) <= band)
        m = median(near, by, "_d", "_m", **kw).filter(F.col("n") >= min_points).drop("n")
        s = materialise(s.join(m, by, "left").select(*by, "_t", F.coalesce(F.col("_t") / F.col("_m"), F.col("scale")).alias("scale")), "gauge-s")
    return s.drop("_t")


def gauge_multi_camera(points: DataFrame, by: list[str], lo: float = 0.5, hi: float = 4.0, iters: int = 30, tol: float = 1e-9, **kw) -> DataFrame:
    """Scale about each point's own camera at which the median height is zero. NULL without a sign change.

    Height is affine in the scale: ``h0 + s * h1`` with ``h0`` the camera's height and ``h1`` the point's
    height over its camera. The bracket of every group closes in the same pass, one median per pass, by
    false position; an end kept twice weighs half, so both ends move and few passes are needed. Equal
    points are met once, with a count.
    """
    rows = points.select(*by, F.col("h0").cast("double").alias("_a"), F.col("h1").cast("double").alias("_b"))
    rows = materialise(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_k")), "gauge")
    kw = {"count": "_k", **kw}

    def med(at: DataFrame, name: str) -> DataFrame:
        return median(rows.join(at, by).withColumn("_h", F.col("_a") + F.col("_s") * F.col("_b")), by, "_h", name, **kw).drop("n")

    groups = few(materialise(rows.select(*by).distinct(), "gauge-groups"))
    ends = med(groups.withColumn("_s", F.lit(lo)), "_fl").join(med(groups.withColumn("_s", F.lit(hi)), "_fr"), by)
    state = materialise(ends.filter(F.col("_fl") * F.col("_fr") <= 0).select(
        *by, F.lit(lo).alias("_l"), "_fl", F.lit(hi).alias("_r"), "_fr", F.lit(0).alias("_kept"), F.lit(lo).alias("scale"), F.lit(float("inf")).alias("_res")), "gauge-state")
    for _ in range(iters):
        cut = (F.col("_l") * F.col("_fr") - F.col("_r") * F.col("_fl")) / (F.col("_fr") - F.col("_fl"))
        mid = state.withColumn("_s", F.when(F.col("_fr") == F.col("_fl"), F.col("_l")).otherwise(cut))
        f = mid.join(med(few(mid.select(*by, "_s")), "_fm"), by)
        left = F.col("_fl") * F.col("_fm") <= 0  # the root is in the left part: the right end moves
        state = materialise(f.select(
            *by,
            F.when(left, F.col("_l")).otherwise(F.col("_s")).alias("_l"),
            F.when(left, F.col("_fl") * F.when(F.col("_kept") == -1, 0.5).otherwise(1.0)).otherwise(F.col("_fm")).alias("_fl"),
            F.when(left, F.col("_s")).otherwise(F.col("_r")).alias("_r"),
            F.when(left, F.col("_fm")).otherwise(F.col("_fr") * F.when(F.col("_kept") == 1, 0.5).otherwise(1.0)).alias("_fr"),
            F.when(left, -1).otherwise(1).alias("_kept"), F.col("_s").alias("scale"), F.abs("_fm").alias("_res")), "gauge-state")
        if state.filter(F.col("_res") > tol).isEmpty():
            break
    return groups.join(state.select(*by, "scale"), by, "left")


def gauge_diagnose(centres: DataFrame, by: list[str]) -> DataFrame:
    """Similarity between estimated and known camera centres: scale, and residual (NULL for two cameras)."""
    fit = similarity(centres, by, True, min_count=2)
    return fit.select(*by, F.col("n").alias("cameras"), "scale", F.when(F.col("n") > 2, F.col("rms")).alias("centre_residual"))


def grid_search(src: DataFrame, dst: DataFrame, by: list[str], cell: float, yaws: list[float], reach: int) -> DataFrame:
    """Yaw and whole-cell shift with most shared occupied cells, per group.

    Cells, not points, meet the parameter table. Shifts come from the equi-join itself: for a turned
    source cell, every destination cell within ``reach`` votes for the shift between them.
    """
    s = src.select(*by, "iu", "iv").distinct().withColumn("yaw", F.explode(F.array(*[F.lit(float(y)) for y in yaws])))
    x, y = (F.col("iu") + 0.5) * cell, (F.col("iv") + 0.5) * cell
    turned = s.select(*by, "yaw", F.floor((F.cos("yaw") * x - F.sin("yaw") * y) / cell).cast("long").alias("ru"), F.floor((F.sin("yaw") * x + F.cos("yaw") * y) / cell).cast("long").alias("rv")).distinct()
    step = F.sequence(F.lit(-reach), F.lit(reach))
    moved = turned.withColumn("du", F.explode(step)).withColumn("dv", F.explode(step)).select(*by, "yaw", "du", "dv", (F.col("ru") + F.col("du")).alias("iu"), (F.col("rv") + F.col("dv")).alias("iv"))
    hits = moved.join(dst.select(*by, "iu", "iv").distinct(), [*by, "iu", "iv"]).groupBy(*by, "yaw", "du", "dv").agg(F.count(F.lit(1)).alias("shared"))
    best = F.max_by(F.struct("yaw", "du", "dv", "shared"), F.struct(F.col("shared"), -F.abs("du") - F.abs("dv"), -F.abs("yaw"), F.col("du"), F.col("dv"), F.col("yaw")))
    return hits.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def orientation_check(src: DataFrame, dst: DataFrame, by: list[str]) -> DataFrame:
    """Height correlation over shared cells for the four ways a rectangle can be laid on itself."""
    flips = F.explode(F.array(*[F.struct(F.lit(a).alias("fu"), F.lit(b).alias("fv")) for a in (1, -1) for b in (1, -1)]))
    s = src.withColumn("_f", flips).select(*by, "_f.fu", "_f.fv", "h", F.when(F.col("_f.fu") > 0, F.col("iu")).otherwise(-F.col("iu")).alias("iu"), F.when(F.col("_f.fv") > 0, F.col("iv")).otherwise(-F.col("iv")).alias("iv"))
    j = s.join(dst.select(*by, "iu", "iv", F.col("h").alias("_h")), [*by, "iu", "iv"])
    return j.groupBy(*by, "fu", "fv").agg(F.count(F.lit(1)).alias("cells"), F.corr("h", "_h").alias("correlation"))


def consensus_scale_vote(points: DataFrame, by: list[str], h: str, alphas: list[float], bin_size: float, floor_height: float, parcel: tuple[float, float], void: tuple[float, float],
                         top: int = 60) -> DataFrame:
    """Scale and offset at which both the deck (0) and the floor are full: the smaller of two vote counts
    ranks candidates, the ``top`` are rescored by points in the void, in the parcel range and above it.

    Heights are counted per bin first; bins, not points, meet the scales.
    """
    fine = bin_size / 4
    hist = histogram(points, by, h, fine).withColumn("_h", (F.col("bin") + 0.5) * fine).select(*by, "_h", "n")
    votes = hist.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    deck = votes.groupBy(*by, "alpha", F.floor(-F.col("alpha") * F.col("_h") / bin_size).cast("long").alias("b")).agg(F.sum("n").alias("deck"))
    floor = votes.groupBy(*by, "alpha", F.floor((floor_height - F.col("alpha") * F.col("_h")) / bin_size).cast("long").alias("b")).agg(F.sum("n").alias("floor"))
    cand = deck.join(floor, [*by, "alpha", "b"]).withColumn("votes", F.least("deck", "floor"))
    w = Window.partitionBy(*by).orderBy(F.desc("votes"), "alpha", "b")
    short = cand.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).filter(F.col("rank") < top).withColumn("beta", (F.col("b") + 0.5) * bin_size)
    at = F.col("alpha") * F.col("_h") + F.col("beta")
    n = F.col("n")

    def within(lo: float, hi: float) -> Column:
        return F.sum(F.when((at > lo) & (at < hi), n).otherwise(0))

    # a group's histogram and its short list are both small: at most 60 candidates meet each bin
    scored = short.join(hist, by).groupBy(*by, "alpha", "b", "beta", "rank", "votes").agg(
        within(*void).alias("void_points"), within(*parcel).alias("parcel_points"), F.sum(F.when(at >= parcel[1], n).otherwise(0)).alias("sky_points"))
    return scored.withColumn("score", F.col("votes") + F.col("parcel_points") - F.col("void_points") - F.col("sky_points")).drop("b")


def depth_scale_search(src: DataFrame, dst: DataFrame, by: list[str], scales: list[float], cap: float, levels: int = 3, normal_radius: float = 0.05, min_points: int = 100, **kw) -> DataFrame:
    """Relative point-to-plane disagreement at each scale: by..., k, n, p2plane_median, range_median, relative, best.

    At scale k each cloud is scaled about its own camera: the reference ``dst`` about the origin, ``src`` about its
    ``camera``'s centre cx cy cz. A side camera's score is the median distance of its points to the plane of their nearest reference
    point within ``cap`` k over the median range of the reference cloud, a scale's the mean of the sides' with
    ``min_points`` pairs; ``p2plane_median`` is the mean of the sides', ``n`` their pairs. Normals that ``dst`` does not carry are
    estimated (``joins.estimate_normals``). ``best`` marks the scale of least disagreement of a group, the smaller of equals.
    """
    from voxelloom.operators.joins import estimate_normals, point_to_plane

    dst = dst if "nx" in dst.columns else materialise(estimate_normals(dst, by, normal_radius, levels=levels), "scale-normals")
    # clouds are met in units of k: the target is the same at every scale, and the rows of all scales meet it in one search
    s = src.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in scales]))).select(
        *by, "k", "camera", "pid", *[(F.col(c) - F.col("c" + c) + F.col("c" + c) / F.col("k")).alias(c) for c in "xyz"])
    s = materialise(s, "scaled")
    found = k_nearest(s.withColumn("_sid", F.struct("k", "camera", "pid")), dst, by, cap, 1, "_sid", "pid", levels=levels)
    nn = found.select(*by, "_sid.k", "_sid.camera", "_sid.pid", "nn")
    ref = dst.select(*by, F.col("pid").alias("nn"), *[F.col(c).alias("r" + c) for c in "xyz"], "nx", "ny", "nz")
    pairs = materialise(s.join(nn, [*by, "k", "camera", "pid"]).join(ref, [*by, "nn"]), "p2plane")
    side = point_to_plane(pairs, [*by, "k", "camera"], dst, by, min_points, **kw)
    score = materialise(side.groupBy(*by, "k").agg(
        F.sum("n").alias("n"), (F.col("k") * F.avg("p2plane_median")).alias("p2plane_median"), (F.col("k") * F.first("range_median")).alias("range_median"), F.avg("relative").alias("relative")), "scale-scores")
    least = score.groupBy(*by).agg(F.min(F.struct("relative", "k")).alias("_b")).select(*by, F.col("_b.k").alias("_best"))
    return score.join(least, by).withColumn("best", F.col("k") == F.col("_best")).drop("_best")


def photometric_yaw(points: DataFrame, cameras: DataFrame, pixels: DataFrame, by: list[str], yaws: list[float], pid: str = "pid") -> DataFrame:
    """Mean colour variance of points seen by two or more cameras, at each yaw about the vertical."""
    from voxelloom.functions.geometry import project_brown, visible

    p = points.select(*by, pid, "x", "y", "z").withColumn("yaw", F.explode(F.array(*[F.lit(float(y)) for y in yaws])))
    c, s = F.cos("yaw"), F.sin("yaw")
    turned = p.select(*by, "yaw", pid, (c * F.col("x") - s * F.col("y")).alias("x"), (s * F.col("x") + c * F.col("y")).alias("y"), "z")
    u, v, _ = project_brown((F.col("x"), F.col("y"), F.col("z")))
    seen = turned.join(cameras, by).withColumns({"_u": u, "_v": v}).filter(visible(F.col("_u"), F.col("_v"))).select(
        *by, "yaw", pid, "camera", F.rint("_u").cast("long").alias("u"), F.rint("_v").cast("long").alias("v"))
    col = seen.join(pixels.select(*by, "camera", "u", "v", "g"), [*by, "camera", "u", "v"])
    per = col.groupBy(*by, "yaw", pid).agg(F.count(F.lit(1)).alias("_k"), F.var_pop("g").alias("_var")).filter("_k >= 2")
    return per.groupBy(*by, "yaw").agg(F.count(F.lit(1)).alias("points"), F.avg("_var").alias("spread"))


def depth_field_fit(pixels: DataFrame, planes: DataFrame, by: list[str], windows: list[float], ridge: float = 0.0, max_scale_dev: float = 0.2, min_pixels: int = 200) -> tuple[DataFrame, list[DataFrame]]:
    """z' = z (s + a x + b y) + c against every plane (``nx ny nz d`` with n.x = d, camera frame) of the group.

    Each pass gives a pixel the plane whose target depth is nearest, within a shrinking window, and solves
    least squares; a pass outside the guard rails keeps the previous coefficients. Returns (fit, pass logs).
    ``pixels`` carry ``z rx ry``.
    """
    from voxelloom.operators.robust import solve_normal

    arr = planes.groupBy(*by).agg(F.collect_list(F.struct("nx", "ny", "nz", "d")).alias("_pl"))
    rows = materialise(pixels.select(*by, "z", "rx", "ry").filter("z > 0"), "field-rows")
    fit = materialise(rows.select(*by).distinct().withColumns({"s": F.lit(1.0), "a": F.lit(0.0), "b": F.lit(0.0), "c": F.lit(0.0)}), "field")
    logs = []
    for k, window in enumerate(windows):
        now = rows.join(fit, by).join(arr, by).withColumn("_now", F.col("z") * (F.col("s") + F.col("a") * F.col("rx") + F.col("b") * F.col("ry")) + F.col("c"))
        cand = F.transform("_pl", lambda p: p["d"] / (p["nx"] * F.col("rx") + p["ny"] * F.col("ry") + p["nz"]))
        best = F.array_min(F.transform(F.filter(cand, lambda t: t > 0), lambda t: F.struct(F.abs(t - F.col("_now")).alias("e"), t.alias("t"))))
        hit = now.withColumn("_b", best).filter(F.col("_b.e") <= window)
        d = [F.col("z"), F.col("z") * F.col("rx"), F.col("z") * F.col("ry"), F.lit(1.0)]
        prior = [1.0, 0.0, 0.0, 0.0]
        m = [F.sum(d[i] * d[j]) + (ridge * F.count(F.lit(1)) if i == j and ridge else 0.0) for i in range(4) for j in range(4)]
        r = [F.sum(d[i] * F.col("_b.t")) + (ridge * prior[i] * F.count(F.lit(1)) if ridge else 0.0) for i in range(4)]
        new = hit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*m).alias("_m"), F.array(*r).alias("_r"), F.sqrt(F.avg(F.col("_b.e") * F.col("_b.e"))).alias("rms_before")).withColumn("_x", solve_normal("_m", "_r"))
        ok = (F.col("n") >= min_pixels) & (F.abs(F.col("_x")[0] - 1.0) <= max_scale_dev)
        step = materialise(fit.join(new, by, "left").select(
            *by, F.lit(k).cast("long").alias("pass"), F.coalesce(ok, F.lit(False)).alias("accepted"), F.coalesce("n", F.lit(0)).alias("n"), "rms_before",
            *[F.when(ok, F.col("_x")[i]).otherwise(F.col(c)).alias(c) for i, c in enumerate("sabc")]), "field")
        logs.append(step)
        fit = step.select(*by, *"sabc")
    return fit, logs
