"""Scale and offset of each camera's depth, frame by frame, from the deck and the dominant surface above it.

Planes here are n.x = offset with offset >= 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.geometry import cam_to_rig, dot, plane_target_depth, plane_to_camera, vec
from voxelloom.operators.groups import median
from voxelloom.operators.planes import plane_fit, plane_ransac, signed_distance
from voxelloom.operators.robust import huber_weight, reweighted_fit
from voxelloom.session import materialise


def _deck(ref: DataFrame, by: list[str], tol: float, min_points: int, pid: str, trials: int, seed: int, refits: int = 2) -> DataFrame:
    """(by, n_ref, inliers, nx, ny, nz, off): the fullest plane of each frame with enough points, refitted on its inliers."""
    sizes = ref.groupBy(*by).agg(F.count(F.lit(1)).alias("n_ref")).filter(F.col("n_ref") >= min_points)
    rows = materialise(ref.join(sizes.select(*by), by, "left_semi"), "deck-rows")
    plane = plane_ransac(rows, by, tol, trials, seed, pid, refits=0).filter(F.col("inliers") >= min_points // 4).select(*by, "inliers", "nx", "ny", "nz", "d")
    for _ in range(refits):
        near = rows.join(plane, by).filter(F.abs(signed_distance()) <= tol).select(*by, "x", "y", "z")
        fit = plane_fit(near, by, min_count=10).select(*by, *[F.col(c).alias("_" + c) for c in ("nx", "ny", "nz", "d")])
        plane = materialise(plane.join(fit, by, "left").select(*by, "inliers", *[F.coalesce("_" + c, c).alias(c) for c in ("nx", "ny", "nz", "d")]), "deck")
    sign = F.when(F.col("d") > 0, -1.0).otherwise(1.0)
    return plane.join(sizes, by).select(*by, "n_ref", "inliers", *[(sign * F.col(c)).alias(c) for c in ("nx", "ny", "nz")], (-sign * F.col("d")).alias("off"))


def _upper(ref: DataFrame, deck: DataFrame, by: list[str], band: tuple[float, float], min_points: int, bin_size: float, smooth: float, tol: float, min_span: float) -> DataFrame:
    """(by, peak, n_band, upper_note): height of the tallest smoothed histogram bin over the deck; peak is NULL with a note where none will do.

    A frame has at most (band / bin_size) bins, so bins are counted before anything meets them.
    """
    h = materialise(ref.join(deck, by).withColumn("h", dot(vec("nx", "ny", "nz"), vec("x", "y", "z")) - F.col("off")).filter(F.col("h").between(*band)).select(*by, "h"), "heights")
    span = h.groupBy(*by).agg(F.count(F.lit(1)).alias("n_band"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    span = materialise(span.withColumn("bins", F.greatest(F.lit(8), F.floor((F.col("hi") - F.col("lo")) / bin_size).cast("int"))), "height-spans")
    enough = span.filter((F.col("n_band") >= min_points) & (F.col("hi") > F.col("lo")))
    at = F.least(F.floor((F.col("h") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")).cast("int"), F.col("bins") - 1)
    k = max(1, round(smooth / bin_size))
    first = (k - 1) // 2
    counts = h.join(enough, by).groupBy(*by, "lo", "hi", "bins", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spread = counts.withColumn("bin", F.explode(F.sequence(F.col("bin") - first, F.col("bin") - first + k - 1))).filter("bin >= 0 and bin < bins")
    smoothed = spread.groupBy(*by, "lo", "hi", "bins", "bin").agg(F.sum("n").alias("n"))
    best = smoothed.groupBy(*by, "lo", "hi", "bins").agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("bin"))
    peak = best.select(*by, (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("bins")).alias("peak"))
    near = h.join(peak, by).groupBy(*by, "peak").agg(F.count_if(F.abs(F.col("h") - F.col("peak")) <= 2 * tol).alias("near"))
    note = F.when(F.coalesce("n_band", F.lit(0)) < min_points, "too few points above the deck").when(F.coalesce("near", F.lit(0)) < min_points // 2, "the tallest surface is thin").when(
        F.col("peak") < min_span, "too near the deck")
    out = deck.select(*by).join(span.select(*by, "n_band"), by, "left").join(near, by, "left").withColumn("upper_note", note)
    return out.select(*by, F.when(F.col("upper_note").isNull(), F.col("peak")).alias("peak"), F.coalesce("n_band", F.lit(0).cast("long")).alias("n_band"), "upper_note")


def two_plane_proposals(
    pixels: DataFrame, cameras: DataFrame, by: list[str], reference: str, base: dict[str, float] | None = None, pid: str = "pid", plane_tol: float = 0.010, assign_tol: float = 0.08,
    min_points: int = 2000, band: tuple[float, float] = (0.040, 0.600), upper_min_points: int = 600, upper_bin: float = 0.005, upper_smooth: float = 0.015, min_span: float = 0.080,
    min_plane_points: int = 400, scale_bounds: tuple[float, float] = (0.90, 1.10), iters: int = 4, trials: int = 64, seed: int = 0,
) -> DataFrame:
    """z_true = a z + b of every camera in every frame (``by``), against two planes seen by the reference camera.

    ``pixels``: by..., camera, ``pid``, z, rx, ry (ray of unit depth); ``cameras``: camera, R, t (rig to camera). The
    deck is the fullest plane of the reference camera's points; the second plane is parallel to it at the tallest peak of
    heights in ``band``. Pixels of another camera within ``assign_tol`` of where a plane should be are its samples (of
    both planes if they are that near). Two planes with ``min_plane_points`` each give a Huber line; otherwise, and when
    the scale leaves ``scale_bounds``, the scale is ``base`` (1 where it says nothing) and b the median offset.

    Returns by..., camera, ok, reason, model, a, b, n, residual, mad, deck_offset, upper_offset, upper_note: one row for
    each frame and camera. A frame without a usable deck is not ok, with the reason; a and b are NULL there, and for a
    camera without samples (model ``none``). The reference is always (1, 0). A frame whose pixels are all without depth
    still has its rows.
    """
    z = F.col("z")
    cams = cameras.select("camera", "R", "t")
    rows = materialise(pixels.filter((z > 0) & ~F.isnan("z") & (z < float("inf"))).select(*by, "camera", pid, F.col("z").cast("double").alias("z"), F.col("rx").cast("double").alias("rx"), F.col("ry").cast("double").alias("ry")), "align-pixels")
    frames = materialise(pixels.select(*by).distinct(), "align-frames")
    x, y, w = cam_to_rig((F.col("rx") * z, F.col("ry") * z, z))
    ref = materialise(rows.filter(F.col("camera") == reference).join(cams, "camera").select(*by, pid, x.alias("x"), y.alias("y"), w.alias("_w")).withColumnRenamed("_w", "z"), "align-reference")
    deck = materialise(_deck(ref, by, plane_tol, min_points, pid, trials, seed), "deck")
    upper = materialise(_upper(ref, deck, by, band, upper_min_points, upper_bin, upper_smooth, plane_tol, min_span), "upper")
    planes = deck.join(upper, by).withColumn("offs", F.array_compact(F.array(F.col("off"), F.col("off") + F.col("peak"))))

    others = rows.filter(F.col("camera") != reference).join(planes.select(*by, "nx", "ny", "nz", "offs"), by).join(cams, "camera")
    nc, shift = plane_to_camera(vec("nx", "ny", "nz"), F.lit(0.0))

    def hit(off: Column, k: Column) -> Column:
        return F.struct(k.alias("plane"), plane_target_depth((F.col("rx"), F.col("ry"), F.lit(1.0)), nc, off + shift).alias("zt"))

    near = F.filter(F.transform("offs", hit), lambda p: F.abs(F.col("z") - p["zt"]) <= assign_tol)
    cam_key = [*by, "camera"]
    samples = materialise(others.withColumn("_p", F.explode(near)).select(*cam_key, "_p.plane", "z", "_p.zt"), "align-samples")
    counts = samples.groupBy(*cam_key, "plane").agg(F.count(F.lit(1)).alias("n")).groupBy(*cam_key).agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= min_plane_points).alias("usable"))
    lined = counts.join(upper.filter(F.col("peak") >= min_span).select(*by), by, "left_semi").filter((F.col("usable") >= 2) & (F.col("n") >= min_points)).select(*cam_key)
    line = reweighted_fit(samples.join(lined, cam_key, "left_semi"), cam_key, [F.col("z"), F.lit(1.0)], F.col("zt"), huber_weight(1.345), iters, scale="mad")
    known = F.lit(1.0)
    if base:
        known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in base.items() for v in pair]), F.col("camera").cast("string")), known)
    sound = F.col("coef")[0].between(*scale_bounds)
    model = F.when(F.col("coef").isNull(), "offset_only").when(sound, "affine").otherwise("offset_only_scale_rejected")
    scaled = counts.join(line.select(*cam_key, "coef"), cam_key, "left").select(*cam_key, "n", model.alias("model"), F.when(sound, F.col("coef")[0]).otherwise(known).cast("double").alias("a"), F.when(sound, F.col("coef")[1]).alias("_b"))
    scaled = materialise(scaled, "align-scales")
    offset = median(samples.join(scaled.filter(F.col("_b").isNull()), cam_key), cam_key, F.col("zt") - F.col("a") * F.col("z"), "_o").drop("n")
    fit = materialise(scaled.join(offset, cam_key, "left").select(*cam_key, "n", "model", "a", F.coalesce("_b", "_o").alias("b")), "align-fits")
    resid = samples.join(fit, cam_key).withColumn("_r", F.col("zt") - F.col("a") * F.col("z") - F.col("b"))
    middle = materialise(median(resid, cam_key, "_r", "residual").drop("n"), "align-residuals")
    spread = median(resid.join(middle, cam_key), cam_key, F.abs(F.col("_r") - F.col("residual")), "mad").drop("n")

    is_ref = F.col("camera") == reference
    reason = F.when(F.col("off").isNull(), F.when(F.coalesce("n_seen", F.lit(0)) < min_points, "too few reference points").otherwise("no usable deck plane"))
    seen = ref.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seen"))
    # a rig has a handful of cameras: each frame's row is repeated for them without a join on a constant
    names = F.array(*[F.lit(r["camera"]) for r in cams.select("camera").distinct().orderBy("camera").collect()])
    every = frames.join(seen, by, "left").join(planes.select(*by, "off", "peak", "inliers", "upper_note"), by, "left").withColumn("camera", F.explode(names))
    joined = every.join(fit, cam_key, "left").join(middle, cam_key, "left").join(spread, cam_key, "left")
    ok = F.col("off").isNotNull()
    one = ok & is_ref
    return joined.select(
        *by, "camera", ok.alias("ok"), reason.alias("reason"), F.when(one, "reference").when(ok, F.coalesce("model", F.lit("none"))).alias("model"),
        F.when(one, 1.0).otherwise(F.col("a")).alias("a"), F.when(one, 0.0).otherwise(F.col("b")).alias("b"), F.when(one, F.col("inliers")).otherwise(F.coalesce("n", F.lit(0).cast("long"))).alias("n"),
        F.when(one, 0.0).otherwise(F.col("residual")).alias("residual"), "mad", F.col("off").alias("deck_offset"), (F.col("off") + F.col("peak")).alias("upper_offset"), "upper_note")
