"""The whole grade row of a run: deck, raster errors, chamfer, coverage by views and layering against a reference scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.geometry import dot, vec
from voxelloom.operators import rasters, robust
from voxelloom.operators.groups import median
from voxelloom.operators.joins import layer_report
from voxelloom.operators.planes import camera_conditioning, plane_fit, plane_ransac
from voxelloom.operators.spatial import k_nearest_any
from voxelloom.session import materialise
from voxelloom.sources.records import GRADE_FIELDS


def fitted_layer_report(points: DataFrame, centres: DataFrame, by: list[str], camera: str, band: float, above: float, tol: float = 0.010, min_points: int = 100, min_count: int = 50, trials: int = 64, seed: int = 0, pid: str = "pid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layering against the dominant plane of each group's combined cloud: (views, spread, planes).

    ``points``: by..., camera, ``pid``, x, y, z; ``centres``: camera, x, y, z. The plane is the fullest within ``tol``, refitted
    three times, its normal towards the cameras' side. Groups with fewer than ``min_points`` have no report. views and
    spread are those of ``layer_report`` on heights over the plane; planes: by..., nx, ny, nz, d, inliers.
    """
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
    rows = materialise(points.join(sizes.select(*by), by, "left_semi").select(*by, camera, pid, "x", "y", "z"), "layer-points")
    plane = plane_ransac(rows, by, tol, trials, seed, pid, refits=3)
    seen = rows.select(*by, camera).distinct().join(centres.select(camera, *[F.col(c).alias("c" + c) for c in "xyz"]), camera)
    side = seen.join(plane, by).groupBy(*by).agg(F.avg(dot(vec("nx", "ny", "nz"), vec("cx", "cy", "cz")) + F.col("d")).alias("_side"))
    sign = F.when(F.col("_side") < 0, -1.0).otherwise(1.0)
    plane = materialise(plane.join(side, by).select(*by, *[(sign * F.col(c)).alias(c) for c in ("nx", "ny", "nz", "d")], "inliers"), "layer-plane")
    high = rows.join(plane, by).withColumn("h", dot(vec("nx", "ny", "nz"), vec("x", "y", "z")) + F.col("d"))
    views, spread = layer_report(high, by, camera, "h", band, above, min_count)
    return views, spread, plane


def grade_table(
    runs: DataFrame, fused: DataFrame, views: DataFrame, reference: DataFrame, centres: DataFrame, by: list[str], cell: float, half_u: float, half_v: float, margin: float = 0.05, deck_band: float = 0.030,
    top_height: float = 0.060, view_band: tuple[float, float] = (0.05, 0.60), near: float = 0.010, cap: float = 0.20, huber: float = 2.0, layer_band: float = 0.040, layer_above: float = 0.060,
    layer_tol: float = 0.010, min_deck: int = 500, min_cells: int = 200, min_tops: int = 50, min_view: int = 200, min_layer: int = 50, unit: float = 1000.0, pid: str = "pid",
) -> DataFrame:
    """by... and every column of ``GRADE_FIELDS`` for each run; what cannot be measured is NULL.

    ``runs``: by..., scene, subset, res, depth_grid. ``fused``: by..., ``pid``, u, v, h, the fused cloud in the belt frame.
    ``views``: by..., camera, ``pid``, u, v, h, each camera's cloud. ``reference``: scene, ``pid``, u, v, h. ``centres``: camera,
    x, y, z in the same frame. Lengths are in units of 1 / ``unit`` of what ``_mm`` columns hold.

    A reference raster, and the reference cloud, meets the runs of its scene by an equi-join. Statistics of cells are one
    aggregate over the shared cells of all runs, whose number the raster bounds; medians of points go through the helpers
    that keep hot runs apart.
    """
    meta = materialise(runs.select(*by, "scene", "subset", "res", "depth_grid"), "grade-runs")
    keys = meta.select(*by, "scene")
    fused = fused.select(*by, pid, "u", "v", "h")
    ras = materialise(rasters.height_raster(fused, by, cell, half_u, half_v, margin).select(*by, "iu", "iv", F.col("h").alias("hr")), "grade-raster")
    gt = materialise(rasters.height_raster(reference, ["scene"], cell, half_u, half_v, margin).select("scene", "iu", "iv", F.col("h").alias("hg")), "grade-reference")
    both = materialise(ras.join(keys, by).join(gt, ["scene", "iu", "iv"]).select(*by, "hr", "hg", ((F.col("hr") - F.col("hg")) * unit).alias("e")), "grade-cells")
    gt_cells = gt.groupBy("scene").agg(F.count(F.lit(1)).alias("_gt"))
    shared = both.groupBy(*by).agg(F.count(F.lit(1)).alias("_shared"))
    cover = ras.groupBy(*by).agg(F.count(F.lit(1)).alias("cells_recon")).join(keys, by).join(gt_cells, "scene", "left").join(shared, by, "left")
    cover = cover.select(*by, "cells_recon", (F.col("cells_recon") * cell * cell).alias("coverage_m2"), (F.coalesce("_shared", F.lit(0)) / F.greatest(F.coalesce("_gt", F.lit(0)), F.lit(1))).alias("coverage_frac"), F.coalesce("_shared", F.lit(0)).alias("_shared"))

    on_belt = rasters.on_belt(fused, half_u + margin, half_v + margin)
    deck = materialise(on_belt.filter(F.abs("h") <= deck_band), "grade-deck")
    tilt = plane_fit(deck, by, ("u", "v", "h")).filter(F.col("n") > min_deck).select(*by, F.degrees(F.acos(F.least(F.abs("nz"), F.lit(1.0)))).alias("deck_tilt_deg"))
    deck_stat = median(deck, by, "h", "_m").drop("n").join(deck.groupBy(*by).agg(F.sqrt(F.avg(F.col("h") * F.col("h"))).alias("_r")), by).join(tilt, by)
    deck_stat = deck_stat.select(*by, (F.col("_m") * unit).alias("deck_offset_mm"), (F.col("_r") * unit).alias("deck_rms_mm"), "deck_tilt_deg")

    line = robust.robust_line(both, by, "hg", "hr", huber).drop("n")
    resid = (F.col("hr") - (F.col("p") * F.col("hg") + F.col("q"))) * unit
    e, top = F.col("e"), F.col("hg") > top_height
    stat = both.join(line, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.first("p").alias("p_relief"), (F.first("q") * unit).alias("q_mm"), F.sqrt(F.avg(resid * resid)).alias("line_resid_rms_mm"), F.percentile("e", F.lit(0.5)).alias("err_median_mm"),
        F.sqrt(F.avg(e * e)).alias("err_rms_mm"), F.percentile(F.abs("e"), F.lit(0.95)).alias("err_p95_mm"), F.count_if(top).alias("_tops"), F.percentile(F.when(top, e), F.lit(0.5)).alias("top_err_median_mm"),
        F.sqrt(F.avg(F.when(top, e * e))).alias("top_err_rms_mm"), F.percentile(F.when(top, F.abs("e")), F.lit(0.95)).alias("top_err_p95_mm")).filter(F.col("_n") >= min_cells)
    high = F.col("_tops") > min_tops
    stat = stat.select(*by, "p_relief", "q_mm", "line_resid_rms_mm", "err_median_mm", "err_rms_mm", "err_p95_mm", F.when(high, F.col("_tops")).alias("n_cells_tops"), *[F.when(high, F.col(c)).alias(c) for c in ("top_err_median_mm", "top_err_rms_mm", "top_err_p95_mm")])

    # chamfer: both clouds on the belt, each to the nearest of the other at any distance; only graded runs take part
    graded = materialise(stat.select(*by).join(keys, by), "grade-graded")
    def places(cloud: DataFrame) -> DataFrame:
        """Points on one place as one with its own ``_at``, and their number: they have the same neighbour."""
        return cloud.groupBy(*by, "x", "y", "z").agg(F.count(F.lit(1)).alias("_times")).withColumn("_at", F.monotonically_increasing_id())

    mine = materialise(places(on_belt.join(graded.select(*by), by, "left_semi").withColumnsRenamed({"u": "x", "v": "y", "h": "z"})), "grade-mine")
    other = materialise(places(rasters.on_belt(reference, half_u + margin, half_v + margin).join(graded, "scene").select(*by, F.col("u").alias("x"), F.col("v").alias("y"), F.col("h").alias("z"))), "grade-other")
    dists = lambda a, b: k_nearest_any(a, b, by, cap, 1, "_at", "_at").join(a.select(*by, "_at", "_times"), [*by, "_at"])
    there = median(dists(mine, other), by, "dist", "_a", count="_times").drop("n")
    back = materialise(dists(other, mine), "grade-back")
    complete = F.sum(F.when(F.col("dist") < near, F.col("_times")).otherwise(0)) / F.sum("_times")
    chamfer = there.join(median(back, by, "dist", "_c", count="_times").drop("n"), by).join(back.groupBy(*by).agg(complete.alias("complete_at_10mm")), by)
    chamfer = chamfer.select(*by, (F.col("_a") * unit).alias("accuracy_mm"), (F.col("_c") * unit).alias("completeness_mm"), "complete_at_10mm")

    # coverage by views, over the cells where the reference has a parcel; the reference raster has a margin of cells
    shift = int(margin / cell)
    nu, nv = int(2 * half_u / cell) + 1, int(2 * half_v / cell) + 1
    tops = gt.filter(F.col("hg") > view_band[0]).select("scene", (F.col("iu") - shift).alias("iu"), (F.col("iv") - shift).alias("iv")).filter((F.col("iu") >= 0) & (F.col("iu") < nu) & (F.col("iv") >= 0) & (F.col("iv") < nv))
    domain = materialise(graded.join(tops, "scene").select(*by, "iu", "iv"), "grade-domain")
    flat = views.select(*by, "camera", pid, "u", "v", "h")
    mv = rasters.multi_view_coverage(flat.join(graded.select(*by), by, "left_semi"), by, cell, half_u, half_v, *view_band, domain=domain)
    mv = mv.select(*by, *[f"mv{k}_m2" for k in (1, 2, 3)], *[(F.col(f"mv{k}_m2") / F.greatest("belt_m2", F.lit(1e-9))).alias(f"mv{k}_frac") for k in (1, 2)])

    # each view's offset from the frozen belt plane
    cams = materialise(flat.select(*by, "camera").distinct().join(graded.select(*by), by, "left_semi"), "grade-cameras")
    band = rasters.on_belt(flat, half_u, half_v).filter((F.col("h") > view_band[0]) & (F.col("h") < view_band[1])).join(graded.select(*by), by, "left_semi")
    offset = median(band, [*by, "camera"], "h", "_o").filter(F.col("n") >= min_view)
    frame = offset.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"), (F.stddev_samp("_o") * unit).alias("_sd"), ((F.max("_o") - F.min("_o")) * unit).alias("_range"))
    more = F.col("_k") > 1
    frame = cams.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")).join(frame, by, "left").select(
        *by, F.when(more, F.col("_sd")).alias("layer_belt_frame_sd_mm"), F.when(more, F.col("_range")).alias("layer_belt_frame_range_mm"), F.when(more, F.col("_k")).alias("layer_n_views_used"), (F.col("_all") - F.coalesce("_k", F.lit(0))).alias("layer_thin_views"))

    sound = cams.groupBy(*by).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(*by)
    own = flat.join(sound, by, "left_semi").withColumnsRenamed({"u": "x", "v": "y", "h": "z"})
    _, spread, _ = fitted_layer_report(own, centres, by, "camera", layer_band, layer_above, layer_tol, min_count=min_layer, pid=pid)
    level = spread.groupBy(*by).agg(*[F.max(F.when(F.col("level") == k, F.col(c) * s)).alias(n) for k, c, s, n in (
        ("belt", "range", unit, "layer_belt_spread_mm"), ("above", "range", unit, "layer_above_spread_mm"), ("belt", "sd", unit, "layer_belt_sd_mm"), ("above", "sd", unit, "layer_above_sd_mm"), ("above", "n_views", 1, "layer_above_n_views"))])

    every = flat.select(*by, "camera").distinct()
    cond = camera_conditioning(every.join(centres.select("camera", "x", "y", "z"), "camera"), by).select(*by, "n_cams", F.col("conditioning").alias("cond"))
    out = meta.drop("scene").join(fused.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points")), by, "left").join(cover.drop("_shared"), by, "left")
    for part in (cond, deck_stat, stat, chamfer, mv, frame, level):
        out = out.join(part, by, "left")
    return out.select(*by, *[F.col(c) for c in GRADE_FIELDS if c not in by])
