"""The grading plan: every run compared with the reference cloud, one row per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import joins, planes, rasters, robust
from voxelloom.operators.groups import median, quantiles
from voxelloom.plans.catalog import query, rounded
from voxelloom.plans.clouds import BY, CELL, HU, HV, INSIDE, M, VERSUS, irls_sql
from voxelloom.session import materialise


def grade_runs(points: DataFrame, reference: DataFrame, by: list[str], cell: float, half_u: float, half_v: float, margin: float, deck_band: float, top_height: float,
               huber: float = 2.0, min_cells: int = 200, min_tops: int = 50, min_deck: int = 500) -> DataFrame:
    """Deck offset and rms, coverage, line through heights, height errors and parcel-top errors per run.

    ``points`` and ``reference`` are in the belt frame (``u v h``). Rasters are written once and shared by
    the statistics; all statistics of a run are aggregates keyed by ``by``.
    """
    ras = materialise(rasters.height_raster(points, by, cell, half_u, half_v, margin), "raster")
    gt = materialise(rasters.height_raster(reference, [], cell, half_u, half_v, margin), "raster")
    both = materialise(joins.cell_compare(ras, gt, by), "compared")
    cover = joins.coverage_fraction(ras, gt, by).withColumn("coverage_m2", F.col("cells_recon") * cell * cell)
    deck = rasters.on_belt(points, half_u + margin, half_v + margin).filter(F.abs("h") <= deck_band)
    deck_stat = median(deck, by, "h", "deck_offset").filter(F.col("n") >= min_deck).drop("n").join(
        deck.groupBy(*by).agg(F.sqrt(F.avg(F.col("h") * F.col("h"))).alias("deck_rms")), by)
    line = robust.robust_line(both, by, "h_gt", "h_recon", huber).drop("n")
    resid = both.join(line, by).withColumn("_r", F.col("h_recon") - (F.col("p") * F.col("h_gt") + F.col("q")))
    e, r = F.col("error"), F.col("_r")
    means = resid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shared_cells"), F.first("p").alias("p_relief"), F.first("q").alias("q"), F.sqrt(F.avg(r * r)).alias("line_resid_rms"), F.sqrt(F.avg(e * e)).alias("err_rms"),
        F.count_if(F.col("h_gt") > top_height).alias("n_cells_tops"), F.sqrt(F.avg(F.when(F.col("h_gt") > top_height, e * e))).alias("top_err_rms")).filter(F.col("shared_cells") >= min_cells)
    tops = both.filter(F.col("h_gt") > top_height)
    stats = quantiles(both, by, "error", {"err_median": 0.5}).drop("n").join(quantiles(both, by, F.abs("error"), {"err_p95": 0.95}).drop("n"), by)
    top_stats = quantiles(tops, by, "error", {"top_err_median": 0.5}).filter(F.col("n") > min_tops).drop("n").join(quantiles(tops, by, F.abs("error"), {"top_err_p95": 0.95}).drop("n"), by)
    counts = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"))
    return counts.join(cover, by).join(deck_stat, by, "left").join(means, by, "left").join(stats, by, "left").join(top_stats, by, "left")


FINE = ["deck_offset", "err_median", "err_p95", "top_err_median", "top_err_p95", "coverage"]
COARSE = ["deck_rms", "p_relief", "q", "line_resid_rms", "err_rms", "top_err_rms"]


@query("grade_run", f"""WITH {VERSUS}, {irls_sql('joined', 'run_id, camera', ['h_gt'], 'h_recon', 2.0, 6)}, tot AS (SELECT count(*) AS gt_cells FROM gt), np AS (SELECT run_id, camera, count(*) AS n_points FROM cloud WHERE camera <> 'N' GROUP BY ALL),
  cov AS (SELECT r.run_id, r.camera, count(*) AS cells_recon, count(g.iu) AS shared FROM raster r LEFT JOIN gt g USING (iu, iv) WHERE r.camera <> 'N' GROUP BY ALL),
  dk AS (SELECT run_id, camera, median(h) AS deck_offset, sqrt(avg(h * h)) AS deck_rms FROM cloud WHERE camera <> 'N' AND {INSIDE} AND abs(h) <= 30 GROUP BY ALL HAVING count(*) >= 50),
  st AS (SELECT j.run_id, j.camera, count(*) AS shared_cells, any_value(p) AS p, any_value(q) AS q, sqrt(avg(pow(h_recon - (p * h_gt + q), 2))) AS lr, sqrt(avg(error * error)) AS er, count(*) FILTER (h_gt > 50) AS nt, sqrt(avg(error * error) FILTER (h_gt > 50)) AS tr FROM joined j JOIN fit USING (run_id, camera) GROUP BY ALL HAVING count(*) >= 100),
  qs AS (SELECT run_id, camera, median(error) AS em, quantile_cont(abs(error), 0.95) AS e95, CASE WHEN count(*) FILTER (h_gt > 50) > 20 THEN median(error) FILTER (h_gt > 50) END AS tm, CASE WHEN count(*) FILTER (h_gt > 50) > 20 THEN quantile_cont(abs(error), 0.95) FILTER (h_gt > 50) END AS t95 FROM joined GROUP BY ALL)
  SELECT np.run_id, np.camera, n_points, cells_recon, shared, gt_cells, round(shared / greatest(gt_cells, 1), 8) AS coverage, CAST(cells_recon AS DOUBLE) AS coverage_m2, round(deck_offset, 8) AS deck_offset, round(deck_rms, 6) AS deck_rms, shared_cells, round(p, 6) AS p_relief, round(q, 6) AS q,
  round(lr, 6) AS line_resid_rms, round(er, 6) AS err_rms, nt AS n_cells_tops, round(tr, 6) AS top_err_rms, round(em, 8) AS err_median, round(e95, 8) AS err_p95, round(tm, 8) AS top_err_median, round(t95, 8) AS top_err_p95
  FROM np JOIN cov USING (run_id, camera) CROSS JOIN tot LEFT JOIN dk USING (run_id, camera) LEFT JOIN st USING (run_id, camera) LEFT JOIN qs USING (run_id, camera)""")
def grade_run(t):
    c = t.cloud()
    g = grade_runs(c.filter("camera <> 'N'"), c.filter("camera = 'N'"), BY, CELL, HU, HV, M, 30.0, 50.0, min_cells=100, min_tops=20, min_deck=50)
    return rounded(rounded(g, 8, *FINE), 6, *COARSE)


@query("view_audit")
def view_audit(t):
    p = t.points3().withColumn("rig", F.floor(F.col("camera") / 5))
    fused = planes.plane_ransac(p, ["rig"], 0.1).select("rig", "nx", "ny", "nz", "d")
    a = planes.view_audit(materialise(p.join(fused, "rig"), "audited"), ["rig"], "camera", 0.15, 0.2, 5)
    return rounded(a, 6, "below_fraction", "offset", "deck_rms", "tilt_deg", "warp_rms", "warp_p95", "above_offset", "spread")


@query("height_gain", f"""WITH {VERSUS}, flat AS (SELECT run_id, camera, h_gt, h_recon, iu, iv FROM joined j WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE abs(g.iu - j.iu) <= 1 AND abs(g.iv - j.iv) <= 1 AND abs(g.h_gt - j.h_gt) > 60) AND h_gt BETWEEN 20 AND 80)
  SELECT run_id, camera, count(*) AS n, round(regr_slope(h_recon, h_gt), 6) AS gain, round(regr_intercept(h_recon, h_gt), 6) AS offset FROM flat GROUP BY ALL""")
def height_gain(t):
    from voxelloom.plans.clouds import compared, reference_raster

    gt = reference_raster(t).select("iu", "iv", F.col("h").alias("_g"))
    step = F.sequence(F.lit(-1), F.lit(1))
    near = gt.withColumn("_a", F.explode(step)).withColumn("_b", F.explode(step)).select((F.col("iu") + F.col("_a")).alias("iu"), (F.col("iv") + F.col("_b")).alias("iv"), "_g")
    span = near.groupBy("iu", "iv").agg(F.min("_g").alias("lo"), F.max("_g").alias("hi"))
    flat = compared(t).join(span, ["iu", "iv"]).filter("h_gt between 20 and 80 and hi - h_gt <= 60 and h_gt - lo <= 60")
    fit = flat.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("h_recon", "h_gt").alias("gain"), F.regr_intercept("h_recon", "h_gt").alias("offset"))
    return rounded(fit, 6, "gain", "offset")


@query("layer_table")
def layer_table(t):
    # peaks of each camera's heights, merged, with the area each covers
    c = t.cloud()
    peaks = rasters.suppressed_peaks(rasters.histogram(c, ["camera"], "h", 2.0), ["camera"], 2, 5).withColumn("z", (F.col("bin") + 0.5) * 2.0)
    merged = materialise(rasters.merge_peaks(peaks, ["camera"], 6.0), "layers")
    near = c.join(merged.select("camera", F.col("rank").alias("layer"), "z"), "camera").filter("abs(h - z) < 3")
    area = near.groupBy("camera", "layer").agg((F.count_distinct(F.floor(F.col("u") / 2), F.floor("v")) * 2.0).alias("area"))
    return rounded(merged.withColumnRenamed("rank", "layer").join(area, ["camera", "layer"]), 6, "z", "n")


@query("parcel_table")
def parcel_table(t):
    from voxelloom.operators.parcels import parcel_table as table

    c = t.cloud()
    ref = rasters.height_raster(c.filter("camera = 'N'"), ["run_id"], CELL, HU, HV, M)
    fused = rasters.height_raster(c.filter("camera <> 'N'"), ["run_id"], CELL, HU, HV, M)
    p = table(ref, materialise(fused, "fused"), ["run_id"], CELL, 45.0)
    return rounded(p.select("run_id", "parcel", "cells", "fused_cells", "core_height", "fused_height", "height_difference", "mean_difference"), 6, "core_height", "fused_height", "height_difference", "mean_difference")


@query("belt_footprint")
def belt_footprint(t):
    from voxelloom.operators.parcels import belt_footprint as belt

    return rounded(belt(t.cloud().filter("abs(h - 40) < 10"), ["run_id"], 1.0, 1), 6, "cu", "cv", "length", "width", "yaw", "coverage")


@query("per_view_faces")
def per_view_faces(t):
    from voxelloom.operators.parcels import per_view_faces as faces

    p = t.cloud().select("run_id", "camera", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("pid"), (F.col("u") / 25).alias("x"), (F.col("v") / 5).alias("y"), (F.col("h") / 100).alias("z"))
    centres = t.cloud().select("camera").distinct().select("camera", F.lit(2.0).alias("kx"), F.lit(0.5).alias("ky"), F.lit(3.0).alias("kz"))
    f, _ = faces(p, centres, ["run_id"], 20, 0.04, 0.05, tol=0.02, band=0.05)
    return rounded(f.select("run_id", "camera", "inliers", "offset", "incidence", "comb", "weight"), 6, "offset", "incidence", "comb", "weight")


@query("identify_deck")
def identify_deck(t):
    p = planes.peel_planes(t.points3(), ["camera"], 2, 0.08, 0.05)[0]
    return rounded(planes.identify_deck(p, ["camera"], (0.0, 0.5)), 6, "nx", "ny", "nz", "d", "fraction")
