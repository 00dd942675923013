"""Queries over clouds in the belt frame: rasters, coverage, comparison, layering, regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import effects, groups, joins, planes, rasters, robust
from voxelloom.plans.catalog import CLOUD, Tables, query, rounded
from voxelloom.session import materialise

HU, HV, CELL, M = 22.0, 4.0, 1.0, 0.05
INSIDE = f"abs(u) <= {HU + M} AND abs(v) <= {HV + M}"
IU = f"CAST(greatest(0, least(floor(2 * {HU + M} / {CELL}), floor((u + {HU + M}) / {CELL}))) AS BIGINT) AS iu"
IV = f"CAST(greatest(0, least(floor(2 * {HV + M} / {CELL}), floor((v + {HV + M}) / {CELL}))) AS BIGINT) AS iv"
RASTER = f"""{CLOUD}, raster AS (SELECT run_id, camera, {IU}, {IV}, count(*) AS n, median(h) AS h FROM cloud WHERE {INSIDE} GROUP BY ALL)"""
FLOOR = "CAST(floor(u / 2) AS BIGINT) AS iu, CAST(floor(v / 2) AS BIGINT) AS iv"
# the reference cloud is camera N over all runs; the others are graded against it
VERSUS = f"""{RASTER}, gt AS (SELECT {IU}, {IV}, median(h) AS h_gt FROM cloud WHERE camera = 'N' AND {INSIDE} GROUP BY ALL),
  joined AS (SELECT run_id, camera, iu, iv, h AS h_recon, h_gt, h - h_gt AS error, h_gt - h AS deficit FROM raster JOIN gt USING (iu, iv) WHERE camera <> 'N')"""
BY = ["run_id", "camera"]


def raster(t: Tables) -> DataFrame:
    return materialise(rasters.height_raster(t.cloud(), BY, CELL, HU, HV, M), "raster")


def reference_raster(t: Tables) -> DataFrame:
    return materialise(rasters.height_raster(t.cloud().filter("camera = 'N'"), [], CELL, HU, HV, M), "raster")


def compared(t: Tables) -> DataFrame:
    return materialise(joins.cell_compare(raster(t).filter("camera <> 'N'"), reference_raster(t), BY), "compared")


@query("height_raster", f"WITH {RASTER} SELECT run_id, camera, iu, iv, n, round(h, 8) AS h FROM raster")
def height_raster(t):
    return rounded(raster(t), 8, "h")


@query("height_raster_spread", f"""WITH {CLOUD} SELECT run_id, camera, {IU}, {IV}, count(*) AS n, round(median(h), 8) AS h, round(median(u), 8) AS u, round(median(v), 8) AS v,
  round(CASE WHEN count(*) >= 8 THEN quantile_cont(h, 0.84) - quantile_cont(h, 0.16) ELSE 0 END, 8) AS spread
  FROM (SELECT *, {IU} , {IV} FROM cloud WHERE abs(u) <= {HU + M} AND abs(v) <= 2.05) GROUP BY run_id, camera, iu, iv""".replace(
    f"SELECT run_id, camera, {IU}, {IV}, count", "SELECT run_id, camera, iu, iv, count").replace(
    f"SELECT *, {IU} , {IV}", f"SELECT *, {IU}, " + IV.replace(f"{HV + M}", "2.05")))
def height_raster_spread(t):
    return rounded(rasters.height_raster_spread(t.cloud(), BY, CELL, HU, HV, cross=2.0, margin=M), 8, "h", "u", "v", "spread")


@query("plane_field", f"WITH {CLOUD} SELECT run_id, camera, {FLOOR}, count(*) AS n, round(median(h), 8) AS h FROM cloud GROUP BY ALL HAVING count(*) >= 12")
def plane_field(t):
    return rounded(rasters.plane_field(t.cloud(), BY, 2.0, 12), 8, "h")


@query("cell_surface", f"""WITH {CLOUD} SELECT run_id, {FLOOR}, count(*) AS n, round(median(h), 8) AS h,
  round(quantile_cont(h, 0.9) - quantile_cont(h, 0.1), 8) AS spread FROM cloud GROUP BY ALL HAVING count(*) >= 10""")
def cell_surface(t):
    return rounded(rasters.cell_surface(t.cloud(), ["run_id"], 2.0, 10), 8, "h", "spread")


@query("envelope", f"""WITH {CLOUD}, k AS (SELECT run_id, {FLOOR}, h FROM cloud), s AS (SELECT run_id, iu, iv, list_sort(list(h)) AS l FROM k GROUP BY ALL)
  SELECT run_id, iu, iv, CAST(len(l) AS BIGINT) AS n, round(l[CAST(round_even(0.95 * (len(l) - 1), 0) AS BIGINT) + 1], 8) AS h FROM s""")
def envelope(t):
    return rounded(rasters.envelope(t.cloud(), ["run_id"], 2.0, 0.95), 8, "h")


CELLS_MV = f"""c AS (SELECT run_id, CAST(greatest(0, least(floor(2 * {HU}), floor(u + {HU}))) AS BIGINT) AS iu, CAST(greatest(0, least(floor(2 * {HV}), floor(v + {HV}))) AS BIGINT) AS iv,
  count(DISTINCT camera) AS views FROM cloud WHERE abs(u) <= {HU} AND abs(v) <= {HV} AND h > 30 AND h < 60 GROUP BY ALL)"""


@query("multi_view_coverage", f"""WITH {CLOUD}, {CELLS_MV} SELECT run_id, CAST(count(*) FILTER (views >= 1) AS DOUBLE) AS mv1_m2, CAST(count(*) FILTER (views >= 2) AS DOUBLE) AS mv2_m2,
  CAST(count(*) FILTER (views >= 3) AS DOUBLE) AS mv3_m2, {4 * HU * HV} AS belt_m2 FROM c GROUP BY run_id""")
def multi_view_coverage(t):
    return rasters.multi_view_coverage(t.cloud(), ["run_id"], 1.0, HU, HV, 30.0, 60.0)


@query("multi_view_coverage_on_parcels", f"""WITH {CLOUD}, {CELLS_MV}, d AS (SELECT DISTINCT {IU.replace(str(HU + M), str(HU))}, {IV.replace(str(HV + M), str(HV))} FROM cloud
  WHERE camera = 'N' AND abs(u) <= {HU} AND abs(v) <= {HV} AND h > 100), j AS (SELECT c.* FROM c JOIN d USING (iu, iv))
  SELECT run_id, CAST(count(*) FILTER (views >= 1) AS DOUBLE) AS mv1_m2, CAST(count(*) FILTER (views >= 2) AS DOUBLE) AS mv2_m2,
  CAST(count(*) FILTER (views >= 3) AS DOUBLE) AS mv3_m2, (SELECT CAST(count(*) AS DOUBLE) FROM d) AS belt_m2 FROM j GROUP BY run_id""")
def multi_view_coverage_on_parcels(t):
    tall = rasters.on_belt(t.cloud().filter("camera = 'N' and h > 100"), HU, HV).select(
        rasters.belt_cell("u", HU, 1.0).alias("iu"), rasters.belt_cell("v", HV, 1.0).alias("iv"))
    return rasters.multi_view_coverage(t.cloud(), ["run_id"], 1.0, HU, HV, 30.0, 60.0, domain=tall)


@query("layer_area", f"""WITH {CLOUD}, k AS (SELECT camera, floor(u / 0.5) AS c0, floor(v / 0.5) AS c1, count(*) FILTER (abs(h - 40) < 2) AS k FROM cloud GROUP BY ALL)
  SELECT camera, CAST(sum(k) AS BIGINT) AS n, CASE WHEN sum(k) >= 50 THEN count(*) FILTER (k > 0) * 0.25 ELSE 0.0 END AS area_m2 FROM k GROUP BY camera""")
def layer_area(t):
    return rasters.layer_area(t.cloud(), ["camera"], "h", 40.0, 2.0, 0.5, 50, ("u", "v"))


@query("cell_compare", f"WITH {VERSUS} SELECT run_id, camera, iu, iv, round(h_recon, 8) AS h_recon, round(h_gt, 8) AS h_gt, round(error, 8) AS error, round(deficit, 8) AS deficit FROM joined WHERE h_gt > 20 AND h_gt < 70")
def cell_compare(t):
    j = joins.cell_compare(raster(t).filter("camera <> 'N'"), reference_raster(t), BY, 20.0, 70.0)
    return rounded(j, 8, "h_recon", "h_gt", "error", "deficit").drop("n")


@query("coverage_fraction", f"""WITH {RASTER}, g AS (SELECT DISTINCT iu, iv FROM raster WHERE camera = 'N'), tot AS (SELECT count(*) AS gt_cells FROM g)
  SELECT run_id, camera, count(*) AS cells_recon, count(g.iu) AS shared, any_value(gt_cells) AS gt_cells, round(count(g.iu) / greatest(any_value(gt_cells), 1), 8) AS coverage
  FROM raster r LEFT JOIN g USING (iu, iv) CROSS JOIN tot GROUP BY ALL""")
def coverage_fraction(t):
    return rounded(joins.coverage_fraction(raster(t), reference_raster(t), BY), 8, "coverage")


@query("pair_disagreement", f"""WITH {RASTER}, p AS (SELECT a.run_id, a.camera AS cam_a, b.camera AS cam_b, a.h AS ha, b.h AS hb, a.h - b.h AS d FROM raster a JOIN raster b
  ON a.run_id = b.run_id AND a.iu = b.iu AND a.iv = b.iv AND a.camera < b.camera)
  SELECT run_id, cam_a, cam_b, round(corr(ha, hb), 6) AS correlation, round(sqrt(avg(d * d)), 6) AS rms, count(*) AS n, round(median(d), 8) AS median,
  round(median(abs(d)), 8) AS abs_median, round(quantile_cont(abs(d), 0.95), 8) AS abs_p95 FROM p GROUP BY ALL HAVING count(*) >= 20""")
def pair_disagreement(t):
    d = joins.pair_disagreement(raster(t), ["run_id"])
    return rounded(rounded(d, 6, "correlation", "rms"), 8, "median", "abs_median", "abs_p95")


FIELD = f"""{RASTER}, common AS (SELECT *, count(*) OVER (PARTITION BY run_id, iu, iv) AS k FROM raster), cc AS (SELECT * FROM common WHERE k >= 2),
  dev AS (SELECT *, h - median(h) OVER (PARTITION BY run_id, camera) AS dev FROM cc), res AS (SELECT *, dev - avg(dev) OVER (PARTITION BY run_id, iu, iv) AS resid,
  avg(dev) OVER (PARTITION BY run_id, iu, iv) AS shared FROM dev)"""


@query("field_decompose", f"""WITH {FIELD} SELECT run_id, n_cells, shared_sd, per_view_rms FROM
  (SELECT run_id, count(*) AS n_cells, round(stddev_pop(shared), 6) AS shared_sd FROM (SELECT DISTINCT run_id, iu, iv, shared FROM res) GROUP BY run_id)
  JOIN (SELECT run_id, round(sqrt(avg(resid * resid)), 6) AS per_view_rms FROM res GROUP BY run_id) USING (run_id)""")
def field_decompose(t):
    return rounded(joins.field_decompose(raster(t), ["run_id"])[0], 6, "shared_sd", "per_view_rms")


@query("field_decompose_by_view", f"WITH {FIELD} SELECT run_id, camera, count(*) AS n, round(sqrt(avg(resid * resid)), 6) AS rms FROM res GROUP BY ALL")
def field_decompose_by_view(t):
    return rounded(joins.field_decompose(raster(t), ["run_id"])[1], 6, "rms")


LAYER = f"""{CLOUD}, tag AS (SELECT run_id, camera, CASE WHEN abs(h - 40) <= 10 THEN 'belt' WHEN h - 40 > 15 THEN 'above' END AS level, h - 40 AS h FROM cloud),
  views AS (SELECT run_id, camera, level, count(*) AS n, median(h) AS m FROM tag WHERE level IS NOT NULL GROUP BY ALL HAVING count(*) >= 50)"""


@query("layer_report_views", f"WITH {LAYER} SELECT run_id, camera, level, n, round(m, 8) AS median FROM views")
def layer_report_views(t):
    c = t.cloud().withColumn("h", F.col("h") - 40)
    return rounded(joins.layer_report(c, ["run_id"], "camera", "h", 10.0, 15.0)[0], 8, "median")


@query("layer_report", f"WITH {LAYER} SELECT run_id, level, count(*) AS n_views, round(max(m) - min(m), 8) AS range, round(stddev_samp(m), 6) AS sd FROM views GROUP BY ALL HAVING count(*) > 1")
def layer_report(t):
    c = t.cloud().withColumn("h", F.col("h") - 40)
    return rounded(rounded(joins.layer_report(c, ["run_id"], "camera", "h", 10.0, 15.0)[1], 8, "range"), 6, "sd")


@query("residual_grid", f"""WITH {CLOUD} SELECT camera, CAST(least(7, floor((u + 25.5) * 8 / 51.0)) AS BIGINT) AS bx, CAST(least(5, floor((v + 5) * 6 / 11.0)) AS BIGINT) AS by_,
  count(*) AS n, round(median(h), 8) AS median FROM cloud GROUP BY ALL HAVING count(*) >= 50""")
def residual_grid(t):
    p = t.cloud().withColumn("u", F.col("u") + 25.5).withColumn("v", F.col("v") + 5)
    return rounded(rasters.residual_grid(p, ["camera"], "h", 51.0, 11.0, 8, 6), 8, "median")


@query("spatial_structure", f"""WITH {CLOUD}, g AS (SELECT camera, CAST(least(7, floor((u + 25.5) * 8 / 51.0)) AS BIGINT) AS bx, CAST(least(5, floor((v + 5) * 6 / 11.0)) AS BIGINT) AS by_,
  median(h) AS m FROM cloud GROUP BY ALL HAVING count(*) >= 20), q AS (SELECT camera, count(*) AS blocks, quantile_cont(m, 0.95) - quantile_cont(m, 0.05) AS structure, median(m) AS mm FROM g GROUP BY ALL)
  SELECT camera, any_value(blocks) AS blocks, round(any_value(structure), 8) AS structure, round(1.4826 * median(abs(m - mm)), 8) AS mad_sigma FROM g JOIN q USING (camera) GROUP BY camera""")
def spatial_structure(t):
    p = t.cloud().withColumn("u", F.col("u") + 25.5).withColumn("v", F.col("v") + 5)
    g = rasters.residual_grid(p, ["camera"], "h", 51.0, 11.0, 8, 6, 20)
    return rounded(rasters.spatial_structure(g, ["camera"]), 8, "structure", "mad_sigma")


@query("depth_quantile_bins", f"""WITH {CLOUD}, e AS (SELECT camera, quantile_cont(u, 0.25) AS e1, quantile_cont(u, 0.5) AS e2, quantile_cont(u, 0.75) AS e3 FROM cloud GROUP BY camera),
  b AS (SELECT camera, CAST((u >= e1)::INT + (u >= e2)::INT + (u >= e3)::INT AS BIGINT) AS bin, count(*) AS n, median(h) AS m FROM cloud JOIN e USING (camera) GROUP BY ALL)
  SELECT camera, bin, n, round(m, 8) AS median, round(max_by(m, bin) OVER w - min_by(m, bin) OVER w, 8) AS trend FROM b WINDOW w AS (PARTITION BY camera)""")
def depth_quantile_bins(t):
    return rounded(rasters.depth_quantile_bins(t.cloud(), ["camera"], "u", "h", 4), 8, "median", "trend")


@query("height_census", f"""WITH {CLOUD} SELECT run_id, CAST(floor(h / 5) AS BIGINT) AS bin, count(*) FILTER (camera = 'A') AS A, count(*) FILTER (camera = 'N') AS N, count(*) FILTER (camera = 'R') AS R
  FROM cloud GROUP BY ALL""")
def height_census(t):
    return rasters.height_census(t.cloud(), ["run_id"], 5.0, ["A", "N", "R"])


HIST = f"""{CLOUD}, hist AS (SELECT camera, CAST(floor(h / 0.5) AS BIGINT) AS bin, count(*) AS n FROM cloud GROUP BY ALL),
  span AS (SELECT camera, min(bin) AS lo, max(bin) AS hi FROM hist GROUP BY camera), dense AS (SELECT s.camera, g.bin, coalesce(h.n, 0) AS n FROM span s,
  LATERAL (SELECT unnest(generate_series(s.lo, s.hi)) AS bin) g LEFT JOIN hist h ON h.camera = s.camera AND h.bin = g.bin),
  smooth AS (SELECT camera, bin, n, sum(n) OVER (PARTITION BY camera ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM dense)"""


@query("histogram_smoothing", f"WITH {HIST} SELECT camera, bin, CAST(n AS BIGINT) AS n, round(smooth, 8) AS smooth FROM smooth")
def histogram_smoothing(t):
    return rounded(rasters.smooth_histogram(rasters.histogram(t.cloud(), ["camera"], "h", 0.5), ["camera"]), 8, "smooth")


@query("histogram_peaks")
def histogram_peaks(t):
    s = rasters.smooth_histogram(rasters.histogram(t.cloud(), ["camera"], "h", 0.5), ["camera"])
    return rounded(rasters.histogram_peaks(s, ["camera"], 0.5, 6), 8, "smooth")


@query("top_peaks")
def top_peaks(t):
    s = rasters.smooth_histogram(rasters.histogram(t.cloud(), ["camera"], "h", 0.5), ["camera"])
    return rounded(rasters.histogram_peaks(s, ["camera"], 0.2, 6, 3), 8, "smooth")


@query("suppressed_peaks", f"""WITH RECURSIVE {CLOUD}, hist AS (SELECT camera, CAST(floor(h) AS BIGINT) AS bin, count(*) AS n FROM cloud GROUP BY ALL),
  st AS (SELECT camera, 0 AS rank, CAST([] AS BIGINT[]) AS gone, list(bin ORDER BY n DESC, bin) AS left_bins FROM hist GROUP BY camera
  UNION ALL SELECT camera, rank + 1, list_append(gone, left_bins[1]), list_filter(left_bins, lambda b: abs(b - left_bins[1]) > 4) FROM st WHERE rank < 4 AND len(left_bins) > 0),
  p AS (SELECT s.camera, CAST(s.rank - 1 AS BIGINT) AS rank, s.gone[s.rank] AS bin, o.left_bins AS before FROM st s JOIN st o ON o.camera = s.camera AND o.rank = s.rank - 1 WHERE s.rank > 0)
  SELECT p.camera, p.rank, p.bin, CAST(sum(h.n) AS BIGINT) AS n FROM p JOIN hist h ON h.camera = p.camera AND abs(h.bin - p.bin) <= 4 AND list_contains(p.before, h.bin) GROUP BY ALL""")
def suppressed_peaks(t):
    return rasters.suppressed_peaks(rasters.histogram(t.cloud(), ["camera"], "h", 1.0), ["camera"], 4, 4)


@query("dense_bands", f"""WITH {CLOUD}, hist AS (SELECT camera, CAST(floor(h / 2) AS BIGINT) AS bin, count(*) AS n FROM cloud GROUP BY ALL), keep AS (SELECT *, bin - row_number() OVER (PARTITION BY camera ORDER BY bin) AS isl
  FROM (SELECT *, max(n) OVER (PARTITION BY camera) AS mx FROM hist) WHERE n > 0.5 * mx)
  SELECT camera, min(bin) AS bin_lo, max(bin) AS bin_hi, CAST(sum(n) AS BIGINT) AS n, round(sum((bin + 0.5) * 2 * n) / sum(n), 6) AS centre FROM keep GROUP BY camera, isl""")
def dense_bands(t):
    return rounded(rasters.dense_bands(rasters.histogram(t.cloud(), ["camera"], "h", 2.0), ["camera"], 2.0, 0.5), 6, "centre")


@query("merge_peaks")
def merge_peaks(t):
    h = rasters.histogram(t.cloud(), ["camera"], "h", 2.0).filter("n > 20").withColumn("z", F.col("bin") * 2.0)
    return rounded(rasters.merge_peaks(h, ["camera"], 2.5), 6, "z", "n")


@query("density_modes")
def density_modes(t):
    return rounded(rasters.density_modes(t.cloud(), ["camera"], "h", 1.0, 0.5, 0.02), 6, "centre", "relative", "prominence")


@query("cloud_profile", f"""WITH {CLOUD} SELECT camera, count(*) AS n, {', '.join(f'round(quantile_cont(h, {p / 100}), 8) AS p{p}' for p in (1, 5, 25, 50, 75, 95, 99))},
  round(count(*) FILTER (h >= 30 AND h <= 60) / count(*), 8) AS in_band FROM cloud GROUP BY camera""")
def cloud_profile(t):
    return rounded(rasters.cloud_profile(t.cloud(), ["camera"], "h", 30.0, 60.0), 8, "p1", "p5", "p25", "p50", "p75", "p95", "p99", "in_band")


@query("clipped_histogram", f"""WITH {CLOUD} SELECT camera, CAST(greatest(0, least(31, floor((h - 10) / 2.5))) AS BIGINT) AS bin, count(*) AS n FROM cloud GROUP BY ALL""")
def clipped_histogram(t):
    return rasters.clipped_histogram(t.cloud(), ["camera"], "h", 10.0, 90.0, 32)


@query("band_probe", f"""WITH {VERSUS}, b AS (SELECT * FROM joined WHERE h_gt >= 30 AND h_gt < 60)
  SELECT run_id, camera, count(*) AS cells, round(median(h_recon), 8) AS recon_median, round(median(deficit), 8) AS deficit_median,
  count(DISTINCT greatest(0, least(11, floor(h_recon / (100.0 / 12))))) AS bins_hit,
  CASE WHEN count(DISTINCT greatest(0, least(11, floor(h_recon / (100.0 / 12))))) * 2 >= 12 THEN 'spread' WHEN count(DISTINCT greatest(0, least(11, floor(h_recon / (100.0 / 12))))) <= 2 THEN 'single layer' ELSE 'partial' END AS verdict
  FROM b GROUP BY ALL""")
def band_probe(t):
    return rounded(rasters.band_probe(compared(t), BY, 30.0, 60.0, 12, 100.0), 8, "recon_median", "deficit_median")


@query("select_band_points", f"""WITH {VERSUS}, pick AS (SELECT iu, iv FROM gt WHERE h_gt >= 50), k AS (SELECT camera, {IU}, {IV} FROM cloud)
  SELECT k.camera, count(*) AS points, count(pick.iu) AS selected FROM k LEFT JOIN pick USING (iu, iv) GROUP BY ALL""")
def select_band_points(t):
    pick = reference_raster(t).filter("h >= 50").select("iu", "iv")
    chosen, rest = rasters.select_band_cells(t.cloud(), pick, CELL, HU + M, HV + M)
    both = chosen.select("camera", F.lit(1).alias("s")).unionByName(rest.select("camera", F.lit(0).alias("s")))
    return both.groupBy("camera").agg(F.count(F.lit(1)).alias("points"), F.sum("s").alias("selected"))


# --- regression ---------------------------------------------------------------------------------


def irls_sql(src: str, by: str, design: list[str], y: str, huber: float, iters: int) -> str:
    """Unrolled Huber reweighting for two columns (x, 1), as CTEs ending in ``fit``."""
    x = design[0]
    ctes = [f"base AS (SELECT {by}, {x} AS x, {y} AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)", f"w0 AS (SELECT {by}, x, y, 1.0 AS w FROM base)"]
    for i in range(iters):
        ctes.append(
            f"c{i} AS (SELECT {by}, count(*) AS n, sum(w*w) AS s1, sum(w*w*x) AS sx, sum(w*w*x*x) AS sxx, sum(w*w*y) AS sy, sum(w*w*x*y) AS sxy FROM w{i} GROUP BY ALL), "
            f"f{i} AS (SELECT {by}, n, (s1*sxy - sx*sy) / (s1*sxx - sx*sx) AS p, (sxx*sy - sx*sxy) / (s1*sxx - sx*sx) AS q FROM c{i})")
        if i < iters - 1:
            ctes.append(
                f"r{i} AS (SELECT b.{by.replace(', ', ', b.')}, x, y, abs(p * x + q - y) AS r FROM base b JOIN f{i} USING ({by})), "
                f"s{i} AS (SELECT {by}, greatest(1.4826 * median(r), 1e-9) AS s FROM r{i} GROUP BY ALL), "
                f"w{i + 1} AS (SELECT r{i}.{by.replace(', ', f', r{i}.')}, x, y, CASE WHEN r <= {huber} * s THEN 1.0 ELSE {huber} * s / greatest(r, 1e-12) END AS w FROM r{i} JOIN s{i} USING ({by}))")
    ctes.append(f"fit AS (SELECT {by}, p, q, n FROM f{iters - 1})")
    return ", ".join(ctes)


@query("robust_line", f"WITH {VERSUS}, {irls_sql('joined', 'run_id, camera', ['h_gt'], 'h_recon', 2.0, 6)} SELECT run_id, camera, round(p, 6) AS p, round(q, 6) AS q, n FROM fit")
def robust_line(t):
    return rounded(robust.robust_line(compared(t), BY, "h_gt", "h_recon"), 6, "p", "q")


@query("robust_line_on_points", f"WITH {CLOUD}, {irls_sql('cloud', 'run_id, camera', ['u'], 'h', 2.0, 6)} SELECT run_id, camera, round(p, 6) AS p, round(q, 6) AS q, n FROM fit")
def robust_line_on_points(t):
    return rounded(robust.robust_line(t.cloud(), BY, "u", "h"), 6, "p", "q")


@query("least_squares_relief", f"WITH {VERSUS} SELECT run_id, camera, round(regr_slope(deficit, h_gt), 6) AS k, round(regr_intercept(deficit, h_gt), 6) AS c0, count(*) AS n FROM joined GROUP BY ALL")
def least_squares_relief(t):
    fit = robust.least_squares(compared(t), BY, [F.lit(1.0), F.col("h_gt")], F.col("deficit"))
    return rounded(fit.select(*BY, F.col("coef")[1].alias("k"), F.col("coef")[0].alias("c0"), "n"), 6, "k", "c0")


@query("robust_regression")
def robust_regression(t):
    j = compared(t).withColumn("u", F.col("iu") - 22).withColumn("v", F.col("iv") - 4)
    fit = robust.robust_regression(j, BY, [F.lit(1.0), F.col("h_gt"), F.col("h_gt") * F.col("u"), F.col("h_gt") * F.col("v")], "deficit")
    return rounded(fit.select(*BY, "n", *[F.col("coef")[i].alias(n) for i, n in enumerate(["c0", "k0", "kx", "ky"])]), 6, "c0", "k0", "kx", "ky")


@query("robust_line_cov")
def robust_line_cov(t):
    return rounded(robust.robust_line_cov(compared(t), BY, "h_gt", "h_recon"), 6, "p", "q", "n_eff", "scale", "var_p", "var_q", "cov_pq", "condition")


@query("soft_scale_shift")
def soft_scale_shift(t):
    return rounded(robust.soft_scale_shift(compared(t), BY, "h_gt", "h_recon"), 6, "scale", "shift")


TRIM = f"""{VERSUS}, d AS (SELECT run_id, camera, h_gt AS x, h_recon AS y FROM joined),
  f0 AS (SELECT run_id, camera, regr_slope(y, x) AS p, regr_intercept(y, x) AS q, count(*) AS n, sqrt(greatest(var_pop(y) - regr_slope(y, x) * regr_slope(y, x) * var_pop(x), 0)) AS s FROM d GROUP BY ALL), """ + ", ".join(
    f"f{i} AS (SELECT run_id, camera, regr_slope(y, x) AS p, regr_intercept(y, x) AS q, count(*) AS n, sqrt(greatest(var_pop(y) - regr_slope(y, x) * regr_slope(y, x) * var_pop(x), 0)) AS s FROM (SELECT d.* FROM d JOIN f{i - 1} USING (run_id, camera) WHERE abs(y - (p * x + q)) < 2.5 * s) GROUP BY ALL)" for i in (1, 2))


@query("trimmed_line", f"WITH {TRIM} SELECT run_id, camera, n, round(p, 6) AS p, round(q, 6) AS q, round(s, 6) AS sigma FROM f2")
def trimmed_line(t):
    return rounded(robust.trimmed_line(compared(t), BY, "h_gt", "h_recon", 3), 6, "p", "q", "sigma")


@query("polynomial_surface")
def polynomial_surface(t):
    s = robust.polynomial_surface(raster(t).withColumn("u", F.col("iu") / 44).withColumn("v", F.col("iv") / 8), BY, "u", "v", "h", 2)
    return rounded(s.drop("coef"), 6, "rms_before", "rms_after", "explained")


@query("deficit_by_height", f"""WITH {VERSUS} SELECT run_id, camera, CAST(floor((h_gt - 20) / 10) AS BIGINT) AS band, count(*) AS n, round(median(deficit), 8) AS median_deficit,
  20 + floor((h_gt - 20) / 10) * 10.0 AS band_lo FROM joined WHERE h_gt >= 20 AND h_gt < 80 GROUP BY ALL HAVING count(*) >= 20""")
def deficit_by_height(t):
    return rounded(robust.deficit_by_height(compared(t), BY, "h_gt", "deficit", 20.0, 10.0, 6, 20), 8, "median_deficit")


@query("deficit_band_slope", f"""WITH {VERSUS}, b AS (SELECT run_id, camera, 25 + floor((h_gt - 20) / 10) * 10 AS mid, median(deficit) AS md FROM joined WHERE h_gt >= 20 AND h_gt < 80 GROUP BY ALL HAVING count(*) >= 20)
  SELECT run_id, camera, count(*) AS bands, round(regr_slope(md, mid), 6) AS slope FROM b GROUP BY ALL""")
def deficit_band_slope(t):
    b = robust.deficit_by_height(compared(t), BY, "h_gt", "deficit", 20.0, 10.0, 6, 20)
    return rounded(robust.band_slope(b, BY, 10.0), 6, "slope")


HOLD = f"""{VERSUS}, s AS (SELECT *, iu < median(iu) OVER (PARTITION BY run_id, camera) AS train FROM joined), m AS (SELECT run_id, camera, avg(deficit) AS c, regr_slope(deficit, h_gt) AS k, regr_intercept(deficit, h_gt) AS k0 FROM s WHERE train GROUP BY ALL)"""


@query("holdout_fit_ols", f"""WITH {HOLD}, e AS (SELECT run_id, camera, deficit, deficit - c AS ec, deficit - (k0 + k * h_gt) AS er FROM s JOIN m USING (run_id, camera) WHERE NOT train)
  SELECT run_id, camera, 'none' AS model, count(*) AS n_test, round(sqrt(avg(deficit * deficit)), 6) AS rms FROM e GROUP BY ALL UNION ALL
  SELECT run_id, camera, 'constant', count(*), round(sqrt(avg(ec * ec)), 6) FROM e GROUP BY ALL UNION ALL SELECT run_id, camera, 'relief', count(*), round(sqrt(avg(er * er)), 6) FROM e GROUP BY ALL""")
def holdout_fit_ols(t):
    j = compared(t).select(*BY, F.col("iu").alias("u"), F.col("iv").alias("v"), F.col("h_gt").alias("h"), F.col("deficit").alias("d"))
    return rounded(robust.holdout_fit(j, BY, "along", huber=None).filter("model <> 'positional'"), 6, "rms")


@query("holdout_fit")
def holdout_fit(t):
    j = compared(t).select(*BY, F.col("iu").alias("u"), F.col("iv").alias("v"), F.col("h_gt").alias("h"), F.col("deficit").alias("d"))
    return rounded(robust.holdout_fit(j, BY, "across"), 6, "rms")


@query("diff_runs", f"""WITH {CLOUD}, a AS (SELECT camera, count(*) AS points_a, median(h) FILTER (abs(h) <= 30) AS deck_a, median(h) FILTER (h > 50) AS above_a FROM cloud WHERE run_id = 'F' GROUP BY camera),
  b AS (SELECT camera, count(*) AS points_b, median(h) FILTER (abs(h) <= 30) AS deck_b, median(h) FILTER (h > 50) AS above_b FROM cloud WHERE run_id = 'O' GROUP BY camera)
  SELECT camera, points_a, round(deck_a, 8) AS deck_a, round(above_a, 8) AS above_a, points_b, round(deck_b, 8) AS deck_b, round(above_b, 8) AS above_b, round(deck_b - deck_a, 8) AS deck_diff, round(above_b - above_a, 8) AS above_diff
  FROM a FULL JOIN b USING (camera)""")
def diff_runs(t):
    c = t.cloud()
    d = joins.diff_runs(c.filter("run_id = 'F'"), c.filter("run_id = 'O'"), ["camera"], "h", 30.0, 50.0)
    return rounded(d, 8, "deck_a", "above_a", "deck_b", "above_b", "deck_diff", "above_diff")


@query("edge_profile", f"""WITH {CLOUD} SELECT camera, CAST(CASE WHEN u + 25.5 >= 24 THEN 5 WHEN u + 25.5 >= 16 THEN 4 WHEN u + 25.5 >= 12 THEN 3 WHEN u + 25.5 >= 8 THEN 2 WHEN u + 25.5 >= 4 THEN 1 ELSE 0 END AS BIGINT) AS bin,
  count(*) AS n, round(median(h), 8) AS median FROM cloud GROUP BY ALL HAVING count(*) >= 50""")
def edge_profile(t):
    return rounded(planes.edge_profile(t.cloud().withColumn("d", F.col("u") + 25.5), ["camera"], "d", "h"), 8, "median")


@query("radial_profile", f"""WITH {CLOUD}, m AS (SELECT *, abs(u) AS a, max(abs(u)) OVER (PARTITION BY camera) AS mx FROM cloud), b AS (SELECT camera, CAST(least(7, floor(a / mx * 8)) AS BIGINT) AS bin, count(*) AS n, median(h) AS m
  FROM m GROUP BY ALL HAVING count(*) >= 30) SELECT camera, bin, n, round(m, 8) AS median, round(max(m) OVER (PARTITION BY camera) - min(m) OVER (PARTITION BY camera), 8) AS amplitude FROM b""")
def radial_profile(t):
    return rounded(planes.radial_profile(t.cloud().withColumn("a", F.abs("u")), ["camera"], "a", "h"), 8, "median", "amplitude")


@query("centred_by_view", f"WITH {RASTER} SELECT run_id, camera, iu, iv, round(h - median(h) OVER (PARTITION BY run_id, camera), 8) AS centred FROM raster")
def centred_by_view(t):
    return rounded(effects.centred(raster(t), BY, "h", how="median"), 8, "centred").select(*BY, "iu", "iv", "centred")


@query("deck_bias_per_view", f"WITH {CLOUD} SELECT camera, count(*) AS n, round(median(h - 40), 8) AS deck_bias, round(sqrt(avg((h - 40) * (h - 40))), 6) AS deck_rms FROM cloud WHERE abs(h - 40) <= 8 GROUP BY camera HAVING count(*) >= 50")
def deck_bias_per_view(t):
    from voxelloom.operators.boxes import deck_bias_per_view as bias

    c = t.cloud().withColumn("r", F.col("h") - 40).filter("abs(r) <= 8")
    return rounded(rounded(bias(c, ["camera"], "r"), 8, "deck_bias"), 6, "deck_rms")


@query("weighted_median", f"""WITH {CLOUD}, g AS (SELECT camera, h AS v, sum(u + 26) AS w FROM cloud GROUP BY ALL), c AS (SELECT camera, v, sum(w) OVER (PARTITION BY camera ORDER BY v) AS cum, sum(w) OVER (PARTITION BY camera) AS tot FROM g)
  SELECT camera, round(min(v), 8) AS wmedian FROM c WHERE cum >= 0.5 * tot * (1 - 1e-12) GROUP BY camera""")
def weighted_median(t):
    return rounded(groups.weighted_median(t.cloud().withColumn("w", F.col("u") + 26), ["camera"], "h", "w"), 8, "wmedian")


@query("hot_group_quantiles", f"""WITH {CLOUD} SELECT camera, count(*) AS n, round(quantile_cont(h, 0.05), 8) AS p5, round(median(h), 8) AS p50, round(quantile_cont(h, 0.95), 8) AS p95 FROM cloud GROUP BY camera""")
def hot_group_quantiles(t):
    # every camera counts as a hot group here: the bucketed path must give the same values
    return rounded(groups.quantiles(t.cloud(), ["camera"], "h", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, hot_rows=100), 8, "p5", "p50", "p95")
