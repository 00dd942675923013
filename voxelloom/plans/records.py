"""Queries over placements, parcels, corners, runs and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.operators import boxes, calib, effects, filters, groups, joins, planes, rasters, robust, runs
from voxelloom.plans.catalog import BOXES, CLOUD, FRAMES, PLACEMENTS, Tables, query, rounded
from voxelloom.session import materialise

# --- placements ---------------------------------------------------------------------------------


@query("placement_rows", f"""WITH {PLACEMENTS}, m AS (SELECT camera, capture, label, count(*) AS n, median(h_meas) AS h_meas, median(h_true) AS h_true FROM placements GROUP BY ALL)
  SELECT m.camera, m.capture, m.label, n, round(m.h_meas, 8) AS h_meas, round(m.h_true, 8) AS h_true, round(sqrt(avg(pow(p.h_meas - m.h_meas, 2))), 6) AS within_rms FROM placements p JOIN m USING (camera, capture, label) GROUP BY ALL""")
def placement_rows(t):
    p = effects.placement_rows(t.placements(), ["camera", "capture", "label"], "h_meas", "h_true")
    return rounded(rounded(p, 8, "h_meas", "h_true"), 6, "within_rms")


COMMON = f"""{PLACEMENTS}, pv AS (SELECT label, capture, camera, avg(h_meas - h_true) AS e FROM placements GROUP BY ALL), cap AS (SELECT *, count(*) OVER (PARTITION BY label, capture) AS k, avg(e) OVER (PARTITION BY label, capture) AS m FROM pv), ok AS (SELECT * FROM cap WHERE k >= 3)"""


@query("common_mode_split", f"""WITH {COMMON} SELECT a.label, a.n_captures, round(a.sd, 6) AS shared_sd, round(b.sd, 6) AS per_view_sd, round(b.share, 6) AS shared_fraction FROM
  (SELECT label, count(*) AS n_captures, stddev_samp(m) AS sd FROM (SELECT DISTINCT label, capture, m FROM ok) GROUP BY label) a JOIN (SELECT label, stddev_samp(e - m) AS sd, 1 - var_pop(e - m) / var_pop(e) AS share FROM ok GROUP BY label) b USING (label) WHERE n_captures >= 3""")
def common_mode_split(t):
    p = t.placements().withColumn("e", F.col("h_meas") - F.col("h_true"))
    return rounded(effects.common_mode_split(p, ["label"], "capture", "camera", "e"), 6, "shared_sd", "per_view_sd", "shared_fraction")


@query("layer_stats", f"""WITH {PLACEMENTS}, pv AS (SELECT label, capture, camera, avg(h_meas) AS b, avg(0.9 * h_meas + 0.01) AS a FROM placements GROUP BY ALL), c AS (SELECT label, capture, max(b) - min(b) AS b, max(a) - min(a) AS a FROM pv GROUP BY ALL HAVING count(*) >= 2)
  SELECT label, count(*) AS n_captures, round(max(b), 6) AS before_max, round(max(a), 6) AS after_max, round(median(b), 6) AS before_median, round(median(a), 6) AS after_median FROM c GROUP BY label""")
def layer_stats(t):
    p = t.placements().groupBy("label", "capture", "camera").agg(F.avg("h_meas").alias("b"), F.avg(0.9 * F.col("h_meas") + 0.01).alias("a"))
    return rounded(effects.layer_stats(p, ["label"], "capture", "b", "a"), 6, "before_max", "after_max", "before_median", "after_median")


@query("range_anchor", f"WITH {PLACEMENTS} SELECT camera, label, round(median(h_true), 8) AS true_median, round(median(h_meas), 8) AS measured_median, round(median(h_meas) - median(h_true), 8) AS excess, round(median(h_meas) / median(h_true), 6) AS ratio FROM placements GROUP BY ALL")
def range_anchor(t):
    a = effects.range_anchor(t.placements(), ["camera", "label"], "h_true", "h_meas")
    return rounded(rounded(a, 8, "true_median", "measured_median", "excess"), 6, "ratio")


@query("range_anchor_rig", f"WITH {PLACEMENTS}, r AS (SELECT camera, label, median(h_meas) / median(h_true) AS ratio FROM placements GROUP BY ALL) SELECT camera, round(avg(ratio), 6) AS ratio_mean, round(stddev_pop(ratio), 6) AS ratio_sd FROM r GROUP BY camera")
def range_anchor_rig(t):
    return rounded(effects.range_anchor_rig(effects.range_anchor(t.placements(), ["camera", "label"], "h_true", "h_meas"), ["camera"]), 6, "ratio_mean", "ratio_sd")


@query("relief_report", f"""WITH {PLACEMENTS}, l AS (SELECT camera, count(*) AS n, regr_slope(h_meas, h_true) AS k, regr_intercept(h_meas, h_true) AS c FROM placements GROUP BY camera), r AS (SELECT p.camera, label, h_meas - (k * h_true + c) AS r FROM placements p JOIN l USING (camera)),
  g AS (SELECT camera, label, count(*) AS m, avg(r) AS mean, var_pop(r) AS v FROM r GROUP BY ALL) SELECT camera, any_value(n) AS n, round(any_value(k), 6) AS k, round(any_value(c), 6) AS c, round(sqrt(sum(m * mean * mean) / sum(m)), 6) AS between_rms, round(sqrt(sum(m * v) / sum(m)), 6) AS within_rms FROM g JOIN l USING (camera) GROUP BY camera""")
def relief_report(t):
    return rounded(effects.relief_report(t.placements(), ["camera"], "label", "h_true", "h_meas"), 6, "k", "c", "between_rms", "within_rms")


@query("relief_field", f"""WITH {PLACEMENTS}, s AS (SELECT camera, label, h_true AS h, h_true - h_meas AS m, h_true * (o_orderkey % 97) / 97 AS hx, h_true * (o_orderkey % 89) / 89 AS hy, (o_orderkey % 7) / 7 AS w FROM placements),
  a AS (SELECT camera, label, count(*) AS n, regr_slope(m, h) AS k, regr_intercept(m, h) AS c, regr_slope(hx, h) AS ax, regr_intercept(hx, h) AS bx, regr_slope(hy, h) AS ay, regr_intercept(hy, h) AS b_y, median(w) AS within_rms FROM s GROUP BY ALL HAVING count(*) >= 3),
  r AS (SELECT camera, label, m - (k * h + c) AS m1, hx - (ax * h + bx) AS x1, hy - (ay * h + b_y) AS y1 FROM s JOIN a USING (camera, label)), b AS (SELECT camera, label, sum(m1 * x1) / sum(x1 * x1) AS p, sum(y1 * x1) / sum(x1 * x1) AS q, sqrt(avg(m1 * m1)) AS between_rms FROM r GROUP BY ALL),
  v AS (SELECT camera, label, m1 - p * x1 AS m2, y1 - q * x1 AS y2 FROM r JOIN b USING (camera, label)), d AS (SELECT camera, label, sum(m2 * y2) / sum(y2 * y2) AS ky FROM v GROUP BY ALL), e AS (SELECT camera, label, sqrt(avg(pow(m2 - ky * y2, 2))) AS field_rms FROM v JOIN d USING (camera, label) GROUP BY ALL)
  SELECT camera, label, n, round(k, 5) AS compression, round(c, 5) AS "offset", round(between_rms, 5) AS between_rms, round(within_rms, 6) AS within_rms, CASE WHEN n >= 8 THEN round(field_rms, 5) END AS field_rms, CASE WHEN n >= 8 THEN round(c - (p - ky * q) * bx - ky * b_y, 4) END AS field_c0,
  CASE WHEN n >= 8 THEN round(k - (p - ky * q) * ax - ky * ay, 4) END AS field_k0, CASE WHEN n >= 8 THEN round(p - ky * q, 4) END AS field_kx, CASE WHEN n >= 8 THEN round(ky, 4) END AS field_ky FROM a JOIN b USING (camera, label) JOIN d USING (camera, label) JOIN e USING (camera, label)""")
def relief_field(t):
    p = t.placements().withColumn("x", F.col("o_orderkey") % 97 / 97).withColumn("y", F.col("o_orderkey") % 89 / 89).withColumn("w", F.col("o_orderkey") % 7 / 7)
    r = effects.relief_field(p, ["camera", "label"], "x", "y", "h_true", "h_meas", "w")
    return rounded(rounded(rounded(r, 5, "compression", "offset", "between_rms", "field_rms"), 6, "within_rms"), 4, "field_c0", "field_k0", "field_kx", "field_ky")


@query("plane_separation_report", f"""WITH {PLACEMENTS}, c AS (SELECT label, camera, median(h_meas) AS m FROM placements GROUP BY ALL), d AS (SELECT label, max(m) - min(m) AS camera_delta FROM c GROUP BY label)
  SELECT label, round(median(h_meas), 8) AS measured_median, count(*) AS n, round(avg(h_true), 6) AS nominal, round(stddev_samp(h_meas), 6) AS scatter, round(any_value(camera_delta), 8) AS camera_delta, round(median(h_meas) - avg(h_true), 6) AS error FROM placements JOIN d USING (label) GROUP BY label""")
def plane_separation_report(t):
    r = effects.plane_separation_report(t.placements(), [], "label", "camera", "h_meas", "h_true")
    return rounded(rounded(r, 8, "measured_median", "camera_delta"), 6, "nominal", "scatter", "error")


@query("leave_one_height_out", f"""WITH {PLACEMENTS}, f AS (SELECT a.camera, a.label, regr_slope(b.h_meas, b.h_true) AS p, regr_intercept(b.h_meas, b.h_true) AS q FROM (SELECT DISTINCT camera, label FROM placements) a JOIN placements b ON a.camera = b.camera AND a.label <> b.label GROUP BY ALL)
  SELECT camera, label, round(any_value(p), 6) AS p, round(any_value(q), 6) AS q, round(sqrt(avg(pow(h_meas - (p * h_true + q), 2))), 6) AS held_out_rms, count(*) AS n, round(median(h_meas - (p * h_true + q)), 6) AS held_out_median FROM placements JOIN f USING (camera, label) GROUP BY camera, label""")
def leave_one_height_out(t):
    return rounded(robust.leave_one_height_out(t.placements(), ["camera"], "label", "h_true", "h_meas"), 6, "p", "q", "held_out_rms", "held_out_median")


@query("leave_one_plane_out", f"""WITH {PLACEMENTS}, f AS (SELECT a.camera, a.label, regr_slope(b.h_true, b.h_meas) AS p, regr_intercept(b.h_true, b.h_meas) AS q FROM (SELECT DISTINCT camera, label FROM placements) a JOIN placements b ON a.camera = b.camera AND a.label <> b.label GROUP BY ALL)
  SELECT camera, label, round(sqrt(avg(pow(h_meas - h_true, 2))), 6) AS rms_before, round(sqrt(avg(pow(h_true - (p * h_meas + q), 2))), 6) AS rms_after, count(*) AS n, round(median(h_meas - h_true), 8) AS median_before, round(median(h_true - (p * h_meas + q)), 6) AS median_after FROM placements JOIN f USING (camera, label) GROUP BY camera, label""")
def leave_one_plane_out(t):
    r = robust.leave_one_plane_out(t.placements(), ["camera"], "label", "h_meas", "h_true")
    return rounded(rounded(r, 6, "rms_before", "rms_after", "median_after"), 8, "median_before")


def effect_cells(t: Tables):
    rows = t.placements().withColumn("rig", F.lit(0)).withColumn("x", F.ascii("capture") + F.length("capture")).groupBy("rig", "camera", "capture").agg(
        F.avg("h_meas").alias("h_meas"), F.avg("h_true").alias("h_true"))
    return effects.effect_cells(rows, ["rig"], "h_true", "h_meas")


@query("pooled_effect", f"WITH {PLACEMENTS}, r AS (SELECT camera, capture, avg(h_meas) AS y, avg(h_true) AS x FROM placements GROUP BY ALL) SELECT CAST(0 AS BIGINT) AS rig, round(regr_slope(y, x), 6) AS p_bar, round(regr_intercept(y, x), 6) AS q_bar FROM r")
def pooled_effect(t):
    p = effects.solve_effects(effect_cells(t), ["rig"])[0]
    return rounded(p.withColumn("rig", F.col("rig").cast("long")), 6, "p_bar", "q_bar")


@query("camera_effects")
def camera_effects(t):
    return rounded(effects.solve_effects(effect_cells(t), ["rig"])[1], 6, "a", "b")


# offsets only: with every camera in every capture the effects are plain marginal means
@query("camera_offsets", f"""WITH {PLACEMENTS}, r AS (SELECT camera, capture, avg(h_meas) AS y, avg(h_true) AS x FROM placements GROUP BY ALL), full_ AS (SELECT * FROM r WHERE capture IN (SELECT capture FROM r GROUP BY capture HAVING count(*) = 5)), l AS (SELECT regr_slope(y, x) AS p, regr_intercept(y, x) AS q FROM full_),
  e AS (SELECT camera, y - (p * x + q) AS r FROM full_ CROSS JOIN l) SELECT camera, round(avg(r) - (SELECT avg(r) FROM e), 6) AS b FROM e GROUP BY camera""")
def camera_offsets(t):
    c = effect_cells(t)
    whole = c.groupBy("capture").agg(F.count(F.lit(1)).alias("k")).filter("k = 5").select("capture")
    return rounded(effects.solve_effects(c.join(whole, "capture", "left_semi"), ["rig"], slopes=False)[1].select("camera", "b"), 6, "b")


@query("cluster_bootstrap")
def cluster_bootstrap(t):
    return rounded(effects.cluster_bootstrap(effect_cells(t), ["rig"], 400), 6, "a_sd", "b_sd", "p_sd", "q_sd")


@query("belt_vs_board_drift", f"""WITH {PLACEMENTS}, a AS (SELECT camera, capture, median(h_meas - h_true) AS x FROM placements WHERE label <> 'P' GROUP BY ALL HAVING count(*) >= 2), b AS (SELECT camera, capture, median(h_meas - h_true) AS y FROM placements WHERE label = 'P' GROUP BY ALL)
  SELECT camera, count(*) AS captures, round(corr(x, y), 6) AS correlation, round(avg(y - x), 6) AS mean_difference FROM a JOIN b USING (camera, capture) GROUP BY camera""")
def belt_vs_board_drift(t):
    p = t.placements().withColumn("e", F.col("h_meas") - F.col("h_true"))
    d = effects.belt_vs_board_drift(p.filter("label <> 'P'"), p.filter("label = 'P'"), ["camera"], "capture", "e", 2)
    return rounded(d, 6, "correlation", "mean_difference")


@query("grade_summary", f"""WITH {PLACEMENTS}, m AS (SELECT label, capture, h_meas - h_true AS e, abs(h_true) AS c, h_meas / 10 AS s FROM placements), r AS (SELECT label, capture, stddev_samp(e) AS sd FROM m GROUP BY ALL HAVING count(*) >= 2), q AS (SELECT label, median(sd) AS repeatability FROM r GROUP BY label)
  SELECT label, count(*) AS held, round(avg(e), 6) AS mean_error, round(stddev_samp(e), 6) AS sd_error, round(max_by(e, abs(e)), 8) AS worst_error, round(avg(c), 6) AS centre_mean, round(max(c), 8) AS centre_worst, round(corr(e, s), 6) AS r_error_spread, round(any_value(repeatability), 6) AS repeatability FROM m JOIN q USING (label) GROUP BY label""")
def grade_summary(t):
    m = t.placements().select("label", "capture", (F.col("h_meas") - F.col("h_true")).alias("e"), F.abs("h_true").alias("c"), (F.col("h_meas") / 10).alias("s"))
    g = effects.grade_summary(m, ["label"], "capture", "e", "c", "s")
    return rounded(rounded(g, 6, "mean_error", "sd_error", "centre_mean", "r_error_spread", "repeatability"), 8, "worst_error", "centre_worst")


@query("plane_leverage_se", f"WITH {PLACEMENTS} SELECT camera, count(*) AS n, round(0.01 * sqrt(1.0 / count(*) + pow(0.8 - avg(h_true), 2) / (var_pop(h_true) * count(*))), 8) AS se FROM placements GROUP BY camera")
def plane_leverage_se(t):
    return rounded(robust.plane_leverage_se(t.placements(), ["camera"], "h_true", F.lit(0.8), F.lit(0.01)).select("camera", "n", "se"), 8, "se")


# --- parcels ------------------------------------------------------------------------------------

SD = "sqrt(pow(greatest({qx}, 0), 2) + pow(greatest({qy}, 0), 2)) + least(greatest({qx}, {qy}), 0)"
# axis-aligned footprints: gap from the corners of each to the other
GAP = """pr AS (SELECT a.*, b.id AS o_id, b.cu AS ocu, b.cv AS ocv, b.length AS ol, b.width AS ow, b.top AS otop FROM boxes a JOIN boxes b ON a.capture = b.capture AND a.id <> b.id),
  cr AS (SELECT *, least(""" + ", ".join(
    [SD.format(qx=f"(abs(cu + {a} * length / 2 - ocu) - ol / 2)", qy=f"(abs(cv + {b} * width / 2 - ocv) - ow / 2)") for a in (-1, 1) for b in (-1, 1)]
    + [SD.format(qx=f"(abs(ocu + {a} * ol / 2 - cu) - length / 2)", qy=f"(abs(ocv + {b} * ow / 2 - cv) - width / 2)") for a in (-1, 1) for b in (-1, 1)]) + ") AS gap FROM pr)"


def parcels(t: Tables):
    return t.boxes().withColumn("yaw", F.lit(0.0))


@query("box_relations", f"""WITH {BOXES}, {GAP}, rel AS (SELECT capture, id, list_sort(list(o_id) FILTER (gap < 0.005 AND otop - top > 0.02)) AS blk, max(CASE WHEN otop - top < -0.02 AND abs(cu - ocu) <= ol / 2 AND abs(cv - ocv) <= ow / 2 THEN otop END) AS sup, max(CASE WHEN otop - top < -0.02 AND abs(cu - ocu) <= ol / 2 AND abs(cv - ocv) <= ow / 2 THEN {{'t': otop, 'i': o_id}} END).i AS sup_id, min(gap) AS gap FROM cr GROUP BY ALL)
  SELECT b.capture, b.id, coalesce(len(blk), 0) AS blockers, coalesce(array_to_string(blk, ' '), '') AS blocked_by, sup_id AS supported_by, round(gap, 8) AS gap, round(coalesce(sup, 0), 8) AS support_height, round(b.top - coalesce(sup, 0), 8) AS height, sup IS NOT NULL AS height_inferred FROM boxes b LEFT JOIN rel USING (capture, id)""")
def box_relations(t):
    r = boxes.box_relations(parcels(t), ["capture"], 0.75, reach=0.5).withColumn("blocked_by", F.array_join("blocked_by", " "))
    return rounded(r.select("capture", "id", "blockers", "blocked_by", "supported_by", "gap", "support_height", "height", "height_inferred"), 8, "gap", "support_height", "height")


@query("nearest_gap", f"WITH {BOXES}, {GAP} SELECT capture, id, round(min(gap), 8) AS gap FROM cr GROUP BY ALL")
def nearest_gap(t):
    return rounded(boxes.nearest_gap(parcels(t), ["capture"], 0.5, 0.75).select("capture", "id", "gap"), 8, "gap")


@query("suppress_overlaps", f"""WITH RECURSIVE {BOXES}, s AS (SELECT *, coverage * inlier_fraction * ln(1 + n_points) AS score FROM boxes), o AS (SELECT a.capture, a.id, b.id AS o_id, b.score AS os FROM s a JOIN s b ON a.capture = b.capture AND a.id <> b.id AND (b.score > a.score OR (b.score = a.score AND b.id < a.id)) AND abs(a.top - b.top) < 0.1
  AND greatest(0, least(a.cu + a.length / 2, b.cu + b.length / 2) - greatest(a.cu - a.length / 2, b.cu - b.length / 2)) * greatest(0, least(a.cv + a.width / 2, b.cv + b.width / 2) - greatest(a.cv - a.width / 2, b.cv - b.width / 2)) > 0),
  iou AS (SELECT o.* FROM o JOIN s a ON a.id = o.id JOIN s b ON b.id = o.o_id, LATERAL (SELECT (least(a.cu + a.length / 2, b.cu + b.length / 2) - greatest(a.cu - a.length / 2, b.cu - b.length / 2)) * (least(a.cv + a.width / 2, b.cv + b.width / 2) - greatest(a.cv - a.width / 2, b.cv - b.width / 2)) AS i) x WHERE i / (a.length * a.width + b.length * b.width - i) > 0.05),
  rk AS (SELECT capture, id, row_number() OVER (PARTITION BY capture ORDER BY score DESC, id) AS k FROM s), st AS (SELECT capture, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT capture FROM s)
  UNION ALL SELECT st.capture, rk.k, CASE WHEN EXISTS (SELECT 1 FROM iou WHERE iou.id = rk.id AND list_contains(st.kept, iou.o_id)) THEN kept ELSE list_append(kept, rk.id) END FROM st JOIN rk ON rk.capture = st.capture AND rk.k = st.k + 1)
  SELECT f.capture, s.id, list_contains(f.kept, s.id) AS kept FROM (SELECT capture, max_by(kept, k) AS kept FROM st GROUP BY capture) f JOIN s USING (capture)""")
def suppress_overlaps(t):
    return boxes.suppress_overlaps(parcels(t), ["capture"], 0.75, iou=0.05, level_gap=0.1).select("capture", "id", "kept")


@query("resolve_two_passes")
def resolve_two_passes(t):
    p = parcels(t)
    return rounded(boxes.resolve_two_passes(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), ["capture"], 0.75, 0.05, 0.2, 1.1).select("capture", "id", "top", "origin"), 8, "top")


@query("pick_order", f"WITH {BOXES} SELECT capture, id, row_number() OVER (PARTITION BY capture ORDER BY top DESC, n_points DESC, id) - 1 AS pick_order FROM boxes")
def pick_order(t):
    return boxes.pick_order(t.boxes(), ["capture"]).select("capture", "id", "pick_order")


@query("pick_order_hot", f"WITH {BOXES} SELECT capture, id, row_number() OVER (PARTITION BY capture ORDER BY top DESC, n_points DESC, id) - 1 AS pick_order FROM boxes")
def pick_order_hot(t):
    # every capture counts as hot: the bucketed ranks must be the same
    return boxes.pick_order(t.boxes(), ["capture"], hot_rows=5).select("capture", "id", "pick_order")


@query("renumber_ids", f"WITH {BOXES} SELECT capture, id, row_number() OVER (PARTITION BY capture ORDER BY id) - 1 AS new_id FROM boxes WHERE coverage >= 0.55")
def renumber_ids(t):
    return groups.rank_in_group(t.boxes().filter("coverage >= 0.55"), ["capture"], [("id", "asc")], "new_id").select("capture", "id", "new_id")


@query("parcel_shape_filter", f"""WITH {BOXES}, r AS (SELECT CASE WHEN width < 0.17 OR length > 0.65 THEN 'footprint outside the accepted range' WHEN length / greatest(width, 1e-6) > 4 THEN 'sliver' WHEN length * width < 0.05 THEN 'top face too small' END AS reason FROM boxes) SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def parcel_shape_filter(t):
    r = t.boxes().withColumn("reason", F.coalesce(filters.parcel_shape(F.col("length"), F.col("width"), 0.17, 0.65, 4.0, 0.05), F.lit("accepted")))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("pick_verdict", f"WITH {BOXES} SELECT capture, count(*) AS n, count(*) FILTER (coverage >= 0.55) AS pickable, count(*) FILTER (coverage < 0.55) AS blocked FROM boxes GROUP BY capture")
def pick_verdict(t):
    v = boxes.pick_verdict(t.boxes())
    return v.groupBy("capture").agg(F.count(F.lit(1)).alias("n"), F.count_if("pickable").alias("pickable"), F.sum(F.size("blocking_reasons").cast("long")).alias("blocked"))


@query("wrap_yaw", f"SELECT p_partkey AS id, round((((p_partkey * 7.5 + 90) % 180) + 180) % 180 - 90, 6)::DOUBLE AS yaw FROM part")
def wrap_yaw(t):
    from voxelloom.functions.geometry import wrap_yaw as wrap

    return rounded(t.table("part").select(F.col("p_partkey").alias("id"), wrap(F.col("p_partkey") * 7.5).alias("yaw")), 6, "yaw")


@query("rect_corners", f"WITH {BOXES} SELECT id, round(cu - length / 2, 8) AS x0, round(cv - width / 2, 8) AS y0, round(cu + length / 2, 8) AS x2, round(cv + width / 2, 8) AS y2, round(top + 0.1, 8) AS pre_pick, CAST(8 AS BIGINT) AS corners FROM boxes")
def rect_corners(t):
    from voxelloom.functions import geometry as g

    one, zero = F.lit(1.0), F.lit(0.0)
    c, ax, ay, n = g.vec("cu", "cv", "top"), (one, zero, zero), (zero, one, zero), (zero, zero, one)
    b = t.boxes().withColumn("_c", g.rect_corners(c, ax, ay, F.col("length"), F.col("width"))).withColumn("_8", g.cuboid_corners(c, ax, ay, n, F.col("length"), F.col("width"), F.col("top")))
    out = b.select("id", F.col("_c")[0]["x"].alias("x0"), F.col("_c")[0]["y"].alias("y0"), F.col("_c")[2]["x"].alias("x2"), F.col("_c")[2]["y"].alias("y2"), g.pre_pick(c, n)[2].alias("pre_pick"), F.size("_8").cast("long").alias("corners"))
    return rounded(out, 8, "x0", "y0", "x2", "y2", "pre_pick")


MATCH = f"""{BOXES}, det AS (SELECT capture, id, cu + 0.02 AS x, cv - 0.03 AS y FROM boxes), ref AS (SELECT capture, id, cu AS x, cv + (id % 11) / 100 AS y FROM boxes)"""


def detections(t: Tables):
    b = t.boxes()
    det = b.select("capture", "id", (F.col("cu") + 0.02).alias("x"), (F.col("cv") - 0.03).alias("y"), "length", "width", "top")
    ref = b.select("capture", "id", F.col("cu").alias("x"), (F.col("cv") + F.col("id") % 11 / 100).alias("y"), "length", "width", "top")
    return det, ref


@query("match_nearest", f"""WITH {MATCH}, p AS (SELECT d.capture, d.id, r.id AS ref_id, sqrt(pow(d.x - r.x, 2) + pow(d.y - r.y, 2)) AS dist FROM det d JOIN ref r USING (capture)) SELECT capture, id, min_by(ref_id, (round(dist, 9), ref_id)) AS ref_id, round(min(dist), 8) AS dist FROM p WHERE dist <= 0.9 GROUP BY ALL""")
def match_nearest(t):
    det, ref = detections(t)
    return rounded(boxes.match_nearest(det, ref, ["capture"], 0.9), 8, "dist")


@query("unmatched_refs", f"""WITH {MATCH}, p AS (SELECT d.capture, d.id, r.id AS ref_id, sqrt(pow(d.x - r.x, 2) + pow(d.y - r.y, 2)) AS dist FROM det d JOIN ref r USING (capture)), m AS (SELECT capture, id, min_by(ref_id, (round(dist, 9), ref_id)) AS ref_id FROM p WHERE dist <= 0.9 GROUP BY ALL)
  SELECT capture, count(*) AS refs, count(*) FILTER (id IN (SELECT ref_id FROM m)) AS found FROM ref GROUP BY capture""")
def unmatched_refs(t):
    det, ref = detections(t)
    r = boxes.unmatched_refs(ref, boxes.match_nearest(det, ref, ["capture"], 0.9), ["capture"])
    return r.groupBy("capture").agg(F.count(F.lit(1)).alias("refs"), F.sum("found").alias("found"))


@query("match_greedy", f"""WITH RECURSIVE {MATCH}, p AS (SELECT d.capture, d.id, r.id AS ref_id, sqrt(pow(d.x - r.x, 2) + pow(d.y - r.y, 2)) AS dist FROM det d JOIN ref r USING (capture) WHERE sqrt(pow(d.x - r.x, 2) + pow(d.y - r.y, 2)) < 0.9),
  o AS (SELECT capture, id, row_number() OVER (PARTITION BY capture ORDER BY id) AS k FROM det), st AS (SELECT capture, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS ids FROM (SELECT DISTINCT capture FROM det)
  UNION ALL SELECT st.capture, o.k, CASE WHEN b.ref_id IS NULL THEN used ELSE list_append(used, b.ref_id) END, CASE WHEN b.ref_id IS NULL THEN ids ELSE list_append(ids, o.id) END FROM st JOIN o ON o.capture = st.capture AND o.k = st.k + 1
  LEFT JOIN LATERAL (SELECT arg_min(p.ref_id, (round(p.dist, 9), p.ref_id)) AS ref_id FROM p WHERE p.capture = st.capture AND p.id = o.id AND NOT list_contains(st.used, p.ref_id)) b ON true),
  f AS (SELECT capture, max_by(used, k) AS used, max_by(ids, k) AS ids FROM st GROUP BY capture) SELECT capture, unnest(ids) AS id, unnest(used) AS ref_id FROM f""")
def match_greedy(t):
    det, ref = detections(t)
    return boxes.match_greedy(det, ref, ["capture"], 0.9).select("capture", "id", "ref_id")


@query("match_by_dimensions")
def match_by_dimensions(t):
    det, ref = detections(t)
    return rounded(boxes.match_by_dimensions(det.withColumn("scene", F.col("capture")), ref.withColumn("scene", F.col("capture")), ["scene"]), 8, "cost")


@query("score_run", f"""WITH {MATCH}, d AS (SELECT capture, id, length * 1.01 AS length, width * 0.98 AS width, top + 0.004 AS height, length AS rl, width AS rw, top AS rh, id % 4 = 0 AS inferred FROM boxes)
  SELECT capture, count(*) AS n, round(avg(abs(greatest(length, width) - greatest(rl, rw))), 6) AS length_mae, round(avg(greatest(length, width) - greatest(rl, rw)), 6) AS length_bias, round(avg(abs(least(length, width) - least(rl, rw))), 6) AS width_mae,
  round(avg(least(length, width) - least(rl, rw)), 6) AS width_bias, round(avg(abs(height - rh)) FILTER (NOT inferred), 6) AS height_mae, round(avg(height - rh) FILTER (NOT inferred), 6) AS height_bias FROM d GROUP BY capture""")
def score_run(t):
    m = t.boxes().select("capture", (F.col("length") * 1.01).alias("length"), (F.col("width") * 0.98).alias("width"), (F.col("top") + 0.004).alias("height"), F.col("length").alias("ref_length"), F.col("width").alias("ref_width"),
                         F.col("top").alias("ref_height"), (F.col("id") % 4 == 0).alias("height_inferred"))
    return rounded(boxes.score_run(m, ["capture"]), 6, *[f"{a}_{b}" for a in ("length", "width", "height") for b in ("mae", "bias")])


@query("track_across")
def track_across(t):
    b = t.boxes().select("p_type", "id", (F.col("id") % 4).alias("res"), F.col("cu").alias("x"), F.col("cv").alias("y"), (F.col("p_size") % 90).cast("double").alias("yaw"), "length").withColumnRenamed("p_type", "scene")
    return rounded(boxes.track_across(b, ["scene"], "res", 0.5), 8, "yaw_spread", "length_spread")


def triple_log(t: Tables):
    """Detections as a log: capture = order of a supplier's parts, time from its id."""
    b = t.boxes()
    return b.select(F.floor(F.col("id") / 20).alias("capture"), (F.floor(F.col("id") / 20) * 400.0).alias("ts_s"), "id", F.col("cu").alias("x"), (F.col("cv") - F.floor(F.col("id") / 20) % 40 * 0.45 + F.col("p_size") / 10000).alias("y"), F.col("top").alias("height"), F.lit(0).alias("rig"))


@query("track_triples", f"""WITH {BOXES}, log AS (SELECT id // 20 AS capture, (id // 20) * 400.0 AS ts, id, cu AS x, cv - ((id // 20) % 40) * 0.45 + CAST(p_size AS DOUBLE) / 10000 AS y, top AS h FROM boxes JOIN (SELECT p_partkey AS id, p_size FROM part) USING (id)),
  caps AS (SELECT capture, min(ts) AS ts FROM log GROUP BY capture HAVING count(*) >= 6), pc AS (SELECT a.capture AS a, b.capture AS b FROM caps a JOIN caps b ON a.capture < b.capture AND abs(a.ts - b.ts) <= 1800),
  nn AS (SELECT pc.a, pc.b, l.id, min_by(r.h, (round(sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)), 9), r.id)) AS h, min(sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2))) AS d FROM pc JOIN log l ON l.capture = pc.a JOIN log r ON r.capture = pc.b GROUP BY ALL),
  ok AS (SELECT * FROM nn WHERE d <= 0.02), tr AS (SELECT x.a, x.b, y.b AS c, x.id, x.h AS hb, y.h AS hc, l.h AS ha FROM ok x JOIN ok y ON x.a = y.a AND x.id = y.id AND x.b < y.b JOIN caps p ON p.capture = x.b JOIN caps q ON q.capture = y.b AND abs(p.ts - q.ts) <= 1800 JOIN log l ON l.id = x.id)
  SELECT a, b, c, count(*) AS tracks, round(sum(greatest(ha, hb, hc) - least(ha, hb, hc)), 6) AS score FROM tr GROUP BY a, b, c""")
def track_triples(t):
    tr = boxes.track_triples(triple_log(t), ["rig"], 1800.0, 0.02)
    return rounded(tr.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("tracks"), F.sum("height_range").alias("score")), 6, "score")


@query("best_triples")
def best_triples(t):
    return rounded(boxes.best_triples(boxes.track_triples(triple_log(t), ["rig"], 1800.0, 0.02), ["rig"]), 6, "score")


ON_BOX = f"""{BOXES}, {CLOUD}, pt AS (SELECT 'Brand#' || (1 + l_partkey % 25) AS capture, (l_partkey % 1000) * CAST(0.009 AS DOUBLE) AS u, (l_orderkey % 2000) * CAST(0.009 AS DOUBLE) AS v, h / 400 AS h FROM cloud)"""


def belt_points(t: Tables):
    c = t.cloud()
    return c.select(F.concat(F.lit("Brand#"), (1 + F.col("l_partkey") % 25).cast("string")).alias("capture"), (F.col("l_partkey") % 1000 * 0.009).alias("u"), (F.col("l_orderkey") % 2000 * 0.009).alias("v"), (F.col("h") / 400).alias("h"),
                    F.col("camera"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("pid"))


@query("points_in_footprints", f"WITH {ON_BOX} SELECT b.capture, b.id, count(*) AS n FROM boxes b JOIN pt p ON p.capture = b.capture AND abs(p.u - b.cu) <= b.length / 2 AND abs(p.v - b.cv) <= b.width / 2 GROUP BY ALL")
def points_in_footprints(t):
    return boxes.points_in_footprints(parcels(t), belt_points(t), ["capture"], [], 0.75).groupBy("capture", "id").agg(F.count(F.lit(1)).alias("n"))


@query("see_through", f"""WITH {ON_BOX}, i AS (SELECT b.capture, b.id, floor((u - cu + length * 0.425) / 0.02) AS gu, floor((v - cv + width * 0.425) / 0.02) AS gv, abs(h) <= 0.1 AS deck FROM boxes b JOIN pt p ON p.capture = b.capture AND abs(p.u - b.cu) <= b.length * 0.85 / 2 AND abs(p.v - b.cv) <= b.width * 0.85 / 2),
  c AS (SELECT capture, id, gu, gv, count(*) AS n, count(*) FILTER (deck) AS d FROM i GROUP BY ALL), s AS (SELECT capture, id, sum(n) AS n, sum(d) AS d, count(*) FILTER (d > 0) / count(*) AS f FROM c GROUP BY ALL)
  SELECT b.capture, b.id, CASE WHEN coalesce(n, 0) >= 4 THEN round(f, 8) ELSE 0 END AS see_through, CAST(CASE WHEN coalesce(n, 0) >= 4 THEN d ELSE 0 END AS BIGINT) AS deck_points FROM boxes b LEFT JOIN s USING (capture, id)""")
def see_through(t):
    return rounded(boxes.see_through(parcels(t), belt_points(t), ["capture"], 0.1, 0.75, min_points=4), 8, "see_through")


@query("occluded_views")
def occluded_views(t):
    cams = t.boxes().select("capture").distinct().withColumn("_c", F.explode(F.array(*[F.struct(F.lit(n).alias("camera"), F.lit(u).alias("ku"), F.lit(v).alias("kv"), F.lit(2.0).alias("kh")) for n, u, v in (("left", -1.0, 4.0), ("right", 10.0, 4.0))]))).select("capture", "_c.*")
    return rounded(boxes.occluded_views(parcels(t), cams, ["capture"]), 6, "hidden")


@query("artefact_screen", f"""WITH {BOXES} SELECT coalesce(CASE WHEN coverage > 0.9 THEN 'deck seen through it' WHEN inlier_fraction > 0.85 THEN 'points on a sight edge' WHEN top / 0.05 < 3 THEN 'height within noise' END, 'kept') AS artefact, count(*) AS n FROM boxes GROUP BY ALL""")
def artefact_screen(t):
    b = t.boxes().select("*", F.col("coverage").alias("see_through"), F.col("inlier_fraction").alias("bleed"), F.lit(2).alias("views"), F.lit(0).alias("views_blocked"), F.col("top").alias("height"), F.lit(0.05).alias("noise"))
    return boxes.artefact_screen(b, 0.9, 0.85, 3.0).groupBy(F.coalesce("artefact", F.lit("kept")).alias("artefact")).agg(F.count(F.lit(1)).alias("n"))


@query("sight_edge_bleed")
def sight_edge_bleed(t):
    # boxes alike in footprint and top bleed alike; such a twin is a neighbour, too
    box, members = boxes.shapes(parcels(t), ["capture"], [*boxes.RECT, "top"])
    corners = boxes.footprint_corners("o_")
    near = boxes.near_pairs(box, ["capture"], 0.3, ["top"], 0.75, box).filter("id <> o_id or _k > 1")
    near = near.repartition("capture", "id")  # a few small files of shapes make many pairs
    edges = near.select("capture", "id", F.explode(F.array(*[
        F.struct(F.lit("left").alias("camera"), corners[k][0].alias("ax"), corners[k][1].alias("ay"), F.col("o_top").alias("az"), corners[(k + 1) % 4][0].alias("bx"), corners[(k + 1) % 4][1].alias("by_"), F.col("o_top").alias("bz"),
                 F.lit(4.0).alias("kx"), F.lit(4.0).alias("ky"), F.lit(3.0).alias("kz"), F.col("o_top").alias("top")) for k in range(4)])).alias("_e")).select("capture", "id", "_e.*")
    pts = boxes.points_in_footprints(box, belt_points(t), ["capture"], ["top"], 0.75).select("capture", "id", F.lit("left").alias("camera"), "pid", F.col("u").alias("x"), F.col("v").alias("y"), F.col("h").alias("z"), "h", F.col("top").alias("h_self"))
    bled = boxes.sight_edge_bleed(pts, edges, ["capture"], 0.05, 2, -1.0).withColumnRenamed("id", "_shape")
    return rounded(members.join(bled, ["capture", "_shape"]).drop("_shape"), 6, "bleed")


@query("dominant_camera", f"""WITH {ON_BOX}, k AS (SELECT run_id, capture, camera, count(*) AS k FROM cloud GROUP BY ALL) SELECT run_id, capture, max_by(camera, (k, camera)) AS dominant_camera, round(max(k) / sum(k), 8) AS dominant_fraction, count(*) AS cameras, max(k) / sum(k) >= 0.8 AS single_view FROM k GROUP BY ALL""")
def dominant_camera(t):
    return rounded(boxes.dominant_camera(t.cloud(), ["run_id", "capture"]), 8, "dominant_fraction")


@query("pca_extent", f"""WITH {ON_BOX}, m AS (SELECT capture, avg(u) AS mx, avg(v) AS my, 0.5 * atan2(2 * covar_pop(u, v), var_pop(u) - var_pop(v)) AS yaw FROM pt GROUP BY capture), r AS (SELECT capture, (u - mx) * cos(yaw) + (v - my) * sin(yaw) AS a, (v - my) * cos(yaw) - (u - mx) * sin(yaw) AS b FROM pt JOIN m USING (capture)),
  q AS (SELECT capture, count(*) AS n, quantile_cont(a, 0.99) - quantile_cont(a, 0.01) AS la, quantile_cont(b, 0.99) - quantile_cont(b, 0.01) AS lb FROM r GROUP BY capture) SELECT capture, n, round(mx, 9) AS mx, round(my, 9) AS my, round(yaw, 5) AS yaw, round(greatest(la, lb), 5) AS length, round(least(la, lb), 5) AS width FROM q JOIN m USING (capture)""")
def pca_extent(t):
    return rounded(rounded(boxes.pca_extent(belt_points(t), ["capture"]), 9, "mx", "my"), 5, "yaw", "length", "width")


@query("min_area_rect")
def min_area_rect(t):
    return rounded(boxes.min_area_rect(belt_points(t), ["capture"], 0.05), 6, "cu", "cv", "length", "width", "yaw", "coverage")


@query("comb_fraction", f"""WITH {ON_BOX} , e AS (SELECT capture, count(*) AS n, min(u) AS u0, max(u) - min(u) AS us, greatest(4, floor((max(u) - min(u)) / 0.05)) AS ub, min(v) AS v0, max(v) - min(v) AS vs, greatest(4, floor((max(v) - min(v)) / 0.05)) AS vb FROM pt GROUP BY capture)
  SELECT capture, CASE WHEN any_value(n) < 12 THEN 0.0 ELSE round(greatest(0.0, least(1.0, CASE WHEN any_value(us) < 0.15 THEN 0.0 ELSE 1 - count(DISTINCT least(floor((u - u0) * ub / nullif(us, 0)), ub - 1)) / any_value(ub) END
  - CASE WHEN any_value(vs) < 0.15 THEN 0.0 ELSE 1 - count(DISTINCT least(floor((v - v0) * vb / nullif(vs, 0)), vb - 1)) / any_value(vb) END)), 8) END AS comb FROM pt JOIN e USING (capture) GROUP BY capture""")
def comb_fraction(t):
    return rounded(boxes.comb_fraction(belt_points(t), ["capture"], "u", "v", 0.05), 8, "comb")


@query("curtain_filter", f"""WITH {ON_BOX}, c AS (SELECT capture, count(*) FILTER (h > 0.05 AND h < 0.15) AS mid, count(*) FILTER (h >= 0.17) AS face FROM pt GROUP BY capture) SELECT capture, mid, face, round(mid / greatest(face, 1), 8) AS skirt_ratio, mid / greatest(face, 1) > 1.0 AS is_curtain FROM c""")
def curtain_filter(t):
    c = filters.curtain_filter(belt_points(t).withColumn("top", F.lit(0.2)), ["capture"], "h", "top", 0.03, 1.0)
    return rounded(c, 8, "skirt_ratio")


@query("view_consensus")
def view_consensus(t):
    f = t.boxes().select(F.floor(F.col("id") / 4).alias("surface"), F.element_at(F.array(*[F.lit(c) for c in runs.CAMERAS]), (F.col("id") % 4 + 1).cast("int")).alias("camera"), (F.col("top") / 10).alias("offset"), F.col("n_points").cast("double").alias("weight"),
                         (F.col("p_size") + 20.0).alias("incidence"), (F.col("p_size") / 10).alias("tilt"), F.lit(0.0).alias("cu"), F.lit(0.0).alias("cv"), F.lit(0.5).alias("length"), (0.3 + F.col("width") * 0.1).alias("width"), F.lit(0.0).alias("yaw"), (F.col("coverage") / 100).alias("deck_bias"))
    return rounded(boxes.view_consensus(f, ["surface"])[0], 6, "consensus", "offset_spread", "tilt_spread", "max_shift", "worst_incidence", "uncertainty")


@query("top_face")
def top_face(t):
    p = belt_points(t).select("capture", "pid", F.col("u").alias("x"), F.col("v").alias("y"), F.col("h").alias("z"))
    f = boxes.top_face(p, ["capture"], band=0.02, tol=0.01, min_points=3)
    return rounded(f.select("capture", "inliers", "top", "residual_rms", "residual_p95", "tilt_deg", "inlier_fraction"), 6, "top", "residual_rms", "residual_p95", "tilt_deg", "inlier_fraction")


@query("peel_levels")
def peel_levels(t):
    p = belt_points(t).select("capture", "pid", F.col("u").alias("x"), F.col("v").alias("y"), F.col("h").alias("z"))
    f = boxes.peel_levels(p, ["capture"], 2, 0.02, 3, band=0.02, tol=0.01, shape={"max_dim": 25.0, "max_aspect": 30.0})
    return rounded(f.select("capture", "attempt", "level", "reason", "inliers", "n_points", "height", "length", "width"), 5, "height", "length", "width")


@query("extract_parcels")
def extract_parcels(t):
    r = rasters.height_raster(t.cloud(), ["run_id"], 1.0, 22.0, 4.0)
    p = boxes.label_parcels(boxes.parcel_components(r, ["run_id"], 1.0, 45.0), ["run_id"])
    return rounded(p.select("run_id", "parcel", "cells", "mx", "length", "width", "p97_height", "core_height"), 6, "mx", "length", "width", "p97_height", "core_height")


@query("recover_unclaimed")
def recover_unclaimed(t):
    pts = belt_points(t)
    # a point is claimed by a footprint, however many boxes stand on it
    places = parcels(t).groupBy("capture", *boxes.RECT).agg(F.min("id").alias("id"))
    claimed = boxes.points_in_footprints(places, pts, ["capture"], [], 0.75).select("capture", "pid")
    return rounded(boxes.recover_unclaimed(pts, claimed, ["capture"], 0.5, 0.9, 2), 8, "top", "fill")


@query("classify_surface", f"""WITH {CLOUD}, d AS (SELECT l_orderkey, h, avg(h) OVER w AS m, stddev_pop(h) OVER w AS sd FROM cloud WINDOW w AS (PARTITION BY l_orderkey)),
  s AS (SELECT l_orderkey, max(sd) AS rms, avg(CASE WHEN sd > 1e-9 THEN pow((h - m) / sd, 3) ELSE 0 END) AS skew, max(h) - min(h) AS relief, count(*) AS n, (max(h) - avg(h)) / (max(h) - min(h) + 1) AS peak FROM d GROUP BY l_orderkey)
  SELECT l_orderkey, CASE WHEN peak >= 0.45 AND relief / n BETWEEN 5 AND 15 AND relief >= 40 AND abs(skew) >= 0.3 THEN 'granular' WHEN rms <= 15 AND n / 7.0 >= 0.4 THEN 'planar' WHEN relief <= 60 THEN 'film' ELSE 'rough' END AS surface FROM s""")
def classify_surface(t):
    height = F.max("h") - F.min("h")
    s = t.cloud().groupBy("l_orderkey").agg(F.stddev_pop("h").alias("rms"), F.skewness("h").alias("skew"), height.alias("relief"), F.count("*").alias("n"), ((F.max("h") - F.avg("h")) / (height + 1)).alias("peak"))
    c = runs.classify_surface(F.col("rms"), F.col("skew"), F.col("peak"), F.col("relief") / F.col("n"), F.col("relief"), F.col("n") / 7.0,
                              min_relief=40.0, min_peak=0.45, pitches=(5.0, 15.0), min_skew=0.3, max_rms=15.0, min_fill=0.4, max_relief=60.0)
    return s.select("l_orderkey", c.alias("surface"))


# --- calibration data ---------------------------------------------------------------------------

CORNERS = """corners AS (SELECT l_returnflag AS camera, l_suppkey AS frame, l_partkey AS corner_id, avg(l_quantity) AS u, avg(l_discount * 100) AS v, avg(l_tax) AS r FROM lineitem GROUP BY ALL)"""


def corners(t: Tables):
    return t.table("lineitem").groupBy(F.col("l_returnflag").alias("camera"), F.col("l_suppkey").alias("frame"), F.col("l_partkey").alias("corner_id")).agg(F.avg("l_quantity").alias("u"), F.avg(F.col("l_discount") * 100).alias("v"), F.avg("l_tax").alias("r"))


@query("corner_correspondences", f"""WITH {CORNERS}, j AS (SELECT a.frame, a.corner_id, a.u AS u_a, b.u AS u_b FROM corners a JOIN corners b USING (frame, corner_id) WHERE a.camera = 'A' AND b.camera = 'R'), f AS (SELECT frame, count(*) AS shared, row_number() OVER (ORDER BY frame) - 1 AS frame_rank FROM j GROUP BY frame HAVING count(*) >= 3)
  SELECT frame, corner_id, round(u_a, 6) AS u_a, round(u_b, 6) AS u_b, shared, frame_rank FROM j JOIN f USING (frame) WHERE frame_rank < 40""")
def corner_correspondences(t):
    c = corners(t)
    m = joins.corner_correspondences(c.filter("camera = 'A'"), c.filter("camera = 'R'"), [], 3, 40)
    return rounded(m.select("frame", "corner_id", "u_a", "u_b", "shared", "frame_rank"), 6, "u_a", "u_b")


@query("calibration_views", f"WITH {CORNERS}, v AS (SELECT camera, frame, count(*) AS corners, sqrt(sum(r * r) / count(*)) AS rms FROM corners GROUP BY ALL) SELECT camera, frame, corners, round(rms, 8) AS rms, round(median(rms) OVER (PARTITION BY camera), 8) AS median_rms, rms > 1.05 * median(rms) OVER (PARTITION BY camera) AS dropped FROM v")
def calibration_views(t):
    return rounded(calib.calibration_views(corners(t), ["camera"], "frame", "r", 1.05), 8, "rms", "median_rms")


@query("frame_coverage", f"WITH {CORNERS} SELECT camera, frame, count(DISTINCT greatest(0, least(7, floor(u * 8 / 51.0))) * 8 + greatest(0, least(7, floor(v * 8 / 11.0)))) / 64.0::DOUBLE AS coverage FROM corners GROUP BY ALL")
def frame_coverage(t):
    return calib.frame_coverage(corners(t), ["camera", "frame"], 51.0, 11.0)


@query("pair_coverage", f"WITH {CORNERS}, f AS (SELECT DISTINCT camera, frame FROM corners) SELECT a.camera AS cam_a, b.camera AS cam_b, count(*) AS shared_frames FROM f a JOIN f b ON a.frame = b.frame AND a.camera < b.camera GROUP BY ALL")
def pair_coverage(t):
    return calib.pair_coverage(corners(t), [])


@query("focal_spread", "SELECT s_nationkey AS rig, round((max(s_acctbal) - min(s_acctbal)) / avg(s_acctbal), 6) AS spread, min_by(s_suppkey, s_acctbal) AS lowest, max_by(s_suppkey, s_acctbal) AS highest FROM supplier GROUP BY s_nationkey")
def focal_spread(t):
    s = t.table("supplier").select(F.col("s_nationkey").alias("rig"), F.col("s_suppkey").alias("camera"), F.col("s_acctbal").alias("fx"))
    return rounded(calib.focal_spread(s, ["rig"]), 6, "spread")


def poses(t: Tables):
    """Relative rotations about the vertical, from the keys of line items: exact composition but for a small excess."""
    li = t.table("supplier").select(F.col("s_nationkey").alias("rig"), F.col("s_suppkey").alias("k"), F.explode(F.array(*[F.struct(F.lit(a).alias("cam_a"), F.lit(b).alias("cam_b"), F.lit(w).alias("w")) for a, b, w in (("a", "b", 1), ("b", "c", 2), ("a", "c", 3))])).alias("p")).select("rig", "k", "p.*")
    ang = F.col("w") * 0.1 + F.when(F.col("w") == 3, F.col("k") % 7 * 0.001).otherwise(0.0)
    c, s, z, o = F.cos(ang), F.sin(ang), F.lit(0.0), F.lit(1.0)
    return li.select("rig", "k", "cam_a", "cam_b", F.array(c, -s, z, s, c, z, z, z, o).alias("R"), F.array(F.col("w") * 0.1, z, F.col("k") % 3 * 0.01).alias("t"))


@query("chain_consistency", "SELECT s_nationkey AS rig, s_suppkey AS k, round(degrees(0.001 * (s_suppkey % 7)), 4) AS angle_deg FROM supplier")
def chain_consistency(t):
    return rounded(calib.chain_consistency(poses(t), ["rig", "k"]).select("rig", "k", "angle_deg"), 4, "angle_deg")


@query("relative_pose_spread")
def relative_pose_spread(t):
    return rounded(calib.relative_pose_spread(poses(t), ["rig", "cam_a", "cam_b"]), 4, "angle_mean", "angle_max", "t0_sd", "t1_sd", "t2_sd")


@query("sharpness_percentiles", "SELECT event_type AS camera, count(*) AS n, round(quantile_cont(value, 0.05), 8) AS p5, round(quantile_cont(value, 0.25), 8) AS p25, round(median(value), 8) AS p50, round(quantile_cont(value, 0.75), 8) AS p75, round(quantile_cont(value, 0.95), 8) AS p95 FROM events GROUP BY ALL HAVING count(*) >= 5")
def sharpness_percentiles(t):
    e = t.table("events").select(F.col("event_type").alias("camera"), "value")
    return rounded(calib.sharpness_percentiles(e, ["camera"], "value"), 8, "p5", "p25", "p50", "p75", "p95")


@query("intrinsics_consistency", "WITH f AS (SELECT s_nationkey AS rig, s_suppkey, s_acctbal AS fx, first_value(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS f0 FROM supplier) SELECT rig, s_suppkey, abs(fx - f0) <= 2000 AS same_as_first, round(fx / 5000, 8) AS fx_ratio, fx / 5000 < 0.98 OR fx / 5000 > 1.02 AS flagged FROM f")
def intrinsics_consistency(t):
    s = t.table("supplier").select(F.col("s_nationkey").alias("rig"), "s_suppkey", F.col("s_acctbal").alias("fx"), F.lit(5000.0).alias("scaled"))
    return rounded(calib.intrinsics_consistency(s, ["rig"], ["s_suppkey"], "fx", "scaled", 2000.0).select("rig", "s_suppkey", "same_as_first", "fx_ratio", "flagged"), 8, "fx_ratio")


SETS = f"""{FRAMES}, fs AS (SELECT rig, date_trunc('hour', ts) AS capture, camera, max(epoch_us(ts)) * 1000 AS host, CASE WHEN max(seq) % 5 > 0 THEN max(epoch_us(ts)) * 1000 + max(seq) % 1000 END AS dev FROM frames GROUP BY ALL)"""


def frame_sets(t: Tables):
    return t.frames().groupBy("rig", F.date_trunc("hour", "ts").alias("capture"), "camera").agg(
        F.max(F.unix_micros("ts") * 1000).alias("host_ts_ns"), F.when(F.max("seq") % 5 > 0, F.max(F.unix_micros("ts")) * 1000 + F.max("seq") % 1000).alias("dev_ts_ns"))


@query("skew_report", f"""WITH {SETS}, a AS (SELECT rig, capture, count(*) AS cameras, count(dev) = count(*) AS dv, CASE WHEN count(dev) = count(*) THEN max(dev) - min(dev) ELSE max(host) - min(host) END AS span, CASE WHEN count(dev) = count(*) THEN arg_max(camera, (dev, camera)) END AS worst_camera FROM fs GROUP BY rig, capture) SELECT rig, capture, cameras, CASE WHEN dv THEN 'device' ELSE 'host' END AS clock, round(span / 1e6, 6) AS skew_ms, worst_camera FROM a""")
def skew_report(t):
    return rounded(calib.skew_report(frame_sets(t), ["rig", "capture"]), 6, "skew_ms")


@query("sync_filter", f"""WITH {SETS}, a AS (SELECT rig, capture, count(*) AS n_frames, CASE WHEN count(dev) = count(*) THEN max(dev) - min(dev) ELSE max(host) - min(host) END / 1e6 AS s FROM fs GROUP BY ALL) SELECT rig, capture, n_frames, round(s, 6) AS spread_ms, s <= 600000 AS in_sync FROM a""")
def sync_filter(t):
    return rounded(filters.sync_filter(frame_sets(t), ["rig", "capture"], 600000.0), 6, "spread_ms")


@query("exposure_uniformity", f"WITH {FRAMES} SELECT rig, CAST(count(DISTINCT camera) AS BIGINT) AS camera_values, CAST(count(DISTINCT user_id) AS BIGINT) AS user_id_values, count(DISTINCT camera) <= 1 AND count(DISTINCT user_id) <= 1 AS uniform FROM frames GROUP BY rig")
def exposure_uniformity(t):
    return calib.exposure_uniformity(t.frames(), ["rig"], ["camera", "user_id"])


@query("lens_gate", f"WITH {FRAMES} SELECT rig, count(*) FILTER (camera = 'click') AS matching, count(*) FILTER (camera <> 'click') AS other, array_to_string(list_sort(list(DISTINCT camera) FILTER (camera <> 'click')), ',') AS other_lenses FROM frames GROUP BY rig")
def lens_gate(t):
    return filters.lens_gate(t.frames(), ["rig"], "camera", "click")


@query("mixed_lens", f"WITH {FRAMES} SELECT user_id, count(DISTINCT camera) AS lenses FROM frames GROUP BY user_id HAVING count(DISTINCT camera) > 1")
def mixed_lens(t):
    return filters.mixed_lens(t.frames(), ["user_id"], "camera")


VIS = f"""{CLOUD}, cl AS (SELECT run_id, CAST(floor(u / 2) AS BIGINT) AS iu, CAST(floor(v) AS BIGINT) AS iv, CASE camera WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS bit, min(h) AS inc FROM cloud GROUP BY ALL)"""
SUBSETS = "s AS (SELECT unnest(generate_series(1, 7)) AS subset)"


def vis_cells(t: Tables):
    return t.cloud().groupBy("run_id", rasters.cell_floor("u", 2.0).alias("iu"), rasters.cell_floor("v", 1.0).alias("iv"), F.when(F.col("camera") == "A", 0).when(F.col("camera") == "N", 1).otherwise(2).alias("bit")).agg(F.min("h").alias("incidence"))


@query("subset_visibility", f"""WITH {VIS}, {SUBSETS}, m AS (SELECT run_id, iu, iv, bit_or(1::BIGINT << bit) AS mask FROM cl GROUP BY ALL) SELECT run_id, subset, CAST(bit_count(subset) AS BIGINT) AS n_cams, count(*) FILTER (bit_count(mask & subset) >= least(bit_count(subset), 2)) AS cells,
  CAST(count(*) FILTER (bit_count(mask & subset) >= least(bit_count(subset), 2)) * 4 AS DOUBLE) AS area FROM m CROSS JOIN s GROUP BY ALL""")
def subset_visibility(t):
    return joins.subset_visibility(vis_cells(t), ["run_id"], 3, 2.0)


@query("coverage_gated", f"""WITH {VIS}, {SUBSETS}, m AS (SELECT run_id, iu, iv, bit_or(1::BIGINT << bit) AS mask, coalesce(bit_or(1::BIGINT << bit) FILTER (inc <= 20), 0) AS gm FROM cl GROUP BY ALL) SELECT run_id, subset, CAST(bit_count(subset) AS BIGINT) AS n_cams,
  CAST(count(*) FILTER (bit_count(mask & subset) >= least(bit_count(subset), 2)) * 4 AS DOUBLE) AS area_all, CAST(count(*) FILTER (bit_count(gm & subset) >= least(bit_count(subset), 2)) * 4 AS DOUBLE) AS area_gated FROM m CROSS JOIN s GROUP BY ALL""")
def coverage_gated(t):
    return calib.coverage_gated(vis_cells(t), ["run_id"], 3, 2.0, 20.0)


@query("camera_subsets", "WITH c AS (SELECT list_sort(list(DISTINCT r_name)) AS a FROM region), m AS (SELECT a, unnest(generate_series(1, 31)) AS mask FROM c) SELECT mask, array_to_string(list_filter(a, lambda x: (mask >> (list_position(a, x) - 1)) & 1 = 1), '+') AS subset, CAST(bit_count(mask) AS BIGINT) AS n_cams FROM m")
def camera_subsets(t):
    return calib.camera_subsets(t.table("region").withColumnRenamed("r_name", "camera"), [])


# --- runs and logs ------------------------------------------------------------------------------


@query("parse_run", r"""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'center+left' WHEN 1 THEN 'top' WHEN 2 THEN 'right,center' ELSE 'left+rear' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_res' || (o_orderkey % 900) END AS name FROM orders)
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'left+center' WHEN 1 THEN 'top' WHEN 2 THEN 'center+right' END AS subset, CAST(CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS BIGINT) AS n_cams, CASE WHEN o_orderkey % 4 < 3 THEN CAST(nullif(regexp_extract(name, '_res(\d+)', 1), '') AS BIGINT) END AS res FROM n""")
def parse_run(t):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 4 == 0, "center+left").when(k % 4 == 1, "top").when(k % 4 == 2, "right,center").otherwise("left+rear"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_res"), (k % 900).cast("string"))))
    return t.table("orders").select("o_orderkey", runs.parse_run(name).alias("r")).select("o_orderkey", "r.subset", "r.n_cams", "r.res")


@query("parse_paths", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, CAST(nullif(regexp_extract(url, '/(\d+)(?:[?#].*)?$', 1), '') AS BIGINT) AS number FROM pages")
def parse_paths(t):
    return t.table("pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"), F.nullif(F.regexp_extract("url", r"/(\d+)(?:[?#].*)?$", 1), F.lit("")).cast("long").alias("number"))


@query("parse_time", "SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS t_iso, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS t_compact, round(value, 6) AS t_number FROM events")
def parse_time(t):
    e = t.table("events")
    r = e.select("event_id", runs.parse_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("t_iso"), runs.parse_time(F.date_format("ts", "yyyyMMdd_HHmmss")).alias("t_compact"), runs.parse_time(F.col("value").cast("string")).alias("t_number"))
    return rounded(r, 6, "t_iso", "t_number")


@query("run_register", "WITH r AS (SELECT o_orderstatus AS subset, abs(o_totalprice / 250000 - 1) AS d FROM orders) SELECT subset, count(*) AS runs, count(*) FILTER (d < 0.1) AS admitted, count(*) FILTER (d >= 0.1) AS excluded FROM r GROUP BY subset")
def run_register(t):
    o = t.table("orders").select(F.col("o_orderstatus").alias("subset"), (F.col("o_totalprice") / 250000).alias("scale"))
    return runs.register_counts(runs.run_register(o), ["subset"])


@query("holdout_register", "WITH h AS (SELECT o_orderpriority AS split, o_totalprice / 1000 AS b, o_totalprice / 1000 + o_orderkey % 30 - 14 AS a FROM orders) SELECT split, count(*) AS holdouts, count(*) FILTER (a > b) AS worsened, round(min(b), 8) AS before_min, round(max(b), 8) AS before_max, round(min(a - b), 6) AS change_min, round(max(a - b), 6) AS change_max FROM h GROUP BY split")
def holdout_register(t):
    h = t.table("orders").select(F.col("o_orderpriority").alias("split"), (F.col("o_totalprice") / 1000).alias("b"), (F.col("o_totalprice") / 1000 + F.col("o_orderkey") % 30 - 14).alias("a"))
    return rounded(rounded(runs.holdout_register(h, ["split"], "b", "a"), 8, "before_min", "before_max"), 6, "change_min", "change_max")


@query("stage_stats", f"""WITH s AS (SELECT event_type AS stage, count(*) AS n, avg(value) AS mean, median(value) AS median, list_sort(list(value)) AS l, min(value) AS mn, max(value) AS mx FROM events GROUP BY ALL)
  SELECT stage, n, round(median, 8) AS median, round(mean, 6) AS mean, mn AS min, mx AS max, l[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p95 FROM s""")
def stage_stats(t):
    s = runs.stage_stats(t.table("events").withColumnRenamed("event_type", "stage"), ["stage"], "value")
    return rounded(rounded(s, 8, "median"), 6, "mean")


@query("stage_stats_hot", f"""WITH s AS (SELECT event_type AS stage, count(*) AS n, list_sort(list(value)) AS l FROM events GROUP BY ALL) SELECT stage, n, l[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p95, l[least(CAST(floor(0.05 * n) AS BIGINT), n - 1) + 1] AS p5 FROM s""")
def stage_stats_hot(t):
    return groups.order_statistics(t.table("events").withColumnRenamed("event_type", "stage"), ["stage"], "value", {"p95": groups.nearest(0.95), "p5": groups.truncated(0.05)}, hot_rows=50)


BENCH = """b AS (SELECT o_orderpriority AS subset, o_orderstatus AS res, o_orderkey % 10 AS rep, o_totalprice / 1000 AS inference, o_totalprice / 4000 + o_custkey % 100 AS backproject, 10.0 + o_custkey % 7 AS rectify, o_orderkey % 13 = 0 AS failed FROM orders)"""


def bench_rows(t: Tables):
    return t.table("orders").select(F.col("o_orderpriority").alias("subset"), F.col("o_orderstatus").alias("res"), (F.col("o_orderkey") % 10).alias("rep"), (F.col("o_totalprice") / 1000).alias("inference"),
                                    (F.col("o_totalprice") / 4000 + F.col("o_custkey") % 100).alias("backproject"), (10.0 + F.col("o_custkey") % 7).alias("rectify"), (F.col("o_orderkey") % 13 == 0).alias("failed"))


@query("bench_summary", f"""WITH {BENCH}, s AS (SELECT subset, res, count(*) FILTER (rep >= 2 AND NOT failed) AS repeats, count(*) FILTER (failed) AS failures, avg(inference) FILTER (rep >= 2 AND NOT failed) AS i, avg(backproject) FILTER (rep >= 2 AND NOT failed) AS p, avg(rectify) FILTER (rep >= 2 AND NOT failed) AS r FROM b GROUP BY ALL)
  SELECT subset, res, repeats, failures, round(i, 6) AS inference, round(p, 6) AS backproject, round(r, 6) AS rectify, round(i + p + r, 6) AS total, round(1000 / (i + p + r), 6) AS rate, round(100 * i / (i + p + r), 6) AS inference_pct, CASE WHEN i >= p AND i >= r THEN 'inference' WHEN p >= r THEN 'backproject' ELSE 'rectify' END AS dominant FROM s""")
def bench_summary(t):
    s = runs.bench_summary(bench_rows(t), ["subset", "res"], ["inference", "backproject", "rectify"], "rep", 2, "failed")
    return rounded(s, 6, "inference", "backproject", "rectify", "total", "rate", "inference_pct").drop("backproject_pct", "rectify_pct")


@query("bench_pivot", f"WITH {BENCH}, s AS (SELECT subset, res, avg(inference) FILTER (rep >= 1 AND NOT failed) + avg(backproject) FILTER (rep >= 1 AND NOT failed) + avg(rectify) FILTER (rep >= 1 AND NOT failed) AS t FROM b GROUP BY ALL) SELECT subset, round(max(t) FILTER (res = 'F'), 6) AS F, round(max(t) FILTER (res = 'O'), 6) AS O, round(max(t) FILTER (res = 'P'), 6) AS P FROM s GROUP BY subset")
def bench_pivot(t):
    s = runs.bench_summary(bench_rows(t), ["subset", "res"], ["inference", "backproject", "rectify"], "rep", 1, "failed")
    return rounded(runs.bench_pivot(s, "subset", "res", ["F", "O", "P"]), 6, "F", "O", "P")


@query("run_ordering", "SELECT subset, runs, row_number() OVER (ORDER BY runs DESC, subset) - 1 AS position FROM (SELECT o_orderpriority AS subset, count(*) AS runs FROM orders GROUP BY ALL)")
def run_ordering(t):
    g = t.table("orders").groupBy(F.col("o_orderpriority").alias("subset")).agg(F.count(F.lit(1)).alias("runs"))
    return groups.rank_in_group(g, [], [("runs", "desc"), ("subset", "asc")], "position")


@query("power_law", """WITH r AS (SELECT o_orderpriority AS subset, ln(o_custkey + 1) AS x, ln(o_totalprice / 1e6) AS y FROM orders), f AS (SELECT subset, count(*) AS points, regr_slope(y, x) AS k, exp(regr_intercept(y, x)) AS a FROM r GROUP BY subset)
  SELECT subset, any_value(points) AS points, round(any_value(k), 6) AS exponent, round(sqrt(avg(pow(a * exp(k * x) - exp(y), 2))), 4) AS rms_power, round(sqrt(avg(pow(a * exp(x) - exp(y), 2))), 4) AS rms_linear, round(sqrt(avg(pow(a * exp(2 * x) - exp(y), 2))), 4) AS rms_quadratic FROM r JOIN f USING (subset) GROUP BY subset""")
def power_law(t):
    o = t.table("orders").select(F.col("o_orderpriority").alias("subset"), (F.col("o_custkey") + 1).alias("n"), (F.col("o_totalprice") / 1e6).alias("t"))
    return rounded(rounded(robust.power_law(o, ["subset"], "n", "t"), 6, "exponent"), 4, "rms_power", "rms_linear", "rms_quadratic")


@query("acquisition_rate", f"""WITH {FRAMES}, g AS (SELECT rig, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY rig ORDER BY ts)) / 1e6 AS gap FROM frames), r AS (SELECT rig, 1 / gap AS rate FROM g WHERE gap > 0), q AS (SELECT rig, median(rate) AS m, list_sort(list(rate)) AS l, count(*) AS n FROM r GROUP BY rig),
  b AS (SELECT rig, count(*) AS sets, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS e FROM frames GROUP BY rig) SELECT rig, sets, round(e, 6) AS elapsed_s, round(sets / e, 9) AS rate, round(sets / e * 60.1, 8) AS payload_mb_s, round(1 - sets / e / 4.16, 8) AS shortfall, round(m, 9) AS rate_median,
  round(l[least(CAST(floor(0.05 * n) AS BIGINT), n - 1) + 1], 9) AS rate_p5, round(l[least(CAST(floor(0.95 * n) AS BIGINT), n - 1) + 1], 9) AS rate_p95 FROM b JOIN q USING (rig)""")
def acquisition_rate(t):
    a = runs.acquisition_rate(t.frames(), ["rig"], "ts", 60.1, 4.16)
    return rounded(rounded(rounded(a, 6, "elapsed_s"), 9, "rate", "rate_median", "rate_p5", "rate_p95"), 8, "payload_mb_s", "shortfall")


@query("inter_set_gap", f"WITH {FRAMES} SELECT rig, seq, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY rig ORDER BY ts, seq)) / 1e6, 6) AS gap_s FROM frames")
def inter_set_gap(t):
    g = groups.lag_in_group(t.frames(), ["rig"], [("ts", "asc"), ("seq", "asc")], "ts")
    return rounded(g.select("rig", "seq", ((F.unix_micros("ts") - F.unix_micros("prev")) / 1e6).alias("gap_s")), 6, "gap_s")


@query("inter_set_gap_hot", f"WITH {FRAMES} SELECT rig, seq, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY rig ORDER BY ts, seq)) / 1e6, 6) AS gap_s FROM frames")
def inter_set_gap_hot(t):
    g = groups.lag_in_group(t.frames(), ["rig"], [("ts", "asc"), ("seq", "asc")], "ts", hot_rows=50)
    return rounded(g.select("rig", "seq", ((F.unix_micros("ts") - F.unix_micros("prev")) / 1e6).alias("gap_s")), 6, "gap_s")


@query("rolling_rate", f"""WITH {FRAMES}, w AS (SELECT rig, seq, count(*) OVER r AS n, epoch_us(ts) - min(epoch_us(ts)) OVER r AS span FROM frames WINDOW r AS (PARTITION BY rig ORDER BY ts, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT rig, seq, CASE WHEN span > 0 THEN round((n - 1) / (span / 1e6), 9) END AS rate FROM w""")
def rolling_rate(t):
    r = runs.rolling_rate(t.frames(), ["rig"], "ts", [("ts", "asc"), ("seq", "asc")], 30)
    return rounded(r.select("rig", "seq", "rate"), 9, "rate")


@query("metadata_inventory", "SELECT event_id AS path, 'k' AS keypath, json_extract_string(props, '$.k') AS value FROM events")
def metadata_inventory(t):
    return runs.metadata_inventory(t.table("events").select(F.col("event_id").alias("path"), F.col("props").alias("value")), **runs.FOR_READING)


@query("metadata_inventory_nested", """SELECT conv_id * 100000 + turn AS path, unnest(['turn', 'who.role', 'who.ids[0]', 'who.ids[1]', 'size']) AS keypath, unnest([CAST(turn AS VARCHAR), role, CAST(conv_id AS VARCHAR), CAST(turn + 1 AS VARCHAR), CAST(length(text) AS VARCHAR)]) AS value FROM conversations""")
def metadata_inventory_nested(t):
    c = t.table("conversations")
    doc = F.to_json(F.struct("turn", F.struct("role", F.array("conv_id", F.col("turn") + 1).alias("ids")).alias("who"), F.length("text").alias("size")))
    return runs.metadata_inventory(c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("path"), doc.alias("value")), **runs.FOR_READING)


@query("metadata_inventory_whole", """SELECT l_orderkey AS path, 'lines[' || i || '].' || k AS keypath, CAST(CASE k WHEN 'part' THEN l_partkey ELSE l_linenumber END AS VARCHAR) AS value FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem), (VALUES ('part'), ('line')) k(k) UNION ALL SELECT l_orderkey, 'note', repeat('x', 400) FROM lineitem GROUP BY l_orderkey""")
def metadata_inventory_whole(t):
    lines = t.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    body = F.transform("l", lambda x: F.struct(x["l_partkey"].alias("part"), x["l_linenumber"].alias("line")))
    return runs.metadata_inventory(lines.select(F.col("l_orderkey").alias("path"), F.to_json(F.struct(body.alias("lines"), F.repeat(F.lit("x"), 400).alias("note"))).alias("value")))


@query("csv_inventory", """SELECT p_partkey AS path, unnest(['[columns]', '[n_columns]', 'col.id', 'col.a, b', 'col.name']) AS keypath,
  unnest(['id, a, b, name', '3', p_partkey || ' | ' || p_size, p_brand || ';"x" | ', p_type || ' | 7']) AS value FROM part""")
def csv_inventory(t):
    doc = F.format_string('id,"a, b",name\n%s,"%s;""x""",%s\r\n%s,,7\n', F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"))
    return runs.csv_inventory(t.table("part").select(F.col("p_partkey").alias("path"), doc.alias("value")))


@query("check_targets", "SELECT 'k values' AS target, count(*) AS hits, count(*) AS strong, CASE WHEN count(*) > 0 THEN 'LIKELY PRESENT' ELSE 'NOT FOUND' END AS status FROM events UNION ALL SELECT 'exposure', 0, 0, 'NOT FOUND' UNION ALL SELECT 'purchases', count(*), 0, 'PARTIAL' FROM events WHERE event_type = 'purchase'")
def check_targets(t):
    inv = runs.metadata_inventory(t.table("events").select(F.concat_ws("/", "event_type", "event_id").alias("path"), F.col("props").alias("value")), **runs.FOR_READING)
    return runs.check_targets(inv, [{"name": "k values", "hints": ["/"], "needs": ["k"]}, {"name": "exposure", "hints": ["exposure"], "needs": ["us"]}, {"name": "purchases", "hints": ["Purchase"], "needs": ["nothing"]}])


@query("union_drifting_logs", """SELECT p_brand AS capture, p_partkey AS id, p_size AS n_points, CAST(NULL AS DOUBLE) AS coverage FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_brand, p_partkey, p_size, 0.4 + (p_partkey % 13) / 20 FROM part WHERE p_partkey % 2 = 1""")
def union_drifting_logs(t):
    b = t.boxes().select("capture", "id", F.col("p_size").cast("int").alias("n_points"), "coverage")
    return b.filter("id % 2 = 0").drop("coverage").unionByName(b.filter("id % 2 = 1"), allowMissingColumns=True)


@query("set_operations", f"""WITH {CLOUD}, c AS (SELECT DISTINCT camera, l_partkey FROM cloud) SELECT 'both' AS part, count(*) AS n FROM (SELECT l_partkey FROM c WHERE camera = 'A' INTERSECT SELECT l_partkey FROM c WHERE camera = 'R') UNION ALL SELECT 'only A', count(*) FROM (SELECT l_partkey FROM c WHERE camera = 'A' EXCEPT SELECT l_partkey FROM c WHERE camera = 'R')""")
def set_operations(t):
    c = t.cloud().select("camera", "l_partkey")
    a, r = c.filter("camera = 'A'").select("l_partkey"), c.filter("camera = 'R'").select("l_partkey")
    both = a.intersect(r).agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("part"), "n")
    return both.unionByName(a.distinct().join(r, "l_partkey", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("only A").alias("part"), "n"))


@query("classify_camera_bias", f"""WITH {PLACEMENTS}, c AS (SELECT camera, label, regr_slope(h_meas, h_true) AS s, avg(h_meas - h_true) - 2.2 AS o, abs(corr(h_meas, h_true)) * 10 AS t FROM placements GROUP BY ALL)
  SELECT camera, label, CASE WHEN abs(s - 1) > 0.01 AND abs(o) > 0.01 THEN 'scale and offset' WHEN abs(s - 1) > 0.01 THEN 'scale' WHEN abs(o) > 0.01 THEN 'offset' WHEN t > 0.5 THEN 'tilt' ELSE 'consistent' END AS verdict FROM c""")
def classify_camera_bias(t):
    c = t.placements().groupBy("camera", "label").agg(F.regr_slope("h_meas", "h_true").alias("s"), (F.avg(F.col("h_meas") - F.col("h_true")) - 2.2).alias("o"), (F.abs(F.corr("h_meas", "h_true")) * 10).alias("t"))
    return c.select("camera", "label", planes.classify_camera_bias(F.col("s"), F.col("o"), F.col("t")).alias("verdict"))


@query("classify_layering", f"""WITH {CLOUD}, s AS (SELECT run_id, count(*) FILTER (h < 5) / count(*) AS b, stddev_pop(h) AS a FROM cloud GROUP BY run_id) SELECT run_id, CASE WHEN b > 0.01 THEN 'clip below the deck' ELSE 'spatially varying correction' END AS first_action FROM s""")
def classify_layering(t):
    s = t.cloud().groupBy("run_id").agg((F.count_if(F.col("h") < 5) / F.count(F.lit(1))).alias("b"), F.stddev_pop("h").alias("a"))
    return s.select("run_id", runs.classify_layering(F.col("b"), F.lit(1.0), F.lit(2.0), F.col("a"), F.lit(0.9))[0].alias("first_action"))


@query("residual_after_deployed", f"WITH {PLACEMENTS} SELECT camera, round(avg(1.05 * (h_true - h_meas) + (0.05 * h_true - 0.01)), 6) AS residual FROM placements GROUP BY camera")
def residual_after_deployed(t):
    from voxelloom.functions.geometry import residual_after_deployed as resid

    return rounded(t.placements().groupBy("camera").agg(F.avg(resid(F.col("h_true") - F.col("h_meas"), F.col("h_true"), F.lit(1.05), F.lit(-0.01))).alias("residual")), 6, "residual")


@query("two_plane_scale_offset", f"""WITH {PLACEMENTS}, z AS (SELECT camera, CASE WHEN label = 'F' THEN 'near' ELSE 'far' END AS surface, avg(h_meas) + CASE WHEN label = 'F' THEN 0 ELSE 1 END AS z FROM placements WHERE label IN ('F', 'O') GROUP BY camera, label),
  l AS (SELECT camera, surface, z, (sum(z) OVER (PARTITION BY surface) - z) / (count(*) OVER (PARTITION BY surface) - 1) AS r FROM z), w AS (SELECT camera, max(z) FILTER (surface = 'near') AS zn, max(z) FILTER (surface = 'far') AS zf, max(r) FILTER (surface = 'near') AS rn, max(r) FILTER (surface = 'far') AS rf FROM l GROUP BY camera)
  SELECT camera, round((zf - zn) / (rf - rn), 6) AS scale, round(zn - (zf - zn) / (rf - rn) * rn, 6) AS offset FROM w""")
def two_plane_scale_offset(t):
    p = t.placements().filter("label in ('F', 'O')").groupBy("camera", "label").agg(F.avg("h_meas").alias("m")).select("camera", F.when(F.col("label") == "F", "near").otherwise("far").alias("surface"), (F.col("m") + F.when(F.col("label") == "F", 0).otherwise(1)).alias("z"))
    return rounded(planes.two_plane_scale_offset(p), 6, "scale", "offset")


LAY = f"""{CLOUD}, ly AS (SELECT capture, camera, avg(h) AS x FROM cloud GROUP BY ALL), ok AS (SELECT capture FROM ly GROUP BY capture HAVING count(*) = 3)"""


@query("order_preserving_assignment", f"""WITH {LAY}, xs AS (SELECT capture, list_sort(list(x)) AS x FROM ly WHERE capture IN (SELECT capture FROM ok) GROUP BY capture), ix AS (SELECT a, b, c FROM (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 5)) AS b), (SELECT unnest(range(0, 5)) AS c) WHERE a < b AND b < c),
  r AS (SELECT capture, [a, b, c] AS assignment, unnest(x) AS x, unnest([a, b, c]) * 5.0 + 20 AS y FROM xs, ix), f AS (SELECT capture, assignment, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) / 3) AS rms FROM r GROUP BY ALL)
  SELECT capture, round(min(rms) FILTER (s BETWEEN 0.2 AND 4), 5) AS rms, count(*) FILTER (s BETWEEN 0.2 AND 4) AS candidates FROM f GROUP BY capture HAVING count(*) FILTER (s BETWEEN 0.2 AND 4) > 0""")
def order_preserving_assignment(t):
    ly = t.cloud().groupBy("capture", "camera").agg(F.avg("h").alias("x"))
    truth = t.table("region").select((F.col("r_regionkey") * 5.0 + 20).alias("y"))
    a = joins.order_preserving_assignment(ly, truth, ["capture"], 3)
    return rounded(a.groupBy("capture").agg(F.min("rms").alias("rms"), F.count(F.lit(1)).alias("candidates")), 5, "rms")


@query("match_planes_to_truth")
def match_planes_to_truth(t):
    m = t.cloud().groupBy("capture", "camera").agg((F.avg("h") / 100).alias("m"))
    truth = t.table("region").select((F.col("r_regionkey") * 0.05 + 0.4).alias("t"), F.col("r_name").alias("label"))
    b = joins.match_planes_to_truth(m, truth, ["capture"], 0.03, 0.5, 0.03)
    return rounded(b, 6, "scale", "shift", "rms", "worst", "measured_span", "truth_span")


@query("gap_ratio", f"WITH {LAY}, xs AS (SELECT capture, list_sort(list(x)) AS x FROM ly GROUP BY capture) SELECT capture, CASE WHEN len(x) >= 3 AND x[2] > x[1] THEN round((x[len(x)] - x[len(x) - 1]) / (x[2] - x[1]), 5) END AS ratio FROM xs")
def gap_ratio(t):
    ly = t.cloud().groupBy("capture", "camera").agg(F.avg("h").alias("x"))
    return rounded(joins.gap_ratio(ly, ["capture"], "x", "ratio"), 5, "ratio")


@query("plane_screen")
def plane_screen(t):
    p = t.boxes().select("capture", F.col("id").alias("plane_id"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.col("top").alias("d"), F.col("n_points").alias("n"))
    return rounded(planes.plane_screen(p, ["capture"], 0.1, None, 1.0, 0.0005).select("capture", "plane_id", "d"), 8, "d")
