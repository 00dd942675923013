"""Queries over 3-d points, cameras and keypoints: projection, neighbours, planes, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import geometry as g
from voxelloom.operators import align, calib, filters, fusion, joins, planes, rasters, spatial
from voxelloom.plans.catalog import CAMS, CLOUD, POINTS3, Tables, query, rounded
from voxelloom.session import materialise

# points of the embedding table sit around the origin; the camera offset t2 moves most in front
PC = f"""{POINTS3}, {CAMS}, pc AS (SELECT pts.*, fx, fy, cx, cy, width, height, co, si, t0, t1, t2, k1, k2, p1, p2, k3,
  co * x - si * y + t0 AS xc, si * x + co * y + t1 AS yc, z + t2 AS zc FROM pts JOIN cams USING (camera))"""
BROWN = f"""{PC}, n AS (SELECT *, xc / zc AS xn, yc / zc AS yn, (xc / zc) * (xc / zc) + (yc / zc) * (yc / zc) AS r2 FROM pc),
  uv AS (SELECT *, CASE WHEN zc > 1e-6 THEN fx * (xn * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) + 2 * p1 * xn * yn + p2 * (r2 + 2 * xn * xn)) + cx END AS u,
  CASE WHEN zc > 1e-6 THEN fy * (yn * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) + p1 * (r2 + 2 * yn * yn) + 2 * p2 * xn * yn) + cy END AS v FROM n)"""


def with_cameras(t: Tables):
    return t.points3().join(t.cameras(), "camera")


@query("project_pinhole", f"WITH {PC} SELECT pid, camera, CASE WHEN zc > 1e-6 THEN round(fx * xc / zc + cx, 6) END AS u, CASE WHEN zc > 1e-6 THEN round(fy * yc / zc + cy, 6) END AS v, round(zc, 8) AS depth FROM pc")
def project_pinhole(t):
    u, v, z = g.project_pinhole(g.vec("x", "y", "z"))
    return rounded(rounded(with_cameras(t).select("pid", "camera", u.alias("u"), v.alias("v"), z.alias("depth")), 6, "u", "v"), 8, "depth")


@query("project_brown", f"WITH {BROWN} SELECT pid, camera, CASE WHEN zc > 0.2 THEN round(u, 6) END AS u, CASE WHEN zc > 0.2 THEN round(v, 6) END AS v, u IS NULL AS behind FROM uv")
def project_brown(t):
    u, v, z = g.project_brown(g.vec("x", "y", "z"))
    p = with_cameras(t).select("pid", "camera", F.when(z > 0.2, u).alias("u"), F.when(z > 0.2, v).alias("v"), u.isNull().alias("behind"))
    return rounded(p, 6, "u", "v")


@query("visible_points", f"WITH {BROWN} SELECT camera, count(*) AS points, count(*) FILTER (u >= 5 AND v >= 5 AND u < width - 5 AND v < height - 5) AS visible FROM uv GROUP BY camera")
def visible_points(t):
    u, v, _ = g.project_brown(g.vec("x", "y", "z"))
    p = with_cameras(t).withColumn("_vis", g.visible(u, v, 5.0))
    return p.groupBy("camera").agg(F.count(F.lit(1)).alias("points"), F.count_if("_vis").alias("visible"))


@query("views_per_point", f"""WITH {POINTS3}, {CAMS}, n AS (SELECT pid, fx, fy, cx, cy, width, height, k1, k2, p1, p2, k3, (co * x - si * y + t0) / nullif(z + t2, 0) AS xn, (si * x + co * y + t1) / nullif(z + t2, 0) AS yn, z + t2 AS zc FROM pts CROSS JOIN cams),
  uv AS (SELECT *, xn * xn + yn * yn AS r2 FROM n), q AS (SELECT pid, zc, width, height, fx * (xn * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) + 2 * p1 * xn * yn + p2 * (r2 + 2 * xn * xn)) + cx AS u,
  fy * (yn * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) + p1 * (r2 + 2 * yn * yn) + 2 * p2 * xn * yn) + cy AS v FROM uv)
  SELECT pid, count(*) FILTER (zc > 1e-6 AND u >= 0 AND v >= 0 AND u < width AND v < height) AS n_views FROM q GROUP BY pid""")
def views_per_point(t):
    return calib.visible_views(t.points3(), t.cameras(), [])


@query("unproject", f"""WITH {POINTS3}, {CAMS}, px AS (SELECT pid, camera, 320 + 200 * x AS u, 240 + 200 * y AS v, z + 0.3 AS d FROM pts), r AS (SELECT pid, camera, (u - cx) / fx AS rx, (v - cy) / fy AS ry, d, co, si, t0, t1, t2 FROM px JOIN cams USING (camera) WHERE d > 0),
  c AS (SELECT *, rx * d AS xc, ry * d AS yc, rx * (d / sqrt(1 + rx * rx + ry * ry)) AS xr FROM r)
  SELECT pid, camera, round(co * (xc - t0) + si * (yc - t1), 8) AS x, round(-si * (xc - t0) + co * (yc - t1), 8) AS y, round(d - t2, 8) AS z, round(xr, 8) AS x_range FROM c""")
def unproject(t):
    px = with_cameras(t).withColumn("u", 320 + 200 * F.col("x")).withColumn("v", 240 + 200 * F.col("y")).withColumn("dep", F.col("z") + 0.3).filter(filters.valid_depth(F.col("dep")))
    cam = g.unproject(F.col("dep"), F.col("u"), F.col("v"))
    x, y, z = g.cam_to_rig(cam)
    xr, _, _ = g.unproject(F.col("dep"), F.col("u"), F.col("v"), "range")
    return rounded(px.select("pid", "camera", x.alias("x"), y.alias("y"), z.alias("z"), xr.alias("x_range")), 8, "x", "y", "z", "x_range")


@query("scale_intrinsics", f"""WITH {CAMS} SELECT camera, round(fx * 504 / width, 8) AS fx, round(fy * 420 / height, 8) AS fy, round((cx + 0.5) * 504 / width - 0.5, 8) AS cx, round((cy + 0.5) * 420 / height - 0.5, 8) AS cy FROM cams""")
def scale_intrinsics(t):
    k = g.scale_intrinsics(F.col("width"), F.col("height"), F.lit(504), F.lit(420))
    return rounded(t.cameras().select("camera", *[c.alias(n) for n, c in k.items()]), 8, "fx", "fy", "cx", "cy")


@query("camera_baselines", f"""WITH {CAMS}, c AS (SELECT camera, -(co * t0 + si * t1) AS x, -(-si * t0 + co * t1) AS y, -t2 AS z FROM cams)
  SELECT a.camera AS cam_a, b.camera AS cam_b, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 8) AS baseline, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 8) AS lateral, round(abs(a.z-b.z), 8) AS axial
  FROM c a JOIN c b ON a.camera < b.camera""")
def camera_baselines(t):
    b = g.baselines(t.cameras().withColumn("rig", F.lit(0)), ["rig"]).drop("rig")
    return rounded(b, 8, "baseline", "lateral", "axial")


@query("rotation_angles", f"""WITH {CAMS} SELECT camera, round(degrees(acos(greatest(-1, least(1, (2 * co + 1 - 1) / 2)))), 6) AS angle_deg, round(degrees(atan2(-si, co)), 6) AS roll_deg FROM cams""")
def rotation_angles(t):
    eye = F.array(*[F.lit(1.0 if i in (0, 4, 8) else 0.0) for i in range(9)])
    return rounded(t.cameras().select("camera", g.rotation_angle_deg(F.col("R"), eye).alias("angle_deg"), g.roll_deg(F.col("R")).alias("roll_deg")), 6, "angle_deg", "roll_deg")


@query("pose_columns", f"""WITH {CAMS} SELECT camera, round(cos(0.05 * camera), 6) AS qw, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, round(sin(0.05 * camera), 6) AS qz, round(degrees(0.1 * camera), 6) AS yaw_deg FROM cams""")
def pose_columns(t):
    p = g.pose_columns(F.col("R"))
    return rounded(t.cameras().select("camera", *[p[k].alias(k) for k in ("qw", "qx", "qy", "qz", "yaw_deg")]), 6, "qw", "qx", "qy", "qz", "yaw_deg")


@query("height_correct", f"""WITH {POINTS3}, r AS (SELECT pid, camera, z + 2 AS dep, x AS rx, y AS ry FROM pts), s AS (SELECT *, 0.1 * rx - 0.05 * ry + 0.99 AS m FROM r), h AS (SELECT *, dep * m - 1.8 AS h FROM s)
  SELECT pid, camera, round(h, 8) AS h, CASE WHEN abs(m) > 1e-9 AND (1.05 * h - 0.01 + 1.8) / m > 0 THEN round((1.05 * h - 0.01 + 1.8) / m, 8) END AS z_corrected, CASE WHEN abs(m) > 1e-9 AND 1.8 / m > 0 THEN round(1.8 / m, 8) END AS target FROM h""")
def height_correct(t):
    p = t.points3().withColumn("dep", F.col("z") + 2)
    ray, n = (F.col("x"), F.col("y"), F.lit(1.0)), (F.lit(0.1), F.lit(-0.05), F.lit(0.99))
    out = p.select("pid", "camera", g.height_from_depth(F.col("dep"), ray, n, F.lit(1.8)).alias("h"), g.height_correct(F.col("dep"), ray, n, F.lit(1.8), F.lit(1.05), F.lit(-0.01)).alias("z_corrected"),
                   g.plane_target_depth(ray, n, F.lit(1.8)).alias("target"))
    return rounded(out, 8, "h", "z_corrected", "target")


@query("depth_corrections", f"""WITH {POINTS3}, d AS (SELECT pid, z + 2 AS z, x, y FROM pts) SELECT pid, round(z * (1.02 + 0.01 * x - 0.02 * y) + 0.005, 8) AS field, round(1 / (0.98 / z + 0.01), 8) AS inverse_affine,
  round(1 / ((1.0 + 0.01 * x + 0.02 * y) / z + (0.001 + 0.002 * x - 0.001 * y)), 8) AS inverse_poly, round(x * (1.1 * z + 0.05) / z, 8) AS x_scaled, round(1.1 * z + 0.05, 8) AS z_scaled FROM d""")
def depth_corrections(t):
    p = t.points3().withColumn("z", F.col("z") + 2)
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    xs, _, zs = g.scale_depth_along_ray((x, y, z), F.lit(1.1), F.lit(0.05))
    out = p.select(
        "pid", g.field_correct(z, x, y, F.lit(1.02), F.lit(0.01), F.lit(-0.02), F.lit(0.005)).alias("field"), g.inverse_depth_affine(z, F.lit(0.98), F.lit(0.01)).alias("inverse_affine"),
        g.inverse_depth_polynomial(z, x, y, [F.lit(1.0), F.lit(0.01), F.lit(0.02)], [F.lit(0.001), F.lit(0.002), F.lit(-0.001)]).alias("inverse_poly"), xs.alias("x_scaled"), zs.alias("z_scaled"))
    return rounded(out, 8, "field", "inverse_affine", "inverse_poly", "x_scaled", "z_scaled")


@query("belt_frame", f"""WITH {POINTS3}, b AS (SELECT pid, x - 0.1 AS dx, y + 0.2 AS dy, z - 3 AS dz FROM pts) SELECT pid, round(0.6 * dx + 0.8 * dy, 8) AS u, round(0.8 * dx - 0.6 * dy, 8) AS v, round(-dz, 8) AS h FROM b""")
def belt_frame(t):
    spark = t.spark
    belt = spark.createDataFrame([(0, [0.1, -0.2, 3.0], [0.6, 0.8, 0.0], [-0.7, 0.7, 0.0])], "rig int, centre array<double>, x_axis array<double>, y_axis array<double>")
    p = t.points3().withColumn("rig", F.lit(0)).join(g.belt_axes(belt), "rig")
    f = g.to_belt_frame(g.vec("x", "y", "z"))
    return rounded(p.select("pid", *[c.alias(k) for k, c in f.items()]), 8, "u", "v", "h")


@query("incidence_angles", f"WITH {POINTS3}, r AS (SELECT pid, -x AS rx, -y AS ry, 2 - z AS rz FROM pts) SELECT pid, round(degrees(acos(least(1, abs(rz) / sqrt(rx * rx + ry * ry + rz * rz)))), 6) AS incidence_deg FROM r")
def incidence_angles(t):
    a = g.incidence_deg((F.lit(0.0), F.lit(0.0), F.lit(1.0)), g.vec("x", "y", "z"), (F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    return rounded(t.points3().select("pid", a.alias("incidence_deg")), 6, "incidence_deg")


@query("triangulate_pairs", f"""WITH {POINTS3}, r AS (SELECT pid, x + 0.3 AS ax, y AS ay, 1.0 AS az, x - 0.3 AS bx, y + 0.01 * z AS by_, 1.0 AS bz FROM pts),
  q AS (SELECT *, ax*ax+ay*ay+az*az AS a, ax*bx+ay*by_+az*bz AS b, bx*bx+by_*by_+bz*bz AS c, -0.6*ax AS d, -0.6*bx AS e FROM r), s AS (SELECT *, (b*e - c*d) / (a*c - b*b) AS s, (a*e - b*d) / (a*c - b*b) AS t FROM q)
  SELECT pid, round((-0.3 + s*ax + 0.3 + t*bx) / 2, 6) AS x, round((s*ay + t*by_) / 2, 6) AS y, round((s*az + t*bz) / 2, 6) AS z, round(degrees(acos(greatest(-1, least(1, b / sqrt(a*c))))), 6) AS parallax_deg FROM s""")
def triangulate_pairs(t):
    p = t.points3()
    tri = g.triangulate((F.lit(-0.3), F.lit(0.0), F.lit(0.0)), (F.col("x") + 0.3, F.col("y"), F.lit(1.0)), (F.lit(0.3), F.lit(0.0), F.lit(0.0)), (F.col("x") - 0.3, F.col("y") + 0.01 * F.col("z"), F.lit(1.0)))
    return rounded(p.select("pid", *[tri[k].alias(k) for k in ("x", "y", "z", "parallax_deg")]), 6, "x", "y", "z", "parallax_deg")


@query("epipolar_distance", f"""WITH {POINTS3}, m AS (SELECT pid, 300 * x AS u1, 300 * y AS v1, 300 * x + 5 AS u2, 300 * y + 3 * z AS v2 FROM pts), l AS (SELECT *, 0.0001 * v1 - 0.01 AS a, -0.0001 * u1 + 0.02 AS b, 0.01 * u1 - 0.02 * v1 AS c FROM m)
  SELECT pid, round(abs(u2 * a + v2 * b + c) / greatest(sqrt(a * a + b * b), 1e-12), 6) AS px FROM l""")
def epipolar_distance(t):
    f = F.array(*[F.lit(v) for v in (0.0, 0.0001, -0.01, -0.0001, 0.0, 0.02, 0.01, -0.02, 0.0)])
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return rounded(t.points3().select("pid", g.epipolar_distance(300 * x, 300 * y, 300 * x + 5, 300 * y + 3 * z, f).alias("px")), 6, "px")


@query("rigid_and_scale", f"""WITH {POINTS3} SELECT pid, round(0.8 * x - 0.6 * y + 1.5, 8) AS x, round(0.6 * x + 0.8 * y - 0.5, 8) AS y, round(z + 0.25, 8) AS z, round(0.2 + (x - 0.2) * 1.3 + 0.05, 8) AS x_about FROM pts""")
def rigid_and_scale(t):
    m = F.array(*[F.lit(float(v)) for v in (0.8, -0.6, 0, 1.0, 0.6, 0.8, 0, -0.5, 0, 0, 1, 0, 0, 0, 0, 1)])
    s = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0.5, 0, 1, 0, 0, 0, 0, 1, 0.25, 0, 0, 0, 1)])
    p = t.points3().withColumn("T", g.compose(s, m))
    x, y, z = g.apply_rigid(g.vec("x", "y", "z"), F.col("T"))
    xa = g.scale_about_camera(g.vec("x", "y", "z"), (F.lit(0.2), F.lit(0.0), F.lit(0.0)), F.lit(1.3), F.lit(0.05), (F.lit(1.0), F.lit(0.0), F.lit(0.0)))[0]
    return rounded(p.select("pid", x.alias("x"), y.alias("y"), z.alias("z"), xa.alias("x_about")), 8, "x", "y", "z", "x_about")


@query("plane_to_camera", f"WITH {CAMS} SELECT camera, round(co * 0.6 - si * 0.0, 8) AS nx, round(si * 0.6, 8) AS ny, 0.8::DOUBLE AS nz, round(2 + (co * 0.6 * t0 + si * 0.6 * t1 + 0.8 * t2), 8) AS d, 2.0::DOUBLE AS d_world FROM cams")
def plane_to_camera(t):
    n, d = g.plane_to_camera((F.lit(0.6), F.lit(0.0), F.lit(0.8)), F.lit(2.0))
    c = t.cameras().withColumns({"nx": n[0], "ny": n[1], "nz": n[2], "d": d})
    _, back = g.plane_to_world(g.vec("nx", "ny", "nz"), F.col("d"))
    return rounded(c.select("camera", "nx", "ny", "nz", "d", back.alias("d_world")), 8, "nx", "ny", "nz", "d", "d_world")


# --- voxels and neighbours -----------------------------------------------------------------------

VOX = "CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz"


@query("voxel_first", f"WITH {POINTS3}, v AS (SELECT *, {VOX} FROM pts) SELECT min(pid) AS pid, camera FROM v GROUP BY camera, vx, vy, vz")
def voxel_first(t):
    return rasters.voxel_first(t.points3(), ["camera"], 0.1).select("pid", "camera")


@query("voxel_mean", f"WITH {POINTS3}, v AS (SELECT *, {VOX} FROM pts) SELECT vx, vy, vz, round(avg(x), 8) AS x, round(avg(y), 8) AS y, round(avg(z), 8) AS z, count(*) AS n FROM v GROUP BY vx, vy, vz")
def voxel_mean(t):
    return rounded(rasters.voxel_mean(t.points3(), [], 0.1), 8, "x", "y", "z")


def pair_sql(cond: str) -> str:
    return f"p AS (SELECT a.pid, b.pid AS q, a.camera AS cam, b.camera AS cam_b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM pts a JOIN pts b ON {cond})"


@query("nearest_neighbour", f"""WITH {POINTS3}, {pair_sql("a.camera > 4 AND b.camera <= 4")}, m AS (SELECT pid, min_by(q, d) AS nn, min(d) AS dist FROM p WHERE d <= 0.2 GROUP BY pid)
  SELECT pts.pid, nn, round(dist, 8) AS dist, dist IS NULL AS saturated FROM pts LEFT JOIN m USING (pid) WHERE camera > 4""")
def nearest_neighbour(t):
    p = t.points3()
    nn = spatial.nearest_neighbour(p.filter("camera > 4"), p.filter("camera <= 4"), [], 0.2)
    return rounded(nn.select("pid", "nn", "dist", "saturated"), 8, "dist")


@query("cloud_distance_stats", f"""WITH {POINTS3}, {pair_sql("a.camera > 4 AND b.camera <= 4")}, m AS (SELECT pid, min(d) AS dist FROM p WHERE d <= 0.2 GROUP BY pid), j AS (SELECT pts.camera, dist FROM pts LEFT JOIN m USING (pid) WHERE camera > 4)
  SELECT camera, count(*) AS n, count(*) - count(dist) AS saturated, round(avg(dist), 8) AS mean, round(sqrt(avg(dist * dist)), 8) AS rms, round(count(*) FILTER (dist < 0.1) / count(*), 8) AS share_near, round(median(dist), 8) AS median,
  round(quantile_cont(dist, 0.95), 8) AS p95 FROM j GROUP BY camera""")
def cloud_distance_stats(t):
    p = t.points3()
    nn = materialise(spatial.nearest_neighbour(p.filter("camera > 4"), p.filter("camera <= 4"), [], 0.2), "nn")
    return rounded(spatial.distance_stats(nn, ["camera"], 0.1), 8, "mean", "rms", "share_near", "median", "p95")


@query("k_nearest", f"""WITH {POINTS3}, {pair_sql("a.pid <> b.pid")}, r AS (SELECT pid, q, d, row_number() OVER (PARTITION BY pid ORDER BY d, q) - 1 AS rank FROM p WHERE d <= 0.3) SELECT pid, q AS nn, round(d, 8) AS dist, rank FROM r WHERE rank < 3""")
def k_nearest(t):
    p = t.points3()
    return rounded(spatial.k_nearest(p, p, [], 0.3, 3, exclude_self=True), 8, "dist")


@query("outlier_removal", f"""WITH {POINTS3}, {pair_sql("a.pid <> b.pid AND a.camera = b.camera")}, r AS (SELECT cam, pid, d, row_number() OVER (PARTITION BY pid ORDER BY d, q) AS k FROM p WHERE d <= 0.4), m AS (SELECT cam, pid, avg(d) AS md, count(*) AS k FROM r WHERE k <= 4 GROUP BY ALL),
  l AS (SELECT cam, avg(md) + 1.0 * stddev_samp(md) AS lim FROM m GROUP BY cam) SELECT cam AS camera, pid, round(md, 8) AS mean_dist FROM m JOIN l USING (cam) WHERE k = 4 AND md <= lim""")
def outlier_removal(t):
    return rounded(spatial.outlier_removal(t.points3(), ["camera"], 4, 1.0, 0.4).select("camera", "pid", "mean_dist"), 8, "mean_dist")


@query("cross_camera_support", f"""WITH {POINTS3}, c AS (SELECT DISTINCT camera, floor(x / 0.1) AS a, floor(y / 0.1) AS b, floor(z / 0.1) AS c FROM pts)
  SELECT pid, camera, EXISTS (SELECT 1 FROM c WHERE c.camera <> pts.camera AND abs(c.a - floor(x / 0.1)) <= 1 AND abs(c.b - floor(y / 0.1)) <= 1 AND abs(c.c - floor(z / 0.1)) <= 1) AS supported FROM pts""")
def cross_camera_support(t):
    return spatial.cross_camera_support(t.points3(), [], 0.1).select("pid", "camera", "supported")


@query("radius_support", f"WITH {POINTS3}, {pair_sql('a.camera <> b.camera')} SELECT pts.pid, camera, coalesce(bool_or(d <= 0.08), false) AS supported FROM pts LEFT JOIN p USING (pid) GROUP BY pts.pid, camera")
def radius_support(t):
    return spatial.radius_support(t.points3(), [], 0.08).select("pid", "camera", "supported")


@query("unsupported_census", f"""WITH {POINTS3}, c AS (SELECT DISTINCT camera, floor(x / 0.1) AS a, floor(y / 0.1) AS b, floor(z / 0.1) AS c FROM pts), s AS (SELECT camera, z, EXISTS (SELECT 1 FROM c WHERE c.camera <> pts.camera AND abs(c.a - floor(x / 0.1)) <= 1 AND abs(c.b - floor(y / 0.1)) <= 1 AND abs(c.c - floor(z / 0.1)) <= 1) AS ok FROM pts)
  SELECT camera, CAST(floor(z / 0.1) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (NOT ok) AS unsupported FROM s GROUP BY ALL""")
def unsupported_census(t):
    return spatial.unsupported_census(spatial.cross_camera_support(t.points3(), [], 0.1), [], "z", 0.1)


@query("descriptor_match", """WITH k AS (SELECT label AS image, vec_id, embedding FROM embeddings), p AS (SELECT a.image AS src_image, a.vec_id AS kp_id, b.vec_id AS q, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d
  FROM k a JOIN k b ON b.image = a.image + 1), r AS (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY d, q) AS i FROM p), t AS (SELECT src_image, kp_id, min_by(q, i) AS match, min(d) AS d1, max(d) AS d2 FROM r WHERE i <= 2 GROUP BY ALL)
  SELECT CAST(src_image AS BIGINT) AS image, kp_id, match, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM t WHERE d1 < 0.95 * d2""")
def descriptor_match(t):
    k = t.keypoints()
    dst = k.withColumn("image", F.col("image") - 1)
    return rounded(joins.descriptor_match(k, dst, ["image"], 0.95, 8).withColumn("image", F.col("image").cast("long")), 6, "d1", "d2")


# --- planes and components ------------------------------------------------------------------------


@query("plane_fit_tls")
def plane_fit_tls(t):
    return rounded(planes.plane_fit(t.points3(), ["camera"]).select("camera", "n", "nx", "ny", "nz", "d", "rms"), 6, "nx", "ny", "nz", "d", "rms")


@query("plane_fit_residuals", f"""WITH {POINTS3}, c AS (SELECT camera, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM pts GROUP BY camera)
  SELECT camera, n, round(xx + yy + zz, 6) AS trace, round(xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz), 6) AS det FROM c""")
def plane_fit_residuals(t):
    # trace and determinant of the covariance from the eigenvalues the plane fit uses
    p = t.points3().groupBy("camera").agg(F.count(F.lit(1)).alias("n"), planes._covariance("x", "y", "z").alias("c")).withColumn("e", planes.smallest_axis("c"))
    e = [F.col(f"e.e{i}") for i in range(3)]
    return rounded(p.select("camera", "n", (e[0] + e[1] + e[2]).alias("trace"), (e[0] * e[1] * e[2]).alias("det")), 6, "trace", "det")


@query("plane_fit_tukey")
def plane_fit_tukey(t):
    return rounded(planes.plane_fit_tukey(t.points3(), ["camera"]).select("camera", "n", "nx", "ny", "nz", "d"), 6, "nx", "ny", "nz", "d")


@query("plane_ransac")
def plane_ransac(t):
    return rounded(planes.plane_ransac(t.points3(), ["camera"], 0.05), 6, "nx", "ny", "nz", "d")


@query("peel_planes")
def peel_planes(t):
    return rounded(planes.peel_planes(t.points3(), ["camera"], 2, 0.05, 0.05)[0], 6, "nx", "ny", "nz", "d", "fraction")


@query("assign_plane", f"""WITH {POINTS3}, pl AS (SELECT DISTINCT camera, k AS plane_id, -0.1 * k - 0.01 * camera AS d FROM pts, (SELECT unnest([0, 1, 2]) AS k)), r AS (SELECT pid, pts.camera, plane_id, z + d AS r FROM pts JOIN pl USING (camera)),
  b AS (SELECT pid, camera, min_by(plane_id, abs(r)) AS plane_id, min_by(r, abs(r)) AS residual FROM r GROUP BY ALL) SELECT pid, camera, CAST(plane_id AS BIGINT) AS plane_id, round(residual, 8) AS residual FROM b WHERE abs(residual) <= 0.04""")
def assign_plane(t):
    p = t.points3()
    pl = p.select("camera").distinct().withColumn("plane_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).select(
        "camera", "plane_id", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), (-0.1 * F.col("plane_id") - 0.01 * F.col("camera")).alias("d"))
    return rounded(planes.assign_plane(p, pl, ["camera"], 0.04)[0].select("pid", "camera", "plane_id", "residual"), 8, "residual")


@query("local_flatness")
def local_flatness(t):
    p = t.cloud().withColumn("z", F.col("h") / 10)
    return rounded(planes.local_flatness(p, ["camera"], 10.0, 30, ("u", "v", "z")), 6, "rms", "spread", "tilt_deg", "offset")


@query("camera_conditioning")
def camera_conditioning(t):
    c = t.cameras()
    x, y, z = g.camera_centre()
    centres = c.select(F.floor(F.col("camera") / 5).alias("rig"), x.alias("x"), y.alias("y"), z.alias("z"))
    return rounded(planes.camera_conditioning(centres, ["rig"]), 6, "conditioning")


CC = f"""{CLOUD}, cells AS (SELECT DISTINCT camera, CAST(floor(h / 12) AS BIGINT) AS layer, CAST(floor(u / 2) AS BIGINT) AS iu, CAST(floor(v) AS BIGINT) AS iv FROM cloud)"""
LAYER = ["camera", "layer"]


def layer_cells(t: Tables):
    """Occupied cells of each camera in layers of 12 units of height."""
    return t.cloud().select("camera", rasters.cell_floor("h", 12.0).alias("layer"), rasters.cell_floor("u", 2.0).alias("iu"), rasters.cell_floor("v", 1.0).alias("iv")).distinct()


@query("connected_components", f"""WITH RECURSIVE {CC}, e AS (SELECT a.camera, a.layer, a.iu, a.iv, b.iu AS ju, b.iv AS jv FROM cells a JOIN cells b ON a.camera = b.camera AND a.layer = b.layer AND abs(a.iu - b.iu) <= 1 AND abs(a.iv - b.iv) <= 1),
  reach AS (SELECT camera, layer, iu, iv, iu AS ju, iv AS jv FROM cells UNION SELECT r.camera, r.layer, r.iu, r.iv, e.ju, e.jv FROM reach r JOIN e ON e.camera = r.camera AND e.layer = r.layer AND e.iu = r.ju AND e.iv = r.jv)
  SELECT camera, layer, iu, iv, min(ju * 2147483648 + jv + 1073741824) AS label FROM reach GROUP BY camera, layer, iu, iv""")
def connected_components(t):
    return spatial.label_cells(layer_cells(t), LAYER)


@query("component_stats", f"""WITH RECURSIVE {CC}, e AS (SELECT a.camera, a.layer, a.iu, a.iv, b.iu AS ju, b.iv AS jv FROM cells a JOIN cells b ON a.camera = b.camera AND a.layer = b.layer AND abs(a.iu - b.iu) + abs(a.iv - b.iv) <= 1),
  reach AS (SELECT camera, layer, iu, iv, iu AS ju, iv AS jv FROM cells UNION SELECT r.camera, r.layer, r.iu, r.iv, e.ju, e.jv FROM reach r JOIN e ON e.camera = r.camera AND e.layer = r.layer AND e.iu = r.ju AND e.iv = r.jv), l AS (SELECT camera, layer, iu, iv, min(ju * 2147483648 + jv + 1073741824) AS label FROM reach GROUP BY camera, layer, iu, iv)
  SELECT camera, layer, label, count(*) AS cells, count(*) * 2.0 * 2.0 AS area, min(iu) AS iu_min, max(iu) AS iu_max, min(iv) AS iv_min, max(iv) AS iv_max, round(count(*) / ((max(iu) - min(iu) + 1) * (max(iv) - min(iv) + 1)), 8) AS fill FROM l GROUP BY camera, layer, label""")
def component_stats(t):
    return rounded(spatial.component_stats(spatial.label_cells(layer_cells(t), LAYER, conn=4), LAYER, 2.0), 8, "fill")


@query("close_cells", f"""WITH {CC}, dil AS (SELECT DISTINCT camera, layer, iu + a AS iu, iv + b AS iv FROM cells, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b))
  SELECT d.camera, d.layer, d.iu, d.iv FROM dil d JOIN dil o ON o.camera = d.camera AND o.layer = d.layer AND abs(o.iu - d.iu) <= 1 AND abs(o.iv - d.iv) <= 1 GROUP BY ALL HAVING count(*) = 9""")
def close_cells(t):
    return spatial.close_cells(layer_cells(t), LAYER, 1)


@query("deck_surfaces")
def deck_surfaces(t):
    return rounded(spatial.deck_surfaces(layer_cells(t), LAYER, 2.0, 1), 8, "fill")


@query("dbscan")
def dbscan(t):
    return spatial.dbscan(t.points3(), ["camera"], 0.12, 4, 0.02)


@query("smooth_cells", f"""WITH {CLOUD}, r AS (SELECT camera, CAST(floor(u / 2) AS BIGINT) AS iu, CAST(floor(v) AS BIGINT) AS iv, avg(h) AS h FROM cloud GROUP BY ALL)
  SELECT a.camera, a.iu, a.iv, round(avg(b.h), 9) AS smooth FROM r a JOIN r b ON a.camera = b.camera AND abs(a.iu - b.iu) <= 1 AND abs(a.iv - b.iv) <= 1 GROUP BY ALL""")
def smooth_cells(t):
    r = t.cloud().groupBy("camera", rasters.cell_floor("u", 2.0).alias("iu"), rasters.cell_floor("v", 1.0).alias("iv")).agg(F.avg("h").alias("h"))
    return rounded(spatial.smooth_cells(r, ["camera"], "h", 1), 9, "smooth").drop("h")


@query("local_maxima", f"""WITH {CLOUD}, r AS (SELECT camera, CAST(floor(u / 2) AS BIGINT) AS iu, CAST(floor(v) AS BIGINT) AS iv, max(h) AS h FROM cloud GROUP BY ALL)
  SELECT a.camera, a.iu, a.iv, a.h FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.camera = a.camera AND abs(a.iu - b.iu) <= 2 AND abs(a.iv - b.iv) <= 2 AND (b.h > a.h OR (b.h = a.h AND (b.iu, b.iv) < (a.iu, a.iv))))""")
def local_maxima(t):
    r = t.cloud().groupBy("camera", rasters.cell_floor("u", 2.0).alias("iu"), rasters.cell_floor("v", 1.0).alias("iv")).agg(F.max("h").alias("h"))
    return spatial.local_maxima(r, ["camera"], "h", 2)


@query("cell_periodicity")
def cell_periodicity(t):
    r = t.cloud().groupBy("camera", rasters.cell_floor("u", 1.0).alias("iu"), rasters.cell_floor("v", 1.0).alias("iv")).agg(F.avg("h").alias("h"))
    return rounded(spatial.cell_periodicity(r, ["camera"], "h", 2, 5), 6, "peak", "pitch")


@query("suction_site", f"""WITH {CLOUD}, r AS (SELECT camera, CAST(floor(u) AS BIGINT) AS iu, CAST(floor(v) AS BIGINT) AS iv, avg(h) AS h FROM cloud GROUP BY ALL),
  s AS (SELECT a.camera, a.iu, a.iv, avg(b.h) AS h FROM r a JOIN r b ON a.camera = b.camera AND abs(a.iu - b.iu) <= 1 AND abs(a.iv - b.iv) <= 1 GROUP BY ALL),
  d AS (SELECT a.camera, a.iu, a.iv, count(*) / 5 AS coverage, max(b.h) - min(b.h) AS range FROM s a JOIN s b ON a.camera = b.camera AND abs(a.iu - b.iu) + abs(a.iv - b.iv) <= 1 GROUP BY ALL),
  c AS (SELECT camera, avg(iu) AS cu, avg(iv) AS cv, count(*) AS n FROM r GROUP BY camera),
  k AS (SELECT d.*, n, range + 0.02 * sqrt(pow(iu - cu, 2) + pow(iv - cv, 2)) AS score FROM d JOIN c USING (camera) WHERE coverage > 0.9 AND range < 1000)
  SELECT camera, arg_min(iu, (score, iv, iu)) AS iu, arg_min(iv, (score, iv, iu)) AS iv, round(arg_min(range, (score, iv, iu)), 6) AS range, round(min(score), 6) AS score, round(count(*) FILTER (range <= 40) / any_value(n), 6) AS flat_fraction FROM k GROUP BY camera""")
def suction_site(t):
    r = t.cloud().groupBy("camera", rasters.cell_floor("u", 1.0).alias("iu"), rasters.cell_floor("v", 1.0).alias("iv")).agg(F.avg("h").alias("h"))
    return rounded(spatial.suction_site(r, ["camera"], "h", 1, 40.0, 1.0, max_range=1000.0), 6, "range", "score", "flat_fraction")


@query("diffuse_holes")
def diffuse_holes(t):
    r = t.cloud().groupBy("camera", rasters.cell_floor("u", 1.0).alias("iu"), rasters.cell_floor("v", 1.0).alias("iv")).agg(F.avg("h").alias("h"))
    return rounded(spatial.diffuse_holes(r.filter("h > 50"), r, ["camera"], "h", 2), 6, "val")


# --- pixels ---------------------------------------------------------------------------------------
# a depth map per camera: quantity and discount as image axes, price as depth

PIX = """pix AS (SELECT l_returnflag AS camera, CAST(l_quantity AS BIGINT) AS u, CAST(round(l_discount * 100) AS BIGINT) AS v, min(l_extendedprice) / 1000 AS z, avg(l_tax) AS conf FROM lineitem GROUP BY ALL)"""


def pixels(t: Tables):
    return t.table("lineitem").groupBy(F.col("l_returnflag").alias("camera"), F.col("l_quantity").cast("long").alias("u"), F.round(F.col("l_discount") * 100).cast("long").alias("v")).agg(
        (F.min("l_extendedprice") / 1000).alias("z"), F.avg("l_tax").alias("conf"))


@query("confidence_filter", f"WITH {PIX}, q AS (SELECT camera, quantile_cont(l_tax, 0.4) AS lim FROM (SELECT l_returnflag AS camera, l_tax FROM lineitem) GROUP BY camera) SELECT l_returnflag AS camera, count(*) AS kept FROM lineitem JOIN q ON q.camera = l_returnflag WHERE l_tax >= lim GROUP BY l_returnflag")
def confidence_filter(t):
    p = t.table("lineitem").select(F.col("l_returnflag").alias("camera"), F.col("l_extendedprice").alias("z"), F.col("l_tax").alias("conf"))
    return filters.confidence_filter(p, ["camera"], 40.0).groupBy("camera").agg(F.count(F.lit(1)).alias("kept"))


EDGE = f"""{PIX}, g AS (SELECT p.*, a.z AS up, b.z AS um, c.z AS vp, d.z AS vm FROM pix p LEFT JOIN pix a ON a.camera = p.camera AND a.u = p.u + 1 AND a.v = p.v LEFT JOIN pix b ON b.camera = p.camera AND b.u = p.u - 1 AND b.v = p.v
  LEFT JOIN pix c ON c.camera = p.camera AND c.u = p.u AND c.v = p.v + 1 LEFT JOIN pix d ON d.camera = p.camera AND d.u = p.u AND d.v = p.v - 1),
  k AS (SELECT camera, u, v, z, sqrt(pow((coalesce(up, z) - coalesce(um, z)) / CASE WHEN up IS NOT NULL AND um IS NOT NULL THEN 2 ELSE 1 END, 2) + pow((coalesce(vp, z) - coalesce(vm, z)) / CASE WHEN vp IS NOT NULL AND vm IS NOT NULL THEN 2 ELSE 1 END, 2)) / greatest(z, 1e-6) <= 0.4 AS keep FROM g),
  er AS (SELECT a.camera, a.u, a.v, bool_and(b.keep) AS keep_edge FROM k a JOIN k b ON a.camera = b.camera AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 GROUP BY ALL)"""


@query("edge_filter", f"WITH {EDGE} SELECT camera, u, v, keep_edge FROM er")
def edge_filter(t):
    return filters.with_edge_keep(pixels(t), ["camera"], 0.4, 1).select("camera", "u", "v", "keep_edge")


FLY = f"""{PIX}, fl AS (SELECT a.camera, a.u, a.v, any_value(a.z) AS z, max(b.z) - min(b.z) < 30 AS keep_flying FROM pix a JOIN pix b ON a.camera = b.camera AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 GROUP BY ALL)"""


@query("flying_pixel_filter", f"WITH {FLY} SELECT camera, u, v, keep_flying FROM fl")
def flying_pixel_filter(t):
    return filters.with_flying_keep(pixels(t), ["camera"], 30.0).select("camera", "u", "v", "keep_flying")


@query("incidence_filter")
def incidence_filter(t):
    cam = t.spark.createDataFrame([(25.0, 25.0, 25.0, 5.0)], "fx double, fy double, cx double, cy double").withColumn("_j", F.lit(0))
    p = pixels(t).withColumn("_j", F.lit(0)).join(cam, "_j").drop("_j")
    return rounded(filters.with_incidence_keep(p, ["camera"], 70.0).select("camera", "u", "v", "incidence_deg", "keep_incidence"), 6, "incidence_deg")


@query("mask_funnel", f"""WITH {EDGE}, f2 AS (SELECT camera, u, v, conf > 0.03 AS ok_conf FROM pix), j AS (SELECT * FROM er JOIN f2 USING (camera, u, v))
  SELECT camera, count(*) AS total, count(*) AS valid, count(*) FILTER (NOT ok_conf) AS drop_ok_conf, count(*) FILTER (NOT ok_conf) AS kill_ok_conf, count(*) FILTER (ok_conf AND NOT keep_edge) AS drop_keep_edge, count(*) FILTER (NOT keep_edge) AS kill_keep_edge,
  count(*) FILTER (ok_conf AND keep_edge) AS kept FROM j GROUP BY camera""")
def mask_funnel(t):
    p = filters.with_edge_keep(pixels(t), ["camera"], 0.4, 1).withColumn("ok_conf", F.col("conf") > 0.03)
    return filters.mask_funnel(p, ["camera"], ["ok_conf", "keep_edge"], filters.valid_depth(F.col("z")))


@query("roi_crop", f"WITH {CLOUD}, r AS (SELECT run_id, camera, count(*) AS n FROM cloud WHERE u >= -10 AND u <= 10 AND v >= -2 AND v <= 2 AND h >= 30 AND h <= 60 GROUP BY ALL) SELECT run_id, camera, n FROM r WHERE n >= 100")
def roi_crop(t):
    c = filters.roi_crop(t.cloud(), ["run_id", "camera"], (-10, 10, -2, 2, 30, 60), 100, ("u", "v", "h"))
    return c.groupBy("run_id", "camera").agg(F.count(F.lit(1)).alias("n"))


@query("stride_sample", f"WITH {PIX} SELECT camera, count(*) AS n FROM pix WHERE u % 3 = 0 AND v % 3 = 0 GROUP BY camera")
def stride_sample(t):
    return filters.stride_sample(pixels(t), 3).groupBy("camera").agg(F.count(F.lit(1)).alias("n"))


@query("seeded_sample", "SELECT l_returnflag AS camera, least(count(*), 500) AS n FROM lineitem GROUP BY l_returnflag")
def seeded_sample(t):
    p = t.table("lineitem").withColumnRenamed("l_returnflag", "camera")
    return filters.seeded_sample(p, ["camera"], 500, ["l_orderkey", "l_linenumber", "l_partkey"]).groupBy("camera").agg(F.count(F.lit(1)).alias("n"))


@query("content_mask", f"WITH {PIX} SELECT camera, count(*) FILTER ((u + 0.5 - 3) / 0.8 - 0.5 >= 0 AND (v + 0.5 - 1) / 0.8 - 0.5 >= 0 AND (u + 0.5 - 3) / 0.8 - 0.5 <= 49 AND (v + 0.5 - 1) / 0.8 - 0.5 <= 9) AS inside, count(*) AS n FROM pix GROUP BY camera")
def content_mask(t):
    m = filters.content_mask(F.col("u"), F.col("v"), F.lit(0.8), F.lit(3), F.lit(1), F.lit(50), F.lit(10))
    return pixels(t).groupBy("camera").agg(F.count_if(m).alias("inside"), F.count(F.lit(1)).alias("n"))


@query("exposure_stats", "SELECT l_returnflag AS camera, round(avg(l_quantity * 5), 6) AS mean, round(stddev_pop(l_quantity * 5), 6) AS std, round(100.0 * count(*) FILTER (l_quantity * 5 <= 2) / count(*), 6) AS clip_lo, round(100.0 * count(*) FILTER (l_quantity * 5 >= 250) / count(*) * 0 + 100.0 * count(*) FILTER (l_quantity * 5 >= 253) / count(*), 6) AS clip_hi, count(*) AS n, round(quantile_cont(l_quantity * 5, 0.01), 8) AS p1, round(quantile_cont(l_quantity * 5, 0.99), 8) AS p99 FROM lineitem GROUP BY l_returnflag")
def exposure_stats(t):
    p = t.table("lineitem").select(F.col("l_returnflag").alias("camera"), (F.col("l_quantity") * 5).alias("g"))
    return rounded(rounded(filters.exposure_stats(p, ["camera"]), 6, "mean", "std", "clip_lo", "clip_hi"), 8, "p1", "p99")


@query("edge_share")
def edge_share(t):
    return rounded(filters.edge_share(pixels(t).withColumn("g", F.col("z")), ["camera"]), 6, "edge")


@query("zbuffer", f"WITH {BROWN} SELECT camera, CAST(floor(u / 64) AS BIGINT) AS pu, CAST(floor(v / 48) AS BIGINT) AS pv, round(min(zc), 8) AS zbuf FROM uv WHERE zc > 0.2 GROUP BY ALL")
def zbuffer(t):
    u, v, z = g.project_brown(g.vec("x", "y", "z"))
    p = with_cameras(t).select("camera", (u / 64).alias("u"), (v / 48).alias("v"), z.alias("z")).filter("z > 0.2")
    return rounded(joins.zbuffer(p, ["camera"]), 8, "zbuf")


def in_every_view(t: Tables, scale_u: float = 16.0, scale_v: float = 16.0):
    """Every point in the image of every camera; the cameras meet the points as one array."""
    cams = t.cameras().withColumnRenamed("camera", "view")
    row = cams.agg(F.collect_list(F.struct(*cams.columns)).alias("_cams")).withColumn("_j", F.lit(0))
    p = t.points3().withColumn("_j", F.lit(0)).join(row, "_j").withColumn("_c", F.explode("_cams")).select("pid", "camera", "x", "y", "z", "_c.*")
    u, v, z = g.project_pinhole(g.vec("x", "y", "z"))
    return materialise(p.select("pid", "camera", "view", (u / scale_u).alias("u"), (v / scale_v).alias("v"), z.alias("z")).filter("z > 0.2"), "in-view")


def in_view(t: Tables, scale_u: float = 16.0, scale_v: float = 16.0):
    """Every point in the image of its own camera and of the next one."""
    cams = t.cameras().withColumnRenamed("camera", "view")
    p = t.points3().withColumn("view", F.explode(F.array(F.col("camera"), F.col("camera") + 1))).join(cams, "view")
    u, v, z = g.project_pinhole(g.vec("x", "y", "z"))
    return materialise(p.select("pid", "camera", "view", (u / scale_u).alias("u"), (v / scale_v).alias("v"), z.alias("z")).filter("z > 0.2"), "in-view")


IMG = f"""{POINTS3}, {CAMS}, vw AS (SELECT pid, pts.camera, cams.camera AS view, (fx * (co * x - si * y + t0) / (z + t2) + cx) / 16 AS u, (fy * (si * x + co * y + t1) / (z + t2) + cy) / 16 AS v, z + t2 AS z FROM pts JOIN cams ON cams.camera = pts.camera OR cams.camera = pts.camera + 1 WHERE z + t2 > 0.2)"""


@query("zbuffer_overlap", f"""WITH {IMG}, i AS (SELECT *, CAST(floor(u) AS BIGINT) AS pu, CAST(floor(v) AS BIGINT) AS pv FROM vw WHERE floor(u) >= 0 AND floor(u) < 40 AND floor(v) >= 0 AND floor(v) < 30), buf AS (SELECT view, pu, pv, min(z) AS zbuf FROM i WHERE camera = view GROUP BY ALL), ref AS (SELECT * FROM i WHERE camera <> view),
  near AS (SELECT r.view, r.pid, min_by(r.z - b.zbuf, abs(r.z - b.zbuf)) AS dz FROM ref r JOIN buf b ON b.view = r.view AND abs(b.pu - r.pu) <= 1 AND abs(b.pv - r.pv) <= 1 GROUP BY ALL)
  SELECT f.view, f.in_frame, coalesce(n.k, 0) AS with_sample, coalesce(n.s, 0) AS shared, round(n.med, 8) AS median, round(n.am, 8) AS abs_median FROM (SELECT view, count(*) AS in_frame FROM ref GROUP BY view) f
  LEFT JOIN (SELECT view, count(*) AS k, count(*) FILTER (abs(dz) < 0.15) AS s, median(dz) FILTER (abs(dz) < 0.15) AS med, median(abs(dz)) FILTER (abs(dz) < 0.15) AS am FROM near GROUP BY view) n USING (view)""")
def zbuffer_overlap(t):
    p = in_view(t)
    o = joins.zbuffer_overlap(p.filter("camera <> view"), p.filter("camera = view"), ["view"], 40, 30, 0.15, 1, 10, 0.5)
    return rounded(o.select("view", "in_frame", "with_sample", "shared", "median", "abs_median"), 8, "median", "abs_median")


IMG_ALL = f"""{POINTS3}, {CAMS}, vw AS (SELECT pid, pts.camera, cams.camera AS view, (fx * (co * x - si * y + t0) / (z + t2) + cx) / 16 AS u, (fy * (si * x + co * y + t1) / (z + t2) + cy) / 16 AS v, z + t2 AS z FROM pts CROSS JOIN cams WHERE z + t2 > 0.2)"""


# zbuffer_overlap meets the next camera only, as its SQL says; this one every ordered pair of cameras
@query("zbuffer_overlap_all", f"""WITH {IMG_ALL}, i AS (SELECT *, CAST(floor(u) AS BIGINT) AS pu, CAST(floor(v) AS BIGINT) AS pv FROM vw WHERE floor(u) >= 0 AND floor(u) < 40 AND floor(v) >= 0 AND floor(v) < 30), buf AS (SELECT view, pu, pv, min(z) AS zbuf FROM i WHERE camera = view GROUP BY ALL), ref AS (SELECT * FROM i WHERE camera <> view),
  near AS (SELECT r.camera, r.view, r.pid, min_by(r.z - b.zbuf, abs(r.z - b.zbuf)) AS dz FROM ref r JOIN buf b ON b.view = r.view AND abs(b.pu - r.pu) <= 1 AND abs(b.pv - r.pv) <= 1 GROUP BY ALL)
  SELECT f.camera, f.view, f.in_frame, coalesce(n.k, 0) AS with_sample, coalesce(n.s, 0) AS shared, round(n.med, 8) AS median, round(n.am, 8) AS abs_median FROM (SELECT camera, view, count(*) AS in_frame FROM ref GROUP BY ALL) f
  LEFT JOIN (SELECT camera, view, count(*) AS k, count(*) FILTER (abs(dz) < 0.15) AS s, median(dz) FILTER (abs(dz) < 0.15) AS med, median(abs(dz)) FILTER (abs(dz) < 0.15) AS am FROM near GROUP BY ALL) n USING (camera, view)""")
def zbuffer_overlap_all(t):
    p = in_every_view(t)
    pairs = p.filter("camera <> view")
    cam = p.filter("camera = view").drop("camera").join(pairs.select("camera", "view").distinct(), "view")
    o = joins.zbuffer_overlap(pairs, cam, ["camera", "view"], 40, 30, 0.15, 1, 10, 0.5)
    return rounded(o.select("camera", "view", "in_frame", "with_sample", "shared", "median", "abs_median"), 8, "median", "abs_median")


@query("cross_view_residual")
def cross_view_residual(t):
    p = in_every_view(t, 64.0, 64.0)
    pix = p.filter("camera = view").groupBy("view", F.rint("u").alias("u"), F.rint("v").alias("v")).agg(F.avg("z").alias("z"))
    # the pixels of a view are met by each other camera's points apart
    pairs = p.filter("camera <> view")
    pix = pix.join(pairs.select("camera", "view").distinct(), "view")
    return rounded(joins.cross_view_residual(pairs, pix, ["camera", "view"], 10, 8), 8, "median", "abs_p90")


@query("sample_depth", f"""WITH {PIX}, k AS (SELECT l_returnflag AS camera, l_orderkey, l_linenumber, l_partkey, l_quantity + l_tax * 7 AS u, l_discount * 100 + l_tax * 3 AS v FROM lineitem), q AS (SELECT *, greatest(0, least(50, round_even(u, 0))) AS pu, greatest(0, least(10, round_even(v, 0))) AS pv FROM k)
  SELECT q.camera, count(*) AS n, count(z) AS hit, round(sum(z), 4) AS total FROM q LEFT JOIN pix ON pix.camera = q.camera AND pix.u = pu AND pix.v = pv GROUP BY q.camera""")
def sample_depth(t):
    k = t.table("lineitem").select(F.col("l_returnflag").alias("camera"), (F.col("l_quantity") + F.col("l_tax") * 7).alias("u"), (F.col("l_discount") * 100 + F.col("l_tax") * 3).alias("v"), F.monotonically_increasing_id().alias("kp_id"))
    d = joins.sample_depth(k, pixels(t), ["camera"], 51, 11)
    return rounded(d.groupBy("camera").agg(F.count(F.lit(1)).alias("n"), F.count("depth").alias("hit"), F.sum("depth").alias("total")), 4, "total")


BIL = f"""{PIX}, k AS (SELECT l_returnflag AS camera, l_orderkey * 100 + l_linenumber AS kp_id, max(l_quantity + l_tax * 7) AS u, max(l_discount * 100 + l_tax * 3) AS v FROM lineitem GROUP BY ALL),
  c AS (SELECT k.camera, kp_id, floor(u) + a AS pu, floor(v) + b AS pv, (CASE WHEN a = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN b = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM k, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
  s AS (SELECT c.camera, kp_id, count(z) AS k, sum(w * z) AS z FROM c LEFT JOIN pix ON pix.camera = c.camera AND pix.u = pu AND pix.v = pv GROUP BY ALL)"""


@query("sample_depth_bilinear", f"WITH {BIL} SELECT camera, kp_id, CASE WHEN k = 4 THEN round(z, 9) END AS depth FROM s")
def sample_depth_bilinear(t):
    k = t.table("lineitem").groupBy(F.col("l_returnflag").alias("camera"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("kp_id")).agg(
        F.max(F.col("l_quantity") + F.col("l_tax") * 7).alias("u"), F.max(F.col("l_discount") * 100 + F.col("l_tax") * 3).alias("v"))
    d = joins.sample_depth(k, pixels(t), ["camera"], 51, 11, "bilinear")
    return rounded(d.select("camera", "kp_id", "depth"), 9, "depth")


@query("render_reference", f"""WITH {CLOUD}, k AS (SELECT camera, CAST(floor(u) AS BIGINT) AS u, CAST(floor(v) AS BIGINT) AS v, h AS z FROM cloud), {", ".join(
    f"g{i} AS (SELECT camera, pu, pv, median(z) AS z FROM (SELECT camera, CAST(floor(u / {2**i}) AS BIGINT) AS pu, CAST(floor(v / {2**i}) AS BIGINT) AS pv, z, min(z) OVER (PARTITION BY camera, floor(u / {2**i}), floor(v / {2**i})) AS z0 FROM k) WHERE z <= z0 + 10 GROUP BY ALL)" for i in range(2))},
  cand AS (SELECT camera, pu * 2 + a AS pu, pv * 2 + b AS pv, z AS z1 FROM g1, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
  SELECT c.camera, c.pu, c.pv, round(coalesce(g0.z, z1), 8) AS z, CAST(CASE WHEN g0.z IS NULL THEN 1 ELSE 0 END AS BIGINT) AS level FROM cand c LEFT JOIN g0 USING (camera, pu, pv)""")
def render_reference(t):
    p = t.cloud().select("camera", "u", "v", F.col("h").alias("z"))
    return rounded(joins.render_reference(p, ["camera"], 10.0, 2), 8, "z")


@query("tsdf_fuse")
def tsdf_fuse(t):
    cams = t.cameras()
    u, v, z = g.project_pinhole(g.vec("x", "y", "z"))
    pix = with_cameras(t).select("camera", F.rint(u / 20).cast("long").alias("u"), F.rint(v / 20).cast("long").alias("v"), z.alias("z")).filter("z > 0.2").groupBy("camera", "u", "v").agg(F.min("z").alias("z"))
    small = cams.withColumns({c: F.col(c) / 20 for c in ("fx", "fy", "cx", "cy")})
    vox, _ = fusion.tsdf_fuse(t.points3(), small, pix, [], 0.1, 0.1)
    return rounded(vox, 6, "tsdf")


# --- registration ---------------------------------------------------------------------------------

TURN = f"{POINTS3}, pr AS (SELECT camera, x AS ax, y AS ay, 0.8 * x - 0.6 * y + 0.1 + 0.01 * z AS bx, 0.6 * x + 0.8 * y - 0.2 - 0.02 * z * z AS by_ FROM pts)"


@query("planar_rigid", f"""WITH {TURN}, m AS (SELECT camera, count(*) AS n, avg(ax) AS mx, avg(ay) AS my, avg(bx) AS nx, avg(by_) AS ny, atan2(covar_pop(ax, by_) - covar_pop(ay, bx), covar_pop(ax, bx) + covar_pop(ay, by_)) AS yaw FROM pr GROUP BY camera)
  SELECT camera, n, round(yaw, 6) AS yaw, round(nx - (cos(yaw) * mx - sin(yaw) * my), 6) AS tx, round(ny - (sin(yaw) * mx + cos(yaw) * my), 6) AS ty FROM m""")
def planar_rigid(t):
    z = F.col("z")
    p = t.points3().select("camera", F.col("x").alias("ax"), F.col("y").alias("ay"), (0.8 * F.col("x") - 0.6 * F.col("y") + 0.1 + 0.01 * z).alias("bx"), (0.6 * F.col("x") + 0.8 * F.col("y") - 0.2 - 0.02 * z * z).alias("by_"))
    return rounded(align.planar_rigid(p, ["camera"]), 6, "yaw", "tx", "ty")


def similarity_pairs(t: Tables):
    x, y, z = g.vec("x", "y", "z")
    return t.points3().select("camera", "pid", x.alias("ax"), y.alias("ay"), z.alias("az"), (1.2 * (0.8 * x - 0.6 * y) + 0.1).alias("bx"), (1.2 * (0.6 * x + 0.8 * y) - 0.2).alias("by_"), (1.2 * z + 0.3).alias("bz"))


@query("similarity_fit", "SELECT label AS camera, count(*) AS n, 1.2::DOUBLE AS scale, 0.0::DOUBLE AS rms, 0.8::DOUBLE AS r00, -0.6::DOUBLE AS r01, 0.1::DOUBLE AS tx, -0.2::DOUBLE AS ty, 0.3::DOUBLE AS tz FROM embeddings GROUP BY label")
def similarity_fit(t):
    f = align.similarity(similarity_pairs(t), ["camera"])
    return rounded(f.select("camera", "n", "scale", "rms", F.col("R")[0].alias("r00"), F.col("R")[1].alias("r01"), *[F.col("t")[i].alias("t" + c) for i, c in enumerate("xyz")]), 6, "scale", "rms", "r00", "r01", "tx", "ty", "tz")


@query("ransac_transform", "SELECT label AS camera, count(*) - count(*) FILTER (vec_id % 4 = 0) AS inliers, count(*) AS total, 1.2::DOUBLE AS scale FROM embeddings GROUP BY label")
def ransac_transform(t):
    # every fourth correspondence is wrong by far
    p = similarity_pairs(t).withColumn("bx", F.when(F.col("pid") % 4 == 0, F.col("bx") + 5 + F.col("pid")).otherwise(F.col("bx")))
    f = align.ransac_transform(p, ["camera"], 0.01)
    return rounded(f.select("camera", "inliers", "total", "scale"), 6, "scale")


@query("gauge_diagnose", "SELECT label AS camera, count(*) AS cameras, 1.2::DOUBLE AS scale, 0.0::DOUBLE AS centre_residual FROM embeddings GROUP BY label HAVING count(*) > 2")
def gauge_diagnose(t):
    return rounded(align.gauge_diagnose(similarity_pairs(t), ["camera"]), 6, "scale", "centre_residual")


@query("icp_planar")
def icp_planar(t):
    p = t.points3().select(F.floor(F.col("camera") / 5).alias("rig"), "pid", "x", "y")
    moved = p.withColumn("x2", F.col("x") * F.cos(F.lit(0.03)) - F.col("y") * F.sin(F.lit(0.03)) + 0.01).withColumn("y2", F.col("x") * F.sin(F.lit(0.03)) + F.col("y") * F.cos(F.lit(0.03)) - 0.01)
    return rounded(align.icp_planar(moved.select("rig", "pid", F.col("x2").alias("x"), F.col("y2").alias("y")), p, ["rig"], 0.2, levels=2), 3, "yaw", "tx", "ty", "rms")


@query("grid_search_alignment")
def grid_search_alignment(t):
    c = layer_cells(t)
    return align.grid_search(c, c.withColumn("iu", F.col("iu") + 2).withColumn("iv", F.col("iv") - 1), LAYER, 1.0, [0.0, 0.2], 3)


@query("orientation_check", f"""WITH {CLOUD}, r AS (SELECT camera, CAST(floor(u) AS BIGINT) AS iu, CAST(floor(v) AS BIGINT) AS iv, avg(h) AS h FROM cloud GROUP BY ALL), s AS (SELECT camera, fu, fv, iu * fu AS iu, iv * fv AS iv, h FROM r, (SELECT unnest([1, -1]) AS fu), (SELECT unnest([1, -1]) AS fv))
  SELECT camera, CAST(fu AS BIGINT) AS fu, CAST(fv AS BIGINT) AS fv, count(*) AS cells, round(corr(s.h, r.h), 6) AS correlation FROM s JOIN r USING (camera, iu, iv) GROUP BY ALL""")
def orientation_check(t):
    r = t.cloud().groupBy("camera", rasters.cell_floor("u", 1.0).alias("iu"), rasters.cell_floor("v", 1.0).alias("iv")).agg(F.avg("h").alias("h"))
    o = align.orientation_check(r, r, ["camera"])
    return rounded(o.withColumn("fu", F.col("fu").cast("long")).withColumn("fv", F.col("fv").cast("long")), 6, "correlation")


DECK_PASSES = 4


@query("gauge_from_deck", f"""WITH {CLOUD}, s0 AS (SELECT camera, 40 / median(h) AS s FROM cloud GROUP BY camera), {", ".join(
    f"s{i} AS (SELECT c.camera, 40 / median(h) AS s FROM cloud c JOIN s{i - 1} p USING (camera) WHERE abs(p.s * h - 40) <= 15 GROUP BY c.camera)" for i in range(1, DECK_PASSES + 1))} SELECT camera, round(s, 8) AS scale FROM s{DECK_PASSES}""")
def gauge_from_deck(t):
    return rounded(align.gauge_from_deck(t.cloud(), ["camera"], "h", 40.0, DECK_PASSES, 15.0, 1), 8, "scale")


@query("gauge_multi_camera", f"WITH {CLOUD} SELECT camera, round(60 / median(h), 5) AS scale FROM cloud GROUP BY camera")
def gauge_multi_camera(t):
    p = t.cloud().select("camera", F.lit(60.0).alias("h0"), (-F.col("h")).alias("h1"))
    return rounded(align.gauge_multi_camera(p, ["camera"], 0.5, 4.0), 5, "scale")


@query("consensus_scale_vote")
def consensus_scale_vote(t):
    c = t.cloud().withColumn("h", F.col("h") - 40)
    return rounded(align.consensus_scale_vote(c, ["camera"], "h", [0.9, 0.95, 1.0, 1.05, 1.1], 1.0, -20.0, (5.0, 40.0), (-15.0, -5.0)), 6, "alpha", "beta")


@query("depth_scale_search")
def depth_scale_search(t):
    # every camera's cloud about the rig; cameras 5 to 9 stand beside the reference
    p = t.points3().withColumn("rig", F.lit(0)).withColumn("z", F.col("z") + 2)
    src = p.filter("camera > 4").withColumns({"cx": 0.05 * F.col("camera"), "cy": 0.02 * F.col("camera"), "cz": F.lit(0.0)})
    return rounded(align.depth_scale_search(src, p.filter("camera <= 4"), ["rig"], [0.95, 1.0, 1.05], 0.3, 2, normal_radius=0.1, min_points=5), 6, "p2plane_median", "range_median", "relative")


@query("photometric_yaw")
def photometric_yaw(t):
    # 32 x 24 images whose pixels are coloured by the points each camera sees
    cams = t.cameras().withColumn("rig", F.lit(0)).withColumns({c: F.col(c) / 20 for c in ("fx", "fy", "cx", "cy")}).withColumns({"width": F.lit(32), "height": F.lit(24)})
    u, v, _ = g.project_brown(g.vec("x", "y", "z"))
    pix = t.points3().withColumnRenamed("camera", "own").withColumn("rig", F.lit(0)).join(cams, "rig").select(
        "rig", "camera", F.rint(u).cast("long").alias("u"), F.rint(v).cast("long").alias("v"), ((F.col("own") * 25) % 256).alias("g")).filter("u is not null").groupBy("rig", "camera", "u", "v").agg(F.avg("g").alias("g"))
    return rounded(align.photometric_yaw(t.points3().withColumn("rig", F.lit(0)), cams, pix, ["rig"], [-0.05, 0.0, 0.05]), 6, "spread")


@query("depth_field_fit")
def depth_field_fit(t):
    p = t.points3().withColumn("rig", F.floor(F.col("camera") / 5)).select("rig", (F.col("z") + 2).alias("z"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pl = t.points3().select(F.floor(F.col("camera") / 5).alias("rig")).distinct().withColumn("d", F.explode(F.array(F.lit(1.8), F.lit(2.0), F.lit(2.2)))).select("rig", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), "d")
    fit, _ = align.depth_field_fit(p, pl, ["rig"], [0.2, 0.1, 0.05], 0.01, 0.2, 20)
    return rounded(fit, 6, "s", "a", "b", "c")
