"""Queries that align cameras with each other and with a reference, frame by frame and as whole clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.operators import camera_bias, depth_field, grades, guided, recovery, search
from voxelloom.operators.two_planes import two_plane_proposals
from voxelloom.plans.catalog import CLOUD, PLACEMENTS, Tables, query, rounded
from voxelloom.plans.clouds import irls_sql
from voxelloom.session import materialise, scratch_path
from voxelloom.streaming import alignment, windows

# Pixels of three cameras that see a deck at 2 and tops at about 2.3 from the rig, from line items: a frame is a rig's
# month. Cameras 1 and 2 measure (z - b) / a with a millimetre of noise; some of their pixels are off by 60 mm.
PIXELS = """px AS (SELECT l_linestatus AS rig, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS seq, l_linenumber % 3 AS k,
  l_orderkey * 8 + l_linenumber AS pid, (l_quantity - 25.5) / 50 AS rx, (round(l_discount * 100) - 5) / 20 AS ry, l_partkey % 3 = 0 AS top, l_suppkey % 17 = 0 AS odd, CAST(round(l_extendedprice * 100) AS BIGINT) AS e FROM lineitem),
  pixels AS (SELECT rig, ts, seq, 'c' || k AS camera, pid, rx, ry, CASE WHEN k = 0 THEN CASE WHEN odd THEN 2.8::DOUBLE WHEN top THEN 2.3::DOUBLE + (e % 401 - 200) / 10000 ELSE 2.0::DOUBLE END
    ELSE ((CASE WHEN top THEN 2.3::DOUBLE ELSE 2.0::DOUBLE END) + 0.05::DOUBLE * k - (0.01::DOUBLE * k + 0.002::DOUBLE * (seq % 5))) / (1 + 0.004::DOUBLE * k + 0.001::DOUBLE * (seq % 7)) + (e % 201 - 100) / 100000 + CASE WHEN odd THEN 0.06::DOUBLE ELSE 0::DOUBLE END END AS z FROM px)"""
SMALL = {"min_points": 25, "upper_min_points": 6, "min_plane_points": 6}  # a frame of these tables has few pixels


def pixels(rows):
    """Pixels of line items, from a table or a stream of them."""
    k, seq, e = F.col("k"), F.col("seq"), F.col("e")
    d, month = F.lit, F.date_trunc("month", "l_shipdate")
    px = rows.select(
        F.col("l_linestatus").alias("rig"), month.cast("timestamp").alias("ts"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("seq"), (F.col("l_linenumber") % 3).cast("int").alias("k"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"), ((F.col("l_quantity") - 25.5) / 50).cast("double").alias("rx"), ((F.round(F.col("l_discount") * 100) - 5) / 20).cast("double").alias("ry"),
        (F.col("l_partkey") % 3 == 0).alias("top"), (F.col("l_suppkey") % 17 == 0).alias("odd"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("e"))
    near = F.when(F.col("odd"), 2.8).when(F.col("top"), d(2.3) + (e % 401 - 200) / 10000).otherwise(2.0)
    far = (F.when(F.col("top"), 2.3).otherwise(2.0) + 0.05 * k - (0.01 * k + 0.002 * (seq % 5))) / (1 + 0.004 * k + 0.001 * (seq % 7)) + (e % 201 - 100) / 100000 + F.when(F.col("odd"), 0.06).otherwise(0.0)
    return px.select("rig", "ts", "seq", F.concat(F.lit("c"), k.cast("string")).alias("camera"), "pid", "rx", "ry", F.when(k == 0, near).otherwise(far).alias("z"))


def cameras(t: Tables):
    """Three cameras without rotation, a little apart."""
    z, o, k = F.lit(0.0), F.lit(1.0), F.col("k").cast("double")
    return t.table("lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("k")).distinct().select(
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("camera"), F.array(o, z, z, z, o, z, z, z, o).alias("R"), F.array(0.1 * k, z, 0.05 * k).alias("t"))


def _line_steps(name: str, rows: str, keys: str, iters: int, k: float) -> str:
    """SQL of a Huber line zt = a z + b in ``iters`` solves; weights multiply rows, so their squares are summed."""
    steps = [f"{name}0 AS (SELECT *, 1.0::DOUBLE AS w FROM {rows})"]
    for i in range(iters):
        steps.append(f"""{name}s{i} AS (SELECT {keys}, sum(w*w*z*z) AS szz, sum(w*w*z) AS sz, sum(w*w) AS s1, sum(w*w*z*zt) AS szt, sum(w*w*zt) AS st FROM {name}{i} GROUP BY ALL),
  {name}c{i} AS (SELECT {keys}, (s1*szt - sz*st) / (s1*szz - sz*sz) AS a, (szz*st - sz*szt) / (s1*szz - sz*sz) AS b FROM {name}s{i}),
  {name}r{i} AS (SELECT x.* EXCLUDE w, zt - (a*z + b) AS r FROM {name}{i} x JOIN {name}c{i} USING ({keys})),
  {name}m{i} AS (SELECT {keys}, median(r) AS m FROM {name}r{i} GROUP BY ALL), {name}d{i} AS (SELECT {keys}, 1.4826 * median(abs(r - m)) AS s FROM {name}r{i} JOIN {name}m{i} USING ({keys}) GROUP BY ALL),
  {name}{i + 1} AS (SELECT x.* EXCLUDE r, CASE WHEN abs(r) <= {k} * s THEN 1.0 ELSE {k} * s / abs(r) END AS w FROM {name}r{i} x JOIN {name}d{i} USING ({keys}))""")
    return ", ".join(steps)


# The deck is z = 2 exactly, so a plane fit finds n = (0, 0, 1); heights, peaks, samples and lines are computed.
PROPOSALS = f"""{PIXELS}, frames AS (SELECT DISTINCT rig, ts, seq FROM pixels),
  ref AS (SELECT rig, seq, z - 2 AS h FROM pixels WHERE camera = 'c0'), nref AS (SELECT rig, seq, count(*) AS n_ref, count(*) FILTER (abs(h) <= 0.01) AS inliers FROM ref GROUP BY ALL),
  deck AS (SELECT rig, seq, inliers FROM nref WHERE n_ref >= 25 AND inliers >= 6),
  hh AS (SELECT rig, seq, h FROM ref JOIN deck USING (rig, seq) WHERE h BETWEEN 0.04 AND 0.6),
  sp AS (SELECT rig, seq, min(h) AS lo, max(h) AS hi, count(*) AS n_band, greatest(8, CAST(floor((max(h) - min(h)) / 0.005) AS INT)) AS bins FROM hh GROUP BY ALL HAVING count(*) >= 6 AND max(h) > min(h)),
  bn AS (SELECT rig, seq, least(CAST(floor((h - lo) / (hi - lo) * bins) AS INT), bins - 1) AS bin FROM hh JOIN sp USING (rig, seq)),
  sm AS (SELECT rig, seq, bin + o AS bin, count(*) AS n FROM bn, (SELECT unnest([-1, 0, 1]) AS o) GROUP BY ALL),
  bs AS (SELECT rig, seq, lo + (bin + 0.5) * (hi - lo) / bins AS peak FROM sm JOIN sp USING (rig, seq) WHERE bin >= 0 AND bin < bins QUALIFY row_number() OVER (PARTITION BY rig, seq ORDER BY n DESC, bin) = 1),
  up AS (SELECT rig, seq, peak FROM hh JOIN bs USING (rig, seq) GROUP BY ALL HAVING count(*) FILTER (abs(h - peak) <= 0.02) >= 3 AND peak >= 0.08),
  pl AS (SELECT rig, seq, 0 AS plane, 2.0::DOUBLE AS off FROM deck UNION ALL SELECT rig, seq, 1, 2.0::DOUBLE + peak FROM up),
  sa AS (SELECT rig, seq, camera, plane, z, off + 0.05::DOUBLE * CAST(camera[2] AS INT) AS zt FROM pixels JOIN pl USING (rig, seq) WHERE camera <> 'c0' AND abs(z - (off + 0.05::DOUBLE * CAST(camera[2] AS INT))) <= 0.08),
  pc AS (SELECT rig, seq, camera, plane, count(*) AS n FROM sa GROUP BY ALL), cc AS (SELECT rig, seq, camera, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n >= 6) AS usable FROM pc GROUP BY ALL),
  ln AS (SELECT sa.* FROM sa JOIN cc USING (rig, seq, camera) JOIN up USING (rig, seq) WHERE usable >= 2 AND n >= 25), {_line_steps("w", "ln", "rig, seq, camera", 4, 1.345)},
  sc AS (SELECT rig, seq, camera, n, a AS fa, b AS fb, a BETWEEN 0.9 AND 1.1 AS sound FROM cc LEFT JOIN wc3 USING (rig, seq, camera)),
  of AS (SELECT rig, seq, camera, median(zt - z) AS o FROM sa GROUP BY ALL),
  fit AS (SELECT rig, seq, camera, n, CASE WHEN sound IS NULL THEN 'offset_only' WHEN sound THEN 'affine' ELSE 'offset_only_scale_rejected' END AS model, CASE WHEN sound THEN fa ELSE 1 END AS a, CASE WHEN sound THEN fb ELSE o END AS b FROM sc JOIN of USING (rig, seq, camera)),
  proposals AS (SELECT rig, ts, seq, camera, deck.inliers IS NOT NULL AS ok, CASE WHEN deck.inliers IS NULL THEN NULL WHEN camera = 'c0' THEN 'reference' ELSE coalesce(model, 'none') END AS model,
    CASE WHEN deck.inliers IS NULL THEN NULL WHEN camera = 'c0' THEN 1 ELSE a END AS a, CASE WHEN deck.inliers IS NULL THEN NULL WHEN camera = 'c0' THEN 0 ELSE b END AS b,
    CASE WHEN camera = 'c0' AND deck.inliers IS NOT NULL THEN deck.inliers ELSE coalesce(n, 0) END AS n, 2 + peak AS upper_offset
    FROM frames CROSS JOIN (SELECT unnest(['c0', 'c1', 'c2']) AS camera) LEFT JOIN deck USING (rig, seq) LEFT JOIN up USING (rig, seq) LEFT JOIN fit USING (rig, seq, camera))"""


@query("align_two_planes", f"WITH {PROPOSALS} SELECT rig, seq, camera, ok, model, round(a, 6) AS a, round(b, 6) AS b, n, round(upper_offset, 9) AS upper_offset FROM proposals")
def align_two_planes(t):
    p = two_plane_proposals(pixels(t.table("lineitem")), cameras(t), ["rig", "ts", "seq"], "c0", **SMALL)
    return rounded(rounded(p.select("rig", "seq", "camera", "ok", "model", "a", "b", "n", "upper_offset"), 6, "a", "b"), 9, "upper_offset")


@query("online_align_two_planes", f"""WITH RECURSIVE {PROPOSALS}, q AS (SELECT rig, seq, camera, ok, a, b, row_number() OVER (PARTITION BY rig, camera ORDER BY ts, seq) AS k FROM proposals), f AS (SELECT rig, min(k) AS first FROM q WHERE ok GROUP BY rig),
  st AS (SELECT DISTINCT rig, camera, 0::BIGINT AS k, 0::BIGINT AS seq, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM q
  UNION ALL SELECT q.rig, q.camera, q.k, q.seq, CASE WHEN q.a IS NULL THEN st.a WHEN q.k = f.first THEN q.a ELSE 0.7::DOUBLE * st.a + 0.3::DOUBLE * (st.a + greatest(-0.01, least(0.01, q.a - st.a))) END,
    CASE WHEN q.a IS NULL THEN st.b WHEN q.k = f.first THEN q.b ELSE 0.7::DOUBLE * st.b + 0.3::DOUBLE * (st.b + greatest(-0.15, least(0.15, q.b - st.b))) END FROM st JOIN q ON q.rig = st.rig AND q.camera = st.camera AND q.k = st.k + 1 LEFT JOIN f ON f.rig = q.rig)
  SELECT rig, seq, camera, round(a, 6) AS a, round(b, 6) AS b FROM st WHERE k > 0""")
def online_align_two_planes(t):
    path, checkpoint = scratch_path(t.spark, "proposals"), scratch_path(t.spark, "proposals-checkpoint")
    alignment.start_proposals(pixels(windows.read_table_stream(t.spark, t.folder, "lineitem")), cameras(t), "c0", path, checkpoint, **SMALL).awaitTermination()
    tracked = alignment.track_alignment(alignment.read_proposals(t.spark, path))
    return rounded(windows.replay(tracked).select("rig", "seq", "camera", "a", "b"), 6, "a", "b")


# ---- searches on part tables: a capture is a brand, its cells or points are parts

BRAND = "CAST(substr(p_brand, 7) AS INT)"
RASTERS = f"""brand AS (SELECT p_brand AS capture, {BRAND} AS b, p_partkey % 20 AS iu, (p_partkey // 20) % 12 AS iv, p_size FROM part),
  cells AS (SELECT DISTINCT capture, 'a' AS side, iu + 2 AS iu, iv + 2 AS iv FROM brand WHERE p_size % 3 <> 0 UNION ALL SELECT DISTINCT capture, 'b', iu + 2 - (b % 5 - 2), iv + 2 - (b % 3 - 1) FROM brand WHERE p_size % 4 <> 0)"""


def brand_number():
    return F.substring("p_brand", 7, 9).cast("int")


@query("phase_correlation", f"""WITH {RASTERS}, fr AS (SELECT ku, kv FROM (SELECT unnest(range(24)) AS ku), (SELECT unnest(range(16)) AS kv)),
  ft AS (SELECT capture, ku, kv, sum(cos(2*pi()*(ku*iu/24 + kv*iv/16))) FILTER (side = 'a') AS ar, -sum(sin(2*pi()*(ku*iu/24 + kv*iv/16))) FILTER (side = 'a') AS ai, sum(cos(2*pi()*(ku*iu/24 + kv*iv/16))) FILTER (side = 'b') AS br, -sum(sin(2*pi()*(ku*iu/24 + kv*iv/16))) FILTER (side = 'b') AS bi FROM cells, fr GROUP BY ALL),
  cr AS (SELECT capture, ku, kv, coalesce(ar*br + ai*bi, 0) AS xr, coalesce(ai*br - ar*bi, 0) AS xi, sqrt((ar*ar + ai*ai) * (br*br + bi*bi)) AS m FROM ft),
  iv AS (SELECT capture, p.ku AS u, p.kv AS v, sum((xr*cos(2*pi()*(c.ku*p.ku/24 + c.kv*p.kv/16)) - xi*sin(2*pi()*(c.ku*p.ku/24 + c.kv*p.kv/16))) / m) / 384 AS r FROM cr c, fr p WHERE m >= 1e-9 GROUP BY ALL),
  best AS (SELECT * FROM iv QUALIFY row_number() OVER (PARTITION BY capture ORDER BY round(r, 9) DESC, u, v) = 1)
  SELECT capture, CASE WHEN u > 12 THEN u - 24 ELSE u END AS du, CASE WHEN v > 8 THEN v - 16 ELSE v END AS dv, round(r, 4) AS score FROM best""")
def phase_correlation(t):
    k, b = F.col("p_partkey"), F.col("b")
    brand = t.table("part").select(F.col("p_brand").alias("capture"), brand_number().alias("b"), (k % 20).alias("iu"), (F.floor(k / 20) % 12).alias("iv"), "p_size")
    a = brand.filter(F.col("p_size") % 3 != 0).select("capture", F.lit("a").alias("side"), (F.col("iu") + 2).alias("iu"), (F.col("iv") + 2).alias("iv")).distinct()
    m = brand.filter(F.col("p_size") % 4 != 0).select("capture", F.lit("b").alias("side"), (F.col("iu") + 2 - (b % 5 - 2)).alias("iu"), (F.col("iv") + 2 - (b % 3 - 1)).alias("iv")).distinct()
    cells = a.union(m).withColumns({"value": F.lit(1.0), "nu": F.lit(24), "nv": F.lit(16)})
    return rounded(search.phase_correlation(cells, ["capture"]), 4, "score")


BELT = f"""belt AS (SELECT p_brand AS capture, {BRAND} AS b, p_partkey AS pid, p_size, CAST(((p_partkey % 20) - 9.5) * 0.45 AS DOUBLE) AS u, CAST((((p_partkey // 20) % 40) - 19.5) * 0.1 AS DOUBLE) AS v, CAST(0.05 + p_size / 200 AS DOUBLE) AS h FROM part)"""


def belt(t: Tables):
    k = F.col("p_partkey")
    return t.table("part").select(
        F.col("p_brand").alias("capture"), brand_number().alias("b"), k.alias("pid"), "p_size", ((k % 20 - F.lit(9.5)) * 0.45).cast("double").alias("u"),
        ((F.floor(k / 20) % 40 - F.lit(19.5)) * 0.1).cast("double").alias("v"), (0.05 + F.col("p_size") / 200).cast("double").alias("h"))


@query("footprint_slide", f"""WITH {BELT}, hyp AS (SELECT * FROM (VALUES (0, '0', 1), (1, '180', -1)) AS w(no, yaw, sg)),
  full_a AS (SELECT capture FROM belt WHERE h > 0.06 AND h < 0.28 GROUP BY ALL HAVING count(*) >= 20), full_b AS (SELECT capture FROM belt WHERE h > 0.06 AND h < 0.28 AND p_size % 3 <> 0 GROUP BY ALL HAVING count(*) >= 20),
  a AS (SELECT DISTINCT capture, CAST(floor((u + 6) / 0.15) AS BIGINT) AS iu, CAST(floor((v + 1.5) / 0.15) AS BIGINT) AS iv FROM belt JOIN full_a USING (capture) WHERE h > 0.06 AND h < 0.28 AND abs(v) <= 1.5),
  mv AS (SELECT capture, no, yaw, sg * (CASE WHEN b % 2 = 1 THEN -1 ELSE 1 END) * (u + (b % 7 - 3) * 0.3) AS u, sg * (CASE WHEN b % 2 = 1 THEN -1 ELSE 1 END) * v AS v FROM belt JOIN full_b USING (capture), hyp WHERE h > 0.06 AND h < 0.28 AND p_size % 3 <> 0),
  m AS (SELECT DISTINCT capture, no, yaw, CAST(floor((u + 6) / 0.15) AS BIGINT) AS iu, CAST(floor((v + 1.5) / 0.15) AS BIGINT) AS iv FROM mv WHERE abs(v) <= 1.5 AND u + 6 >= 0 AND floor((u + 6) / 0.15) < 81),
  st AS (SELECT capture, no, yaw, min(iu) AS c0, max(iu) + 1 AS c1, count(*) AS nb FROM m GROUP BY ALL), ks AS (SELECT unnest(range(-10, 11)) AS k),
  sh AS (SELECT m.capture, m.no, a.iu - m.iu AS k, count(*) AS shared FROM m JOIN a ON a.capture = m.capture AND a.iv = m.iv GROUP BY ALL),
  na AS (SELECT st.capture, st.no, k, count(a.iu) AS n FROM st CROSS JOIN ks LEFT JOIN a ON a.capture = st.capture AND a.iu >= c0 + k AND a.iu < c1 + k GROUP BY ALL),
  sc AS (SELECT st.capture, st.no, yaw, ks.k, coalesce(shared, 0) / greatest(n + nb - coalesce(shared, 0), 1) AS score FROM st CROSS JOIN ks JOIN na ON na.capture = st.capture AND na.no = st.no AND na.k = ks.k LEFT JOIN sh ON sh.capture = st.capture AND sh.no = st.no AND sh.k = ks.k
    WHERE c0 + ks.k >= 0 AND c1 + ks.k <= 81 AND st.capture IN (SELECT capture FROM a)),
  best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY capture ORDER BY score DESC, no, k) = 1), caps AS (SELECT DISTINCT p_brand AS capture FROM part WHERE p_size % 3 <> 0)
  SELECT capture, coalesce(yaw, '0') AS yaw, round(coalesce(k * 0.15, 0), 9)::DOUBLE AS slide, round(coalesce(score, 0), 9)::DOUBLE AS score FROM caps LEFT JOIN best USING (capture)""")
def footprint_slide(t):
    p = belt(t)
    sign = F.when(F.col("b") % 2 == 1, -1.0).otherwise(1.0)
    moved = p.filter(F.col("p_size") % 3 != 0).select("capture", (sign * (F.col("u") + (F.col("b") % 7 - 3) * F.lit(0.3))).alias("u"), (sign * F.col("v")).alias("v"), "h")
    return rounded(search.footprint_slide(p, moved, ["capture"], 6.0, 1.5, 0.15, 1.5 + 1e-9, (0.06, 0.28), min_points=20), 9, "slide", "score")


SCALES, SLIDES, FINE = (0.9, 1.1, 0.05), (-0.3, 0.3, 0.1), 8
GRID = ", ".join(f"({i}, {s!r}::DOUBLE)" for i, s in enumerate(search._grid(*SCALES)))
GRID_D = ", ".join(f"({i}, {d!r}::DOUBLE)" for i, d in enumerate(search._grid(SLIDES[0], SLIDES[1] + 1e-9, SLIDES[2])))


def _scored(name: str, candidates: str) -> str:
    return f"""{name}h AS (SELECT c.capture, c.si, c.di, c.s, c.d, count(*) FILTER (2 - c.s * z > 0.08) AS n, median(2 - c.s * z) AS off FROM {candidates} c JOIN mp USING (capture) GROUP BY ALL),
  {name} AS (SELECT h.*, (SELECT count(*) FROM mp WHERE mp.capture = h.capture AND 2 - h.s * mp.z > 0.08 AND EXISTS (SELECT 1 FROM rp WHERE rp.capture = h.capture AND pow(rp.x - (h.s * mp.x + h.d), 2) + pow(rp.y - h.s * mp.y, 2) + pow(rp.z - h.s * mp.z, 2) <= 0.0009)) / n AS score FROM {name}h h WHERE abs(off) <= 0.5 AND n >= 10)"""


@query("slide_and_scale", f"""WITH {BELT}, rp AS (SELECT capture, u AS x, v AS y, 2 - h AS z FROM belt), mp AS (SELECT capture, (u - (b % 5 - 2) * 0.1::DOUBLE) / (1 + (b % 4 - 1) * 0.03::DOUBLE) AS x, v / (1 + (b % 4 - 1) * 0.03::DOUBLE) AS y, (2 - h) / (1 + (b % 4 - 1) * 0.03::DOUBLE) AS z FROM belt WHERE p_size % 3 <> 0),
  caps AS (SELECT DISTINCT capture FROM mp), g AS (SELECT capture, si, s, di, d FROM caps, (VALUES {GRID}) AS a(si, s), (VALUES {GRID_D}) AS b(di, d)), {_scored("co", "g")},
  c1 AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY capture ORDER BY score DESC, si, di) = 1),
  f AS (SELECT capture, si2 AS si, s - {SCALES[2]} + si2 * {SCALES[2]}::DOUBLE / {FINE} AS s, di2 AS di, d - {SLIDES[2]} + di2 * {SLIDES[2]}::DOUBLE / {FINE} AS d FROM c1, (SELECT unnest(range(16)) AS si2), (SELECT unnest(range(16)) AS di2)), {_scored("fi", "f")},
  c2 AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY capture ORDER BY score DESC, si, di) = 1),
  r AS (SELECT capture, CASE WHEN c2.score > c1.score THEN c2.s ELSE c1.s END AS s, CASE WHEN c2.score > c1.score THEN c2.d ELSE c1.d END AS d, greatest(c1.score, c2.score) AS score, CASE WHEN c2.score > c1.score THEN c2.off ELSE c1.off END AS off FROM c1 LEFT JOIN c2 USING (capture))
  SELECT capture, round(coalesce(s, 1), 6) AS scale, round(coalesce(d, 0), 6) AS slide, round(coalesce(score, 0), 6) AS support, round(off, 6) AS deck_off FROM caps LEFT JOIN r USING (capture)""")
def slide_and_scale(t):
    p = belt(t)
    ref = p.select("capture", F.col("u").alias("x"), F.col("v").alias("y"), (2 - F.col("h")).alias("z"))
    k, shift = 1 + (F.col("b") % 4 - 1) * F.lit(0.03), (F.col("b") % 5 - 2) * F.lit(0.1)
    moved = p.filter(F.col("p_size") % 3 != 0).select("capture", ((F.col("u") - shift) / k).alias("x"), (F.col("v") / k).alias("y"), ((2 - F.col("h")) / k).alias("z"))
    z, o = F.lit(0.0), F.lit(1.0)
    frames = p.select("capture").distinct().select("capture", F.array(z, z, F.lit(2.0)).alias("centre"), F.array(o, z, z).alias("ex"), F.array(z, z, -o).alias("n"))
    found = search.slide_and_scale(moved, ref, frames, ["capture"], SCALES, SLIDES, 0.03, 0.08, 0.5, min_points=10, fine=FINE, tile=4)
    return rounded(found, 6, "scale", "slide", "support", "deck_off")


VIEWS = """vp AS (SELECT vec_id % 3 AS g, label % 3 AS camera, vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
  CAST(embedding[4] AS DOUBLE) AS nx, CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz FROM embeddings)"""


@query("depth_scale", f"""WITH {VIEWS}, ln AS (SELECT g, median(sqrt(x*x + y*y + z*z)) AS length, count(*) AS n FROM vp WHERE camera = 0 GROUP BY g HAVING count(*) >= 5),
  ks AS (SELECT g, i AS probe, 0.5::DOUBLE + i * 0.25::DOUBLE AS k FROM (SELECT DISTINCT g FROM vp), (SELECT unnest(range(5)) AS i)),
  sd AS (SELECT g, probe, k, camera, pid, x - 0.05::DOUBLE * camera / k AS x, y - 0.02::DOUBLE * camera / k AS y, z AS z FROM vp JOIN ks USING (g) JOIN ln USING (g) WHERE camera <> 0),
  nn AS (SELECT s.g, s.probe, s.camera, s.pid, abs((s.x - r.x) * r.nx + (s.y - r.y) * r.ny + (s.z - r.z) * r.nz) AS gap, pow(s.x - r.x, 2) + pow(s.y - r.y, 2) + pow(s.z - r.z, 2) AS d2 FROM sd s JOIN vp r ON r.g = s.g AND r.camera = 0
    QUALIFY row_number() OVER (PARTITION BY s.g, s.probe, s.camera, s.pid ORDER BY d2, r.pid) = 1),
  pr AS (SELECT g, probe, camera, median(gap) AS gap FROM nn WHERE d2 <= 0.04 GROUP BY ALL HAVING count(*) >= 5), sc AS (SELECT g, probe, avg(gap / length) AS score FROM pr JOIN ln USING (g) GROUP BY ALL),
  al AS (SELECT g, median(score) AS mid, count(score) AS n FROM sc GROUP BY g), b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY g ORDER BY score, probe) = 1)
  SELECT gs.g, round((greatest(0.25 + probe * 0.25, 0.5) + least(0.75 + probe * 0.25, 1.5)) / 2, 6)::DOUBLE AS scale, round(score, 6) AS score, round(CASE WHEN n >= 3 AND mid > 0 THEN (mid - score) / mid ELSE 0 END, 6) AS contrast, probe IN (0, 4) AS at_edge
  FROM (SELECT DISTINCT g FROM vp) gs LEFT JOIN b USING (g) LEFT JOIN al USING (g)""")
def depth_scale(t):
    e = F.col("embedding")
    p = t.table("embeddings").select((F.col("vec_id") % 3).alias("g"), (F.col("label") % 3).alias("camera"), F.col("vec_id").alias("pid"), *[e[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))])
    z, o, k = F.lit(0.0), F.lit(1.0), F.col("camera").cast("double")
    cams = p.select("camera").distinct().select("camera", F.array(o, z, z, z, o, z, z, z, o).alias("R"), F.array(0.05 * k, 0.02 * k, z).alias("t"))
    best, _ = search.depth_scale(p, cams, ["g"], 0, 0.5, 1.5, 5, 0.2, refine=0, min_points=5)
    return rounded(best.select("g", "scale", "score", "contrast", "at_edge"), 6, "scale", "score", "contrast")


# ---- fields, smoothing, recovery


@query("depth_field_bootstrapped")
def depth_field_bootstrapped(t):
    p = pixels(t.table("lineitem")).filter("camera <> 'c0'").select("rig", "camera", "z", "rx", "ry")
    planes = p.select("rig", "camera").distinct().withColumn("_p", F.explode(F.array(*[F.struct(F.lit(n).alias("plane"), F.lit(z).alias("z")) for n, z in (("deck", 2.0), ("top", 2.3))])))
    planes = planes.select("rig", "camera", "_p.plane", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), (F.col("_p.z") + 0.05 * F.substring("camera", 2, 1).cast("double")).alias("off"))
    fit, _ = depth_field.field_fit_bootstrapped(p, planes, ["rig", "camera"], "deck", 0.14, 0.08, 0.04, min_plane_points=100, min_samples=200)
    return rounded(fit, 6, "s", "a", "b", "c", "held_rms", "worst_rms")


@query("guided_filter", f"""WITH {CLOUD}, r AS (SELECT camera, CAST(u + 24.5 AS BIGINT) AS iu, CAST(v + 5 AS BIGINT) AS iv, avg(h) AS g, avg(l_partkey)::DOUBLE AS p FROM (SELECT *, l_partkey FROM cloud) GROUP BY ALL),
  n AS (SELECT camera, max(iu) - min(iu) + 1 AS nu, max(iv) - min(iv) + 1 AS nv, min(iu) AS u0, min(iv) AS v0, count(*) AS k FROM r GROUP BY ALL), rad AS (SELECT unnest([2, 5]) AS radius),
  w AS (SELECT camera, radius, r.iu, r.iv, least(greatest(r.iu + a.d, u0), u0 + nu - 1) AS ju, least(greatest(r.iv + b.d, v0), v0 + nv - 1) AS jv FROM r JOIN n USING (camera), rad, (SELECT unnest(range(-5, 6)) AS d) a, (SELECT unnest(range(-5, 6)) AS d) b WHERE abs(a.d) <= radius AND abs(b.d) <= radius),
  m AS (SELECT w.camera, radius, w.iu, w.iv, avg(g) AS mi, avg(p) AS mp, avg(g * p) AS mip, avg(g * g) AS mii FROM w JOIN r ON r.camera = w.camera AND r.iu = w.ju AND r.iv = w.jv GROUP BY ALL),
  ab AS (SELECT camera, radius, iu, iv, (mip - mi * mp) / (mii - mi * mi + 0.5) AS a, mp - (mip - mi * mp) / (mii - mi * mi + 0.5) * mi AS b FROM m),
  s AS (SELECT w.camera, radius, w.iu, w.iv, avg(a) AS a, avg(b) AS b FROM w JOIN ab USING (camera, radius) WHERE ab.iu = w.ju AND ab.iv = w.jv GROUP BY ALL)
  SELECT camera, radius, iu, iv, CASE WHEN k = nu * nv THEN round(a * g + b, 4) END AS smooth FROM r JOIN n USING (camera) JOIN s USING (camera, iu, iv)""")
def guided_filter(t):
    c = t.cloud().select("camera", (F.col("u") + 24.5).cast("long").alias("iu"), (F.col("v") + 5).cast("long").alias("iv"), "h", "l_partkey")
    r = c.groupBy("camera", "iu", "iv").agg(F.avg("h").alias("g"), F.avg("l_partkey").cast("double").alias("p"))
    both = [guided.guided_filter(r, ["camera"], "g", "p", k, 0.5).withColumn("radius", F.lit(k)) for k in (2, 5)]
    return rounded(both[0].unionByName(both[1]), 4, "smooth")


@query("peel_unclaimed")
def peel_unclaimed(t):
    # parts as columns of points: a part holds as many points on its top as it has sizes, over its footprint
    p = belt(t).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).select(
        "capture", (F.col("pid") * 40 + F.col("k")).alias("pid"), (F.col("u") + F.col("k") % 8 * 0.05).alias("u"), (F.col("v") + F.floor(F.col("k") / 8) * 0.02).alias("v"), (F.floor(F.col("h") * 10) / 5 + F.col("k") % 3 * 0.001).alias("h"))
    claimed = p.filter(F.floor(F.col("pid") / 40) % 5 == 0).select("capture", "pid")
    got = recovery.peel_unclaimed(p, claimed, ["capture"], 0.06, close=1, min_cells=8, min_points=20, min_gap=0.02)
    return rounded(got.drop("label"), 5, "height", "relief", "cu", "cv", "length", "width", "yaw", "coverage")


@query("grade_table")
def grade_table(t):
    # a run is a year of line items with its own reference, the items that stand fifth or later in their order
    c = t.cloud().select(F.year("l_shipdate").alias("run"), (F.col("l_linenumber") % 4).alias("camera"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"), *[F.col(k).cast("double").alias(k) for k in "uvh"], "l_linenumber")
    c = materialise(c, "grade-cloud")
    fused, ref = c.filter("l_linenumber < 5"), c.filter("l_linenumber >= 5").withColumnRenamed("run", "scene")
    runs = c.select("run").distinct().select("run", F.col("run").alias("scene"), F.concat(F.lit("Y"), F.col("run").cast("string")).alias("subset"), F.lit(504).alias("res"), F.lit("420x504").alias("depth_grid"))
    k = F.col("camera").cast("double")
    centres = c.select("camera").distinct().select("camera", (10 * k).alias("x"), (k * k).alias("y"), (200 + k).alias("z"))
    g = grades.grade_table(runs, fused, fused, ref, centres, ["run"], 1.0, 22.0, 4.0, 0.05, 30.0, 50.0, (20.0, 80.0), 1.0, 2.0, layer_band=20.0, layer_above=40.0, layer_tol=4.0, min_deck=50, min_cells=100, min_tops=20, min_view=50, unit=1.0)
    return rounded(g, 6, *[f.name for f in g.schema if f.dataType.simpleString() == "double"])


# ---- bias of cameras, poses and folds

FOLDS = f"""{PLACEMENTS}, folds AS (SELECT DISTINCT camera, label FROM placements), rep AS (SELECT p.camera, f.label AS held, h_true, h_meas FROM placements p JOIN folds f ON f.camera = p.camera AND f.label <> p.label)"""


@query("leave_one_height_out_reweighted", f"""WITH {FOLDS}, {irls_sql('rep', 'camera, held', ['h_true'], 'h_meas', 2.0, 6)}, sc AS (SELECT p.camera, p.label, f.p, f.q, h_meas - h_true AS b, h_meas - (f.p * h_true + f.q) AS a FROM placements p JOIN fit f ON f.camera = p.camera AND f.held = p.label)
  SELECT camera, label, round(any_value(p), 6) AS p, round(any_value(q), 6) AS q, count(*) AS n, round(median(b), 6) AS median_before, round(sqrt(avg(b * b)), 6) AS rms_before, round(median(a), 6) AS median_after, round(sqrt(avg(a * a)), 6) AS rms_after FROM sc GROUP BY camera, label""")
def leave_one_height_out_reweighted(t):
    r = camera_bias.leave_one_out_reweighted(t.placements(), ["camera"], "label", "h_true", "h_meas")
    return rounded(r, 6, "p", "q", "median_before", "rms_before", "median_after", "rms_after")


@query("leave_one_plane_out_reweighted", f"""WITH {FOLDS}, {irls_sql('rep', 'camera, held', ['h_meas'], 'h_true', 1.345, 6)}, sc AS (SELECT p.camera, p.label, f.p, f.q, h_true - h_meas AS b, h_true - (f.p * h_meas + f.q) AS a FROM placements p JOIN fit f ON f.camera = p.camera AND f.held = p.label WHERE p.camera IN (SELECT camera FROM folds GROUP BY camera HAVING count(*) >= 3))
  SELECT camera, label, round(any_value(p), 6) AS p, round(any_value(q), 6) AS q, count(*) AS n, round(median(b), 6) AS median_before, round(sqrt(avg(b * b)), 6) AS rms_before, round(median(a), 6) AS median_after, round(sqrt(avg(a * a)), 6) AS rms_after FROM sc GROUP BY camera, label""")
def leave_one_plane_out_reweighted(t):
    r = camera_bias.leave_one_out_reweighted(t.placements(), ["camera"], "label", "h_meas", "h_true", 1.345, min_folds=3)
    return rounded(r, 6, "p", "q", "median_before", "rms_before", "median_after", "rms_after")


@query("camera_bias")
def camera_bias_query(t):
    # two surfaces of each camera: the reference's deck and tops of the pixel view, as points of the rig
    p = pixels(t.table("lineitem")).filter("camera <> 'c0' or z < 2.7").join(cameras(t).select("camera", F.col("t")[0].alias("tx"), F.col("t")[2].alias("tz")), "camera")
    z = F.col("z")
    pts = p.select("rig", "camera", F.when(z - F.col("tz") > 2.15, "far").otherwise("near").alias("surface"), (F.col("rx") * z - F.col("tx")).alias("x"), (F.col("ry") * z).alias("y"), (z - F.col("tz")).alias("z"))
    at = cameras(t).select("camera", (-F.col("t")[0]).alias("x"), F.lit(0.0).alias("y"), (-F.col("t")[2]).alias("z"))
    return rounded(camera_bias.camera_bias(pts, at, ["rig"], 20), 6, "scale", "offset", "near_tilt_deg", "far_tilt_deg")


@query("relative_rotation_error", f"""WITH {BELT}
  SELECT capture, n AS cameras, round(e, 5) AS rotation_error_deg FROM (SELECT capture, count(*) AS n, max(degrees(acos(greatest(-1, least(1, cos(est - f_est - (cal - f_cal))))))) AS e FROM (SELECT capture, est, cal, first_value(est) OVER w AS f_est, first_value(cal) OVER w AS f_cal FROM (SELECT capture, pid, 0.3::DOUBLE + u AS est, 0.1::DOUBLE + u + h AS cal FROM belt) WINDOW w AS (PARTITION BY capture ORDER BY pid)) GROUP BY capture)""")
def relative_rotation_error(t):
    z, o = F.lit(0.0), F.lit(1.0)

    def turn(a):
        return F.array(F.cos(a), -F.sin(a), z, F.sin(a), F.cos(a), z, z, z, o)

    p = belt(t).select("capture", F.col("pid").alias("camera"), turn(0.3 + F.col("u")).alias("R_est"), turn(0.1 + F.col("u") + F.col("h")).alias("R_cal"))
    return rounded(camera_bias.relative_rotation_error(p, ["capture"]), 5, "rotation_error_deg")
