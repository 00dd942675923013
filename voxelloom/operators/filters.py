"""Pixel and point quality filters, with counts of what each one removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions.geometry import Vec, clamp, cross, dot, norm, pixel_ray, unproject
from voxelloom.operators.groups import median, quantiles


def valid_depth(z: Column, dmin: float | None = None, dmax: float | None = None) -> Column:
    ok = z.isNotNull() & ~F.isnan(z) & (z > 0) & (z < float("inf"))
    if dmin is not None:
        ok = ok & (z >= dmin)
    if dmax is not None:
        ok = ok & (z <= dmax)
    return F.coalesce(ok, F.lit(False))


def with_confidence_keep(pixels: DataFrame, by: list[str], pct: float = 40.0, z: str = "z", conf: str = "conf", **kw) -> DataFrame:
    """Adds ``keep_conf``: confidence at or above the percentile over the group's valid pixels."""
    limit = quantiles(pixels.filter(valid_depth(F.col(z))), by, conf, {"_limit": pct / 100.0}, **kw).drop("n")
    return pixels.join(limit, by, "left").withColumn("keep_conf", F.coalesce(F.col(conf) >= F.col("_limit"), F.lit(False))).drop("_limit")


def confidence_filter(pixels: DataFrame, by: list[str], pct: float = 40.0, **kw) -> DataFrame:
    kept = with_confidence_keep(pixels, by, pct, **kw)
    return kept.filter("keep_conf").drop("keep_conf")


def _row(by: list[str]):
    return Window.partitionBy(*by, "v").orderBy("u")


def _column(by: list[str]):
    return Window.partitionBy(*by, "u").orderBy("v")


def _at(by: list[str], axis: str, step: int, value: str) -> Column:
    """Value of the pixel exactly ``step`` away along an axis, NULL when missing."""
    w = (_row(by) if axis == "u" else _column(by)).rangeBetween(step, step)
    return F.first(value).over(w)


def neighbourhood(pixels: DataFrame, by: list[str], reach: int, lows: dict[str, Column], highs: dict[str, Column]) -> DataFrame:
    """Adds minima and maxima over the (2 reach + 1) square, one axis at a time, combined before the shuffle.

    Values also pass through places where a pixel is missing, so the square is whole at holes.
    """
    names = [*lows, *highs]
    out = pixels.select(*by, "u", "v", *[c.alias(n) for n, c in {**lows, **highs}.items()])
    for axis, rest in (("u", "v"), ("v", "u")):
        out = out.withColumn("_o", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).groupBy(*by, rest, (F.col(axis) + F.col("_o")).alias(axis)).agg(
            *[F.min(n).alias(n) for n in lows], *[F.max(n).alias(n) for n in highs])
    return pixels.join(out.select(*by, "u", "v", *names), [*by, "u", "v"], "left")


def erode_mask(pixels: DataFrame, by: list[str], mask: str, reach: int, out: str | None = None) -> DataFrame:
    """Square erosion of a boolean column; missing pixels do not erode."""
    step = neighbourhood(pixels, by, reach, {"_e": F.col(mask).cast("int")}, {})
    return step.withColumn(out or mask, F.col("_e") == 1).drop("_e")


def with_edge_keep(pixels: DataFrame, by: list[str], rel_thresh: float = 0.02, dilate: int = 1, z: str = "z", **kw) -> DataFrame:
    """Adds ``keep_edge``: central-difference gradient over depth small, eroded by ``dilate``.

    Invalid pixels take the map median before the gradient; a border difference uses the pixel itself.
    """
    fill = median(pixels.filter(valid_depth(F.col(z))), by, z, "_fill", **kw).drop("n")
    filled = pixels.join(fill, by, "left").withColumn("_z", F.when(valid_depth(F.col(z)), F.col(z)).otherwise(F.col("_fill")))
    diffs = {}
    for axis in ("u", "v"):
        ahead, back = _at(by, axis, 1, "_z"), _at(by, axis, -1, "_z")
        span = F.when(ahead.isNotNull() & back.isNotNull(), 2.0).otherwise(1.0)
        diffs["_g" + axis] = (F.coalesce(ahead, F.col("_z")) - F.coalesce(back, F.col("_z"))) / span
    graded = filled.withColumns(diffs)
    rel = F.hypot("_gu", "_gv") / F.greatest(F.col("_z"), F.lit(1e-6))
    marked = graded.withColumn("keep_edge", rel <= rel_thresh).drop("_gu", "_gv", "_z", "_fill")
    return erode_mask(marked, by, "keep_edge", dilate) if dilate else marked


def with_incidence_keep(pixels: DataFrame, by: list[str], max_deg: float = 70.0) -> DataFrame:
    """Adds ``keep_incidence`` from the normal of central differences; needs camera columns ``fx fy cx cy``."""
    x, y, z = unproject(F.col("z"), F.col("u"), F.col("v"))
    p = pixels.withColumns({"_x": x, "_y": y, "_z": z})

    def across(axis: str) -> Vec:
        return tuple(_at(by, axis, 1, "_" + k) - _at(by, axis, -1, "_" + k) for k in "xyz")  # type: ignore[return-value]

    du, dv = across("u"), across("v")
    p = p.withColumns({**{f"_u{k}": du[i] for i, k in enumerate("xyz")}, **{f"_v{k}": dv[i] for i, k in enumerate("xyz")}})
    n = cross(tuple(F.col("_u" + k) for k in "xyz"), tuple(F.col("_v" + k) for k in "xyz"))  # type: ignore[arg-type]
    ray = pixel_ray(F.col("u"), F.col("v"))
    length = norm(n) * norm(ray)
    angle = F.when(length > 1e-15, F.degrees(F.acos(clamp(F.abs(dot(n, ray)) / length, 0.0, 1.0))))
    out = p.withColumn("incidence_deg", angle).withColumn("keep_incidence", F.coalesce(F.col("incidence_deg") <= max_deg, F.lit(False)))
    return out.drop(*[f"_{a}{k}" for a in ("", "u", "v") for k in "xyz"])


def with_flying_keep(pixels: DataFrame, by: list[str], thresh: float, relative: bool = False, dilate: int = 0, z: str = "z") -> DataFrame:
    """Adds ``keep_flying``: 3x3 depth range below the threshold; the steep mask is what grows."""
    v = pixels.withColumn("_z", F.when(valid_depth(F.col(z)), F.col(z)))
    both = neighbourhood(v, by, 1, {"_lo": F.col("_z")}, {"_hi": F.col("_z")})
    span = F.col("_hi") - F.col("_lo")
    steep = (span / F.col("_z") if relative else span) >= thresh
    marked = both.withColumn("_steep", F.coalesce(steep, F.lit(False)).cast("int"))
    if dilate:
        marked = neighbourhood(marked, by, dilate, {}, {"_grown": F.col("_steep")}).withColumn("_steep", F.col("_grown")).drop("_grown")
    return marked.withColumn("keep_flying", (F.col("_steep") == 0) & F.col("_z").isNotNull()).drop("_z", "_lo", "_hi", "_steep")


def roi_crop(points: DataFrame, by: list[str], box: tuple[float, ...], min_count: int = 100, xyz=("x", "y", "z")) -> DataFrame:
    """Inclusive crop; groups keeping fewer than ``min_count`` points are rejected."""
    inside = points
    for i, c in enumerate(xyz):
        inside = inside.filter((F.col(c) >= box[2 * i]) & (F.col(c) <= box[2 * i + 1]))
    enough = inside.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count)
    return inside.join(enough.select(*by), by, "left_semi")


def in_belt(margin: float = 0.05) -> Column:
    return (F.abs("u") <= F.col("length_m") / 2 + margin) & (F.abs("v") <= F.col("width_m") / 2 + margin)


def height_band(h: Column, lo: float | None, hi: float | None, closed_lo: bool = False, closed_hi: bool = False) -> Column:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & ((h >= lo) if closed_lo else (h > lo))
    if hi is not None:
        ok = ok & ((h <= hi) if closed_hi else (h < hi))
    return ok


def mask_funnel(pixels: DataFrame, by: list[str], masks: list[str], valid: Column) -> DataFrame:
    """Pixels dropped by each mask in order (``drop_``), and by each on its own (``kill_``)."""
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid")]
    alive = valid
    for m in masks:
        aggs.append(F.count_if(alive & ~F.col(m)).alias("drop_" + m))
        aggs.append(F.count_if(valid & ~F.col(m)).alias("kill_" + m))
        alive = alive & F.col(m)
    aggs.append(F.count_if(alive).alias("kept"))
    return pixels.groupBy(*by).agg(*aggs)


def stride_sample(pixels: DataFrame, k: int, u: str = "u", v: str = "v") -> DataFrame:
    return pixels.filter((F.col(u) % k == 0) & (F.col(v) % k == 0))


def seeded_sample(df: DataFrame, by: list[str], cap: int, key: list[str], seed: int = 0) -> DataFrame:
    """At most ``cap`` rows per group, lowest hash first; the threshold keeps the ranked set near ``cap`` rows."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    h = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)).cast("double") / float(1 << 40)
    limit = (cap + 8.0 * cap**0.5 + 64.0) / F.col("_n")
    near = df.join(sizes, by).withColumn("_h", h).filter(F.col("_h") < limit)
    order = Window.partitionBy(*by).orderBy("_h", *key)
    return near.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= cap).drop("_n", "_h", "_k")


def content_mask(u: Column, v: Column, scale: Column, pad_x: Column, pad_y: Column, src_w: Column, src_h: Column) -> Column:
    """The depth pixel maps back into the source image rather than into its padding."""
    x, y = (u + 0.5 - pad_x) / scale - 0.5, (v + 0.5 - pad_y) / scale - 0.5
    return (x >= 0) & (y >= 0) & (x <= src_w - 1) & (y <= src_h - 1)


def sync_filter(frames: DataFrame, by: list[str], max_ms: float) -> DataFrame:
    """Spread of a frame set: device clock when every camera has one, else host clock; adds ``spread_ms`` and ``in_sync``."""
    sets = frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.when(F.count("dev_ts_ns") == F.count(F.lit(1)), (F.max("dev_ts_ns") - F.min("dev_ts_ns")) / 1e6)
        .otherwise((F.max("host_ts_ns") - F.min("host_ts_ns")) / 1e6).alias("spread_ms"))
    return sets.withColumn("in_sync", F.col("spread_ms") <= max_ms)


def lens_gate(records: DataFrame, by: list[str], lens: str, want: str) -> DataFrame:
    """Per group: rows with the wanted lens, rows with another, and the distinct others."""
    return records.groupBy(*by).agg(
        F.count_if(F.col(lens) == want).alias("matching"), F.count_if(F.coalesce(F.col(lens) != want, F.lit(True))).alias("other"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col(lens) != want, F.col(lens)))), ",").alias("other_lenses"))


def mixed_lens(records: DataFrame, by: list[str], lens: str) -> DataFrame:
    return records.groupBy(*by).agg(F.count_distinct(lens).alias("lenses")).filter("lenses > 1")


def guarded(value: Column, count: Column, floor: int) -> Column:
    return F.when(count >= floor, value)


def parcel_shape(length: Column, width: Column, min_dim: float = 0.050, max_dim: float = 1.200, max_aspect: float = 4.0, min_area: float = 0.010) -> Column:
    """Reason a footprint is rejected, NULL when accepted."""
    return (
        F.when((width < min_dim) | (length > max_dim), "footprint outside the accepted range")
        .when(length / F.greatest(width, F.lit(1e-6)) > max_aspect, "sliver")
        .when(length * width < min_area, "top face too small")
    )


def curtain_filter(points: DataFrame, by: list[str], h: str, top: str, band: float, max_ratio: float) -> DataFrame:
    """Skirt ratio of a cluster: points at mid height over points of its top face."""
    mid = (F.col(h) > 0.25 * F.col(top)) & (F.col(h) < 0.75 * F.col(top))
    face = F.col(h) >= F.col(top) - band
    return points.groupBy(*by).agg(F.count_if(mid).alias("mid"), F.count_if(face).alias("face")).withColumn(
        "skirt_ratio", F.col("mid") / F.greatest(F.col("face"), F.lit(1))).withColumn("is_curtain", F.col("skirt_ratio") > max_ratio)


def exposure_stats(pixels: DataFrame, by: list[str], g: str = "g", **kw) -> DataFrame:
    """Mean, sd, p1, p99, shares (per cent) of g <= 2 and of g >= 253."""
    agg = pixels.groupBy(*by).agg(
        F.avg(g).alias("mean"), F.stddev_pop(g).alias("std"),
        (100.0 * F.count_if(F.col(g) <= 2) / F.count(g)).alias("clip_lo"), (100.0 * F.count_if(F.col(g) >= 253) / F.count(g)).alias("clip_hi"))
    return agg.join(quantiles(pixels, by, g, {"p1": 0.01, "p99": 0.99}, **kw), by)


def edge_share(pixels: DataFrame, by: list[str], g: str = "g", limit: float = 30.0) -> DataFrame:
    """Share (per cent) of pixels whose Sobel magnitude exceeds the limit; borders repeat the pixel."""
    rows = pixels.select(*by, "u", "v", F.col(g).cast("double").alias("_g"))
    left, right = F.coalesce(_at(by, "u", -1, "_g"), F.col("_g")), F.coalesce(_at(by, "u", 1, "_g"), F.col("_g"))
    h = rows.withColumn("_d", right - left).withColumn("_s", left + 2 * F.col("_g") + right)

    def v_at(c: str, k: int) -> Column:
        return F.coalesce(_at(by, "v", k, c), F.col(c))

    sob = h.withColumn("_gx", v_at("_d", -1) + 2 * F.col("_d") + v_at("_d", 1)).withColumn("_gy", v_at("_s", 1) - v_at("_s", -1))
    return sob.groupBy(*by).agg((100.0 * F.count_if(F.hypot("_gx", "_gy") > limit) / F.count(F.lit(1))).alias("edge"))
