"""Joins between clouds, rasters, images and plane tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators import blocks
from voxelloom.operators.groups import median, quantiles
from voxelloom.operators.rasters import cell_floor
from voxelloom.session import few, materialise

CELL = ["iu", "iv"]


def cell_compare(
    recon: DataFrame, gt: DataFrame, by: list[str], lo: float | None = None, hi: float | None = None, max_spread: float | None = None
) -> DataFrame:
    """Cells present in both rasters: ``h_gt h_recon error deficit flat``.

    ``error`` is recon - gt, ``deficit`` gt - recon; ``flat`` tells both spreads are within the limit.
    """
    on = [c for c in [*by, *CELL] if c in gt.columns]
    extra = [F.col("spread").alias("spread_gt")] if "spread" in gt.columns else []
    g = gt.select(*on, F.col("h").alias("h_gt"), *[F.col(c).alias("gt_" + c) for c in ("u", "v") if c in gt.columns], *extra)
    j = recon.withColumnRenamed("h", "h_recon").join(g, on)
    if lo is not None:
        j = j.filter(F.col("h_gt") > lo)
    if hi is not None:
        j = j.filter(F.col("h_gt") < hi)
    j = j.withColumn("error", F.col("h_recon") - F.col("h_gt")).withColumn("deficit", F.col("h_gt") - F.col("h_recon"))
    if max_spread is not None:
        j = j.withColumn("flat", (F.col("spread") <= max_spread) & (F.col("spread_gt") <= max_spread))
    return j


def coverage_fraction(recon: DataFrame, gt: DataFrame, by: list[str]) -> DataFrame:
    """Shared cells over reference cells per group."""
    on = [c for c in [*by, *CELL] if c in gt.columns]
    shared = recon.select(*by, *CELL).join(gt.select(*on).distinct(), on, "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("shared"))
    cells = recon.groupBy(*by).agg(F.count(F.lit(1)).alias("cells_recon")).join(shared, by, "left").na.fill(0, ["shared"])
    total_by = [c for c in by if c in gt.columns]
    totals = gt.groupBy(*total_by).agg(F.count(F.lit(1)).alias("gt_cells"))
    if total_by:
        out = cells.join(totals, total_by)
    else:
        out = cells.withColumn("_j", F.lit(0)).join(totals.withColumn("_j", F.lit(0)), "_j").drop("_j")
    return out.withColumn("coverage", F.col("shared") / F.greatest(F.col("gt_cells"), F.lit(1)))


def view_pairs(cells: DataFrame, by: list[str], camera: str = "camera", value: str = "h") -> DataFrame:
    """Cells seen by two cameras, once per camera pair. One row per cell and camera goes in, so a cell
    yields at most cameras^2/2 rows."""
    keys = [*by, *CELL]
    a = cells.select(*keys, F.col(camera).alias("cam_a"), F.col(value).alias("val_a"))
    b = cells.select(*keys, F.col(camera).alias("cam_b"), F.col(value).alias("val_b"))
    return a.join(b, keys).filter("cam_a < cam_b")


def pair_disagreement(cells: DataFrame, by: list[str], camera: str = "camera", value: str = "h", min_cells: int = 20, **kw) -> DataFrame:
    pairs = materialise(view_pairs(cells, by, camera, value).withColumn("diff", F.col("val_a") - F.col("val_b")), "pairs")
    keys = [*by, "cam_a", "cam_b"]
    agg = pairs.groupBy(*keys).agg(
        F.corr("val_a", "val_b").alias("correlation"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rms"))
    med = median(pairs, keys, "diff", "median", **kw)
    dev = quantiles(pairs, keys, F.abs("diff"), {"abs_median": 0.5, "abs_p95": 0.95}, **kw).drop("n")
    return agg.join(med, keys).join(dev, keys).filter(F.col("n") >= min_cells)


def field_decompose(cells: DataFrame, by: list[str], camera: str = "camera", value: str = "h", min_views: int = 2, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits height fields, less each view's median, into the shared part and each view's residual.

    Returns (per group, per view, deviations per cell and view).
    """
    keys = [*by, *CELL]
    seen = cells.groupBy(*keys).agg(F.count_distinct(camera).alias("_k")).filter(F.col("_k") >= min_views).select(*keys)
    common = cells.join(seen, keys, "left_semi")
    off = median(common, [*by, camera], value, "_off", **kw).drop("n")
    dev = materialise(common.join(off, [*by, camera]).withColumn("dev", F.col(value) - F.col("_off")), "deviations")
    shared = dev.groupBy(*keys).agg(F.avg("dev").alias("shared"))
    resid = dev.join(shared, keys).withColumn("resid", F.col("dev") - F.col("shared"))
    group = shared.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.stddev_pop("shared").alias("shared_sd")).join(
        resid.groupBy(*by).agg(F.sqrt(F.avg(F.col("resid") * F.col("resid"))).alias("per_view_rms")), by)
    view = resid.groupBy(*by, camera).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("resid") * F.col("resid"))).alias("rms"))
    return group, view, resid.select(*keys, camera, "dev", "resid")


def layer_report(points: DataFrame, by: list[str], camera: str, h: str, band: float, above: float, min_count: int = 50, **kw) -> tuple[DataFrame, DataFrame]:
    """Per view the median height near the plane and above it; per group the range and sample sd over views."""
    level = F.when(F.abs(F.col(h)) <= band, "belt").when(F.col(h) > above, "above")
    tagged = points.select(*by, camera, level.alias("level"), F.col(h).alias("h")).filter("level is not null")
    views = median(tagged, [*by, camera, "level"], "h", "median", **kw).filter(F.col("n") >= min_count)
    spread = views.groupBy(*by, "level").agg(
        F.count(F.lit(1)).alias("n_views"), (F.max("median") - F.min("median")).alias("range"), F.stddev_samp("median").alias("sd")
    ).filter("n_views > 1")
    return views, spread


def zbuffer(points: DataFrame, by: list[str], u: str = "u", v: str = "v", z: str = "z") -> DataFrame:
    """Nearest depth per pixel."""
    return points.filter(F.col(u).isNotNull()).groupBy(*by, F.floor(u).cast("long").alias("pu"), F.floor(v).cast("long").alias("pv")).agg(F.min(z).alias("zbuf"))


def zbuffer_overlap(
    ref: DataFrame, cam: DataFrame, by: list[str], width: int, height: int, gate: float = 0.15, dilate: int = 1,
    min_shared: int = 500, max_gated: float = 0.10, rid: str = "pid", **kw,
) -> DataFrame:
    """Reference points against another camera's z-buffer: the best of the neighbouring pixels by |dz|.

    Both inputs carry image position ``u v`` and depth ``z`` in the same camera.
    """
    inside = (F.col("pu") >= 0) & (F.col("pu") < width) & (F.col("pv") >= 0) & (F.col("pv") < height)
    buf = zbuffer(cam, by).filter(inside)
    r = ref.filter(F.col("u").isNotNull()).withColumn("pu", F.floor("u").cast("long")).withColumn("pv", F.floor("v").cast("long")).filter(inside)
    step = F.sequence(F.lit(-dilate), F.lit(dilate))
    spread = r.select(*by, rid, "z", "pu", "pv").withColumn("_du", F.explode(step)).withColumn("_dv", F.explode(step)).select(
        *by, rid, "z", F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("pu") + F.col("_du"))).alias("pu"),
        F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("pv") + F.col("_dv"))).alias("pv"))
    dz = F.col("z") - F.col("zbuf")
    best = spread.join(buf, [*by, "pu", "pv"]).groupBy(*by, rid).agg(F.min_by(dz, F.struct(F.abs(dz), -dz)).alias("dz"))
    frame = r.groupBy(*by).agg(F.count(F.lit(1)).alias("in_frame"))
    stats = best.groupBy(*by).agg(
        F.count(F.lit(1)).alias("with_sample"), F.count_if(F.abs("dz") < gate).alias("shared"),
        F.sqrt(F.avg(F.when(F.abs("dz") < gate, F.col("dz") * F.col("dz")))).alias("rms"))
    gated = best.filter(F.abs("dz") < gate)
    med = median(gated, by, "dz", "median", **kw).drop("n")
    dev = quantiles(gated, by, F.abs("dz"), {"abs_median": 0.5, "abs_p90": 0.9}, **kw).drop("n")
    out = frame.join(stats, by, "left").join(med, by, "left").join(dev, by, "left").na.fill(0, ["with_sample", "shared"])
    share = 1.0 - F.col("shared") / F.greatest(F.col("with_sample"), F.lit(1))
    return out.withColumn("gated_fraction", share).withColumn("reliable", (F.col("shared") >= min_shared) & (F.col("gated_fraction") <= max_gated))


def sample_depth(keypoints: DataFrame, pixels: DataFrame, by: list[str], width: int, height: int, method: str = "nearest", inverse: bool = False, kid: str = "kp_id") -> DataFrame:
    """Depth at keypoints: rounded and clipped pixel, or bilinear (NULL unless all four pixels have depth).

    Squares of four pixels are made first, so each keypoint meets one row; a small grid is not shuffled to.
    """
    value = F.col("z")
    grid = pixels.filter(F.col("z") > 0).select(*by, F.col("u").cast("long").alias("pu"), F.col("v").cast("long").alias("pv"), (1.0 / value if inverse else value).alias("_z"))
    if method == "nearest":
        grid = few(materialise(grid, "sample-grid"))
        k = keypoints.withColumn("pu", F.greatest(F.lit(0), F.least(F.lit(width - 1), F.rint("u"))).cast("long")).withColumn(
            "pv", F.greatest(F.lit(0), F.least(F.lit(height - 1), F.rint("v"))).cast("long"))
        out = k.join(grid, [*by, "pu", "pv"], "left").drop("pu", "pv")
        return out.withColumn("depth", 1.0 / F.col("_z") if inverse else F.col("_z")).drop("_z")
    u0, v0 = F.floor("u"), F.floor("v")
    fu, fv = F.col("u") - u0, F.col("v") - v0
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    of = F.explode(F.array(*[F.struct((F.col("pu") - a).alias("pu"), (F.col("pv") - b).alias("pv"), F.lit(i).alias("i")) for i, (a, b) in enumerate(corners)]))
    squares = grid.select(*by, "_z", of.alias("_c")).groupBy(*by, "_c.pu", "_c.pv").agg(
        F.count(F.lit(1)).alias("_k"), *[F.max(F.when(F.col("_c.i") == i, F.col("_z"))).alias(f"_z{i}") for i in range(4)])
    squares = few(materialise(squares.filter("_k = 4").drop("_k"), "sample-squares"))
    s = reduce(lambda x, y: x + y, [(fu if a else 1.0 - fu) * (fv if b else 1.0 - fv) * F.col(f"_z{i}") for i, (a, b) in enumerate(corners)])
    at = keypoints.withColumns({"pu": u0.cast("long"), "pv": v0.cast("long")}).join(squares, [*by, "pu", "pv"], "left")
    return at.withColumn("depth", 1.0 / s if inverse else s).select(*keypoints.columns, "depth")


def cross_view_residual(projected: DataFrame, pixels: DataFrame, by: list[str], width: int, height: int, pid: str = "pid", **kw) -> DataFrame:
    """Points of one view projected into another (``u v z``) against its bilinear inverse depth: median and p90 per group."""
    hit = sample_depth(projected.withColumnRenamed("z", "z_point"), pixels, by, width, height, "bilinear", True, pid).filter("depth is not null")
    r = hit.withColumn("resid", F.col("depth") - F.col("z_point"))
    med = median(r, by, "resid", "median", **kw)
    return med.join(quantiles(r, by, F.abs("resid"), {"abs_p90": 0.9}, **kw).drop("n"), by)


def render_reference(points: DataFrame, by: list[str], band: float, levels: int = 3, **kw) -> DataFrame:
    """Depth grid of a scan (``u v z``): median of the points within ``band`` of the nearest one.

    Pixels without a value take the half, then the quarter resolution grid.
    """
    fine = points.withColumn("pu", F.floor("u").cast("long")).withColumn("pv", F.floor("v").cast("long"))
    grids = []
    for level in range(levels):
        f = 2**level
        keyed = fine.select(*by, F.floor(F.col("pu") / f).cast("long").alias("pu"), F.floor(F.col("pv") / f).cast("long").alias("pv"), "z")
        front = keyed.groupBy(*by, "pu", "pv").agg(F.min("z").alias("_z0"))
        near = keyed.join(front, [*by, "pu", "pv"]).filter(F.col("z") <= F.col("_z0") + band)
        grids.append(median(near, [*by, "pu", "pv"], "z", "z", **kw).drop("n"))
    # every pixel of the coarsest occupied blocks is a candidate
    f = 2 ** (levels - 1)
    step = F.sequence(F.lit(0), F.lit(f - 1))
    out = grids[-1].select(*by, "pu", "pv").withColumn("_a", F.explode(step)).withColumn("_b", F.explode(step)).select(
        *by, (F.col("pu") * f + F.col("_a")).cast("long").alias("pu"), (F.col("pv") * f + F.col("_b")).cast("long").alias("pv"))
    value, source = None, None
    for level, g in enumerate(grids):
        s = 2**level
        g = g.select(*by, F.col("pu").alias("_pu"), F.col("pv").alias("_pv"), F.col("z").alias(f"_z{level}"))
        out = out.withColumn("_pu", F.floor(F.col("pu") / s).cast("long")).withColumn("_pv", F.floor(F.col("pv") / s).cast("long")).join(g, [*by, "_pu", "_pv"], "left").drop("_pu", "_pv")
    cols = [F.col(f"_z{i}") for i in range(levels)]
    value = F.coalesce(*cols)
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(i).cast("long")) for i, c in enumerate(cols)])
    return out.select(*by, "pu", "pv", value.alias("z"), source.alias("level")).filter("z is not null")


def corner_correspondences(a: DataFrame, b: DataFrame, by: list[str], min_corners: int, max_frames: int) -> DataFrame:
    """Same frame and corner id in both cameras, frames with enough shared corners, the first ``max_frames`` of them."""
    j = a.select(*by, "frame", "corner_id", F.col("u").alias("u_a"), F.col("v").alias("v_a")).join(
        b.select(*by, "frame", "corner_id", F.col("u").alias("u_b"), F.col("v").alias("v_b")), [*by, "frame", "corner_id"])
    frames = j.groupBy(*by, "frame").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_corners)
    from voxelloom.operators.groups import rank_in_group

    first = rank_in_group(frames, by, [("frame", "asc")], "frame_rank").filter(F.col("frame_rank") < max_frames)
    return j.join(first, [*by, "frame"])


def subset_visibility(cells: DataFrame, by: list[str], n_cams: int, cell: float, bit: str = "bit") -> DataFrame:
    """Area every camera subset sees with two views or more (one for a single camera).

    Cells collapse to a camera bit mask, masks to counts (2^n rows at most), and only those meet the subsets.
    """
    mask = cells.groupBy(*by, *CELL).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bit} as int))")).alias("mask"))
    counts = mask.groupBy(*by, "mask").agg(F.count(F.lit(1)).alias("_n"))
    sub = counts.withColumn("subset", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2**n_cams - 1).cast("long"))))
    size = F.bit_count("subset")
    seen = F.bit_count(F.col("mask").bitwiseAND(F.col("subset")))
    need = F.least(size, F.lit(2))
    return sub.groupBy(*by, "subset").agg(
        F.max(size).cast("long").alias("n_cams"), F.sum(F.when(seen >= need, F.col("_n")).otherwise(0)).alias("cells")
    ).withColumn("area", F.col("cells") * cell * cell)


def diff_runs(a: DataFrame, b: DataFrame, by: list[str], h: str, deck_band: float, above: float, **kw) -> DataFrame:
    """Two runs side by side per key: points, deck and above medians, range and sd of the medians' difference."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("points_" + tag))
        deck = median(df.filter(F.abs(F.col(h)) <= deck_band), by, h, "deck_" + tag, **kw).drop("n")
        top = median(df.filter(F.col(h) > above), by, h, "above_" + tag, **kw).drop("n")
        return n.join(deck, by, "left").join(top, by, "left")

    return side(a, "a").join(side(b, "b"), by, "full_outer").withColumn("deck_diff", F.col("deck_b") - F.col("deck_a")).withColumn(
        "above_diff", F.col("above_b") - F.col("above_a"))


SIDE = 4096  # source rows of a block of descriptors


def descriptor_match(src: DataFrame, dst: DataFrame, by: list[str], ratio: float = 0.75, pivots: int = 16, kid: str = "kp_id", desc: str = "desc") -> DataFrame:
    """Two nearest descriptors of the same group per source row, kept when d1 < ratio * d2; the lesser id of equals. Exact.

    Both sides are dealt by a hash of their ids into blocks of some ``SIDE`` rows (targets: four times that), and blocks of a
    group meet as matrices: products screen all pairs, the two nearest and what rounding leaves beside them are measured
    again. Rows without a descriptor match nothing. ``pivots`` is not used any more.
    """
    names = {"id": src.schema[kid].dataType, "other": dst.schema[kid].dataType}
    sizes = src.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("_sn")).join(dst.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / (4 * SIDE)).cast("int").alias("_dn")), by)
    sizes = few(materialise(sizes, "descriptor-sizes"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        key = F.pmod(F.xxhash64(kid), F.col(f"_{own}n")).cast("int").alias(f"_{own}b")
        rows = df.filter(F.col(desc).isNotNull()).join(sizes, by)
        return rows.select(*by, key, F.explode(F.sequence(F.lit(0), F.col(f"_{other}n") - 1)).alias(f"_{other}b"), F.col(kid).alias("id"), F.transform(desc, lambda x: x.cast("double")).alias("v")).select(*by, "_sb", "_db", "id", "v")

    schema = T.StructType([*[src.schema[c] for c in by], T.StructField("id", names["id"]), T.StructField("d", T.DoubleType()), T.StructField("other", names["other"])])
    keys = [*by, "_sb", "_db"]
    n = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (dealt(df, *way).repartition(n, *keys).groupBy(*keys) for df, way in ((src, ("s", "d")), (dst, ("d", "s"))))
    two = left.cogroup(right).applyInArrow(blocks.two_nearest(by, schema), schema)
    best = two.groupBy(*by, "id").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("_o"))  # two of each block
    first, second = F.get("_o", F.lit(0)), F.get("_o", F.lit(1))
    out = best.select(*by, F.col("id").alias(kid), first["other"].alias("match"), first["d"].alias("d1"), second["d"].alias("d2"))
    return out.filter(F.col("d1") < ratio * F.col("d2"))


def estimate_normals(points: DataFrame, by: list[str], radius: float, most: int = 30, pid: str = "pid", levels: int = 3) -> DataFrame:
    """``points`` with nx ny nz (nz >= 0): the axis of least spread of up to ``most`` nearest points within ``radius``, itself included.

    With fewer than three of them the normal is (0, 0, 1).
    """
    from voxelloom.operators.planes import plane_fit
    from voxelloom.operators.spatial import k_nearest

    p = materialise(points, "normal-points")
    near = k_nearest(p, p, by, radius, most, pid, pid, levels=levels)
    around = near.select(*by, pid, "nn").join(p.select(*by, F.col(pid).alias("nn"), "x", "y", "z"), [*by, "nn"])
    fit = plane_fit(around, [*by, pid]).select(*by, pid, "nx", "ny", "nz")
    up = {"nx": F.coalesce("nx", F.lit(0.0)), "ny": F.coalesce("ny", F.lit(0.0)), "nz": F.coalesce("nz", F.lit(1.0))}
    return p.join(fit, [*by, pid], "left").withColumns(up)


def point_to_plane(nn: DataFrame, by: list[str], reference: DataFrame, on: list[str], min_points: int = 1, **kw) -> DataFrame:
    """Nearest-neighbour residual along the reference normal, over the median range of the reference cloud.

    ``nn`` carries ``x y z``, the neighbour ``rx ry rz`` and its normal ``nx ny nz``; ``reference`` (``on`` x y z, ``on`` among
    ``by``) is the whole reference cloud. Groups of fewer than ``min_points`` pairs give nothing.
    """
    r = nn.withColumn("_r", F.abs((F.col("x") - F.col("rx")) * F.col("nx") + (F.col("y") - F.col("ry")) * F.col("ny") + (F.col("z") - F.col("rz")) * F.col("nz")))
    med = quantiles(r, by, "_r", {"p2plane_median": 0.5}, **kw).filter(F.col("n") >= min_points)
    rng = median(reference, on, F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), "range_median", **kw).drop("n")
    return med.join(rng, on).withColumn("relative", F.col("p2plane_median") / F.col("range_median"))


def match_planes_to_truth(planes: DataFrame, truth: DataFrame, by: list[str], tol: float, max_scale_dev: float, span_tol: float = 0.010, span_below: int = 3) -> DataFrame:
    """true = s * measured + t over the planes of a group: best candidate by (pairs matched, -rms).

    Candidates come from ordered pairs of both sides; a group holds a handful of planes and a handful
    of true surfaces. ``planes`` carry ``m``, ``truth`` carries ``label`` and ``t``.
    """
    on = [c for c in by if c in truth.columns]
    ms = planes.groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("_m"))
    ts = truth.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col("t"), F.col("label")))).alias("_t"))
    both = ms.join(ts, on) if on else ms.withColumn("_j", F.lit(0)).join(ts.withColumn("_j", F.lit(0)), "_j").drop("_j")
    cand = both.select("*", F.posexplode("_m").alias("_i", "_mi")).select("*", F.posexplode("_m").alias("_k", "_mk")).filter("_i <> _k and abs(_mk - _mi) > 1e-6")
    cand = cand.select("*", F.posexplode("_t").alias("_a", "_ta")).select("*", F.posexplode("_t").alias("_b", "_tb")).filter("_a <> _b")
    cand = cand.withColumn("_s", (F.col("_tb.t") - F.col("_ta.t")) / (F.col("_mk") - F.col("_mi"))).filter(F.abs(F.col("_s") - 1.0) <= max_scale_dev)
    cand = cand.withColumn("_o", F.col("_ta.t") - F.col("_s") * F.col("_mi")).withColumn("_cand", F.struct("_i", "_k", "_a", "_b"))
    fold = f"""aggregate(_m, cast(array() as array<struct<m:double,t:double,label:string>>), (acc, m) ->
      case when size(filter(_t, q -> not exists(acc, p -> p.t = q.t and p.label = q.label))) = 0 then acc
      when array_min(transform(filter(_t, q -> not exists(acc, p -> p.t = q.t and p.label = q.label)), q -> struct(abs(_s * m + _o - q.t) as e, q.t as t, q.label as label))).e <= {tol}
      then array_append(acc, named_struct('m', m,
        't', array_min(transform(filter(_t, q -> not exists(acc, p -> p.t = q.t and p.label = q.label)), q -> struct(abs(_s * m + _o - q.t) as e, q.t as t, q.label as label))).t,
        'label', array_min(transform(filter(_t, q -> not exists(acc, p -> p.t = q.t and p.label = q.label)), q -> struct(abs(_s * m + _o - q.t) as e, q.t as t, q.label as label))).label))
      else acc end)"""
    pairs = cand.withColumn("_p", F.expr(fold)).filter("size(_p) >= 2").select(*by, "_cand", F.explode("_p").alias("_p")).select(*by, "_cand", "_p.*")
    fit = pairs.groupBy(*by, "_cand").agg(
        F.count(F.lit(1)).alias("n_matched"), F.regr_slope("t", "m").alias("scale"), F.regr_intercept("t", "m").alias("shift"),
        (F.max("m") - F.min("m")).alias("measured_span"), (F.max("t") - F.min("t")).alias("truth_span"), F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    fit = fit.filter(F.abs(F.col("scale") - 1.0) <= max_scale_dev)
    if span_tol > 0:
        fit = fit.filter((F.col("n_matched") >= span_below) | (F.abs(F.col("measured_span") - F.col("truth_span")) <= span_tol))
    r = F.col("scale") * F.col("m") + F.col("shift") - F.col("t")
    scored = pairs.join(fit, [*by, "_cand"]).groupBy(*by, "_cand").agg(
        F.sqrt(F.avg(r * r)).alias("rms"), F.max(F.abs(r)).alias("worst"), *[F.first(c).alias(c) for c in ("n_matched", "scale", "shift", "measured_span", "truth_span", "labels")]
    ).filter(F.col("worst") <= tol)
    cols = ["n_matched", "scale", "shift", "rms", "worst", "measured_span", "truth_span", "labels"]
    return scored.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(F.col("n_matched"), -F.col("rms"), F.col("_cand"))).alias("_b")).select(*by, "_b.*")


def order_preserving_assignment(layers: DataFrame, truth: DataFrame, by: list[str], k: int, slope_lo: float = 0.2, slope_hi: float = 4.0, x: str = "x", y: str = "y") -> DataFrame:
    """Monotone assignments of a group's ``k`` resolved layers onto the true layers, ranked by rms of the
    line y = a x + b, slopes outside [lo, hi] dropped. Both sides hold a few layers per group."""
    on = [c for c in by if c in truth.columns]
    xs = layers.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(x).cast("double"))).alias("_x")).filter(F.size("_x") == k)
    ys = truth.groupBy(*on).agg(F.array_sort(F.collect_list(F.col(y).cast("double"))).alias("_y"))
    state = (xs.join(ys, on) if on else xs.withColumn("_j", F.lit(0)).join(ys.withColumn("_j", F.lit(0)), "_j").drop("_j")).withColumn("_idx", F.expr("cast(array() as array<int>)"))
    for step in range(k):
        lowest = F.coalesce(F.try_element_at("_idx", F.lit(-1)), F.lit(-1)) + 1
        highest = F.size("_y") - (k - step)
        state = state.withColumn("_n", F.explode(F.when(highest >= lowest, F.sequence(lowest, highest)).otherwise(F.expr("cast(array() as array<int>)")))).withColumn("_idx", F.array_append("_idx", F.col("_n"))).drop("_n")
    rows = state.withColumn("_q", F.arrays_zip(F.col("_x").alias("xx"), F.transform("_idx", lambda i: F.get("_y", i)).alias("yy"))).select(*by, "_idx", F.explode("_q").alias("_q"))
    px, py = F.col("_q.xx"), F.col("_q.yy")
    fit = rows.groupBy(*by, "_idx").agg(
        F.regr_slope(py, px).alias("slope"), F.regr_intercept(py, px).alias("intercept"),
        F.sqrt(F.greatest(F.regr_syy(py, px) - F.regr_sxy(py, px) * F.regr_sxy(py, px) / F.regr_sxx(py, px), F.lit(0.0)) / F.count(F.lit(1))).alias("rms"))
    order = Window.partitionBy(*by).orderBy("rms", "_idx")
    return fit.filter(F.col("slope").between(slope_lo, slope_hi)).withColumn("rank", (F.row_number().over(order) - 1).cast("long")).withColumnRenamed("_idx", "assignment")


def gap_ratio(layers: DataFrame, by: list[str], x: str, order: str) -> DataFrame:
    """Last gap over first gap of a group's sorted layers; NULL below three layers."""
    s = layers.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(x).cast("double"))).alias("_x"))
    last, first = F.element_at("_x", -1) - F.element_at("_x", -2), F.get("_x", F.lit(1)) - F.get("_x", F.lit(0))
    return s.select(*by, F.when((F.size("_x") >= 3) & (first > 0), last / first).alias(order))
