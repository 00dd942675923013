"""Voxel, cell and area aggregates over point tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.groups import median, nearest, order_statistics, quantiles
from voxelloom.session import few, materialise


def cell_floor(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("long")


def belt_cell(c: str | Column, half: float | Column, cell: float) -> Column:
    """Belt raster index: truncated offset from the border, clipped to the last cell."""
    x = F.col(c) if isinstance(c, str) else c
    half = half if isinstance(half, Column) else F.lit(float(half))
    last = F.floor(2.0 * half / cell)
    return F.greatest(F.lit(0), F.least(last, F.floor((x + half) / cell))).cast("long")


def voxel_first(points: DataFrame, by: list[str], size: float, pid: str = "pid", xyz=("x", "y", "z")) -> DataFrame:
    """The lowest-index point of each voxel, with all its columns."""
    keys = {f"v{a}": cell_floor(c, size) for a, c in zip("xyz", xyz)}
    rest = [c for c in points.columns if c not in by]
    return (
        points.withColumns(keys)
        .groupBy(*by, *keys)
        .agg(F.min_by(F.struct(*rest), F.col(pid)).alias("_p"))
        .select(*by, "_p.*")
    )


def voxel_mean(points: DataFrame, by: list[str], size: float, xyz=("x", "y", "z"), extra: tuple[str, ...] = ()) -> DataFrame:
    keys = {f"v{a}": cell_floor(c, size) for a, c in zip("xyz", xyz)}
    return (
        points.withColumns(keys)
        .groupBy(*by, *keys)
        .agg(*[F.avg(c).alias(c) for c in (*xyz, *extra)], F.count(F.lit(1)).alias("n"))
    )


def on_belt(points: DataFrame, half_u: float, half_v: float, u: str = "u", v: str = "v") -> DataFrame:
    return points.filter((F.abs(F.col(u)) <= half_u) & (F.abs(F.col(v)) <= half_v))


def height_raster(
    points: DataFrame, by: list[str], cell: float, half_u: float, half_v: float, margin: float = 0.05, h: str = "h", **kw
) -> DataFrame:
    """Exact median height per belt cell."""
    hu, hv = half_u + margin, half_v + margin
    cells = on_belt(points, hu, hv).select(
        *by, belt_cell("u", hu, cell).alias("iu"), belt_cell("v", hv, cell).alias("iv"), F.col(h).alias("h")
    )
    return median(cells, [*by, "iu", "iv"], "h", "h", **kw)


def height_raster_spread(
    points: DataFrame, by: list[str], cell: float, half_u: float, half_v: float, cross: float | None = None,
    margin: float = 0.05, min_spread_n: int = 8, **kw,
) -> DataFrame:
    """Median height, position and p84-p16 height spread per belt cell."""
    hu, hv = half_u + margin, (half_v if cross is None else cross) + margin
    cells = on_belt(points, hu, hv).select(
        *by, belt_cell("u", hu, cell).alias("iu"), belt_cell("v", hv, cell).alias("iv"), "u", "v", "h"
    )
    keys = [*by, "iu", "iv"]
    long = cells.unpivot(keys, ["h", "u", "v"], "what", "val")
    q = quantiles(long, [*keys, "what"], "val", {"p16": 0.16, "p50": 0.5, "p84": 0.84}, **kw)
    return q.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("what") == c, F.col("p50"))).alias(c) for c in ("h", "u", "v")],
        F.max(F.when(F.col("what") == "h", F.when(F.col("n") >= min_spread_n, F.col("p84") - F.col("p16")).otherwise(0.0))).alias("spread"),
    )


def plane_field(points: DataFrame, by: list[str], cell: float, min_count: int, **kw) -> DataFrame:
    """Median height per floor-indexed cell with at least ``min_count`` points."""
    cells = points.select(*by, cell_floor("u", cell).alias("iu"), cell_floor("v", cell).alias("iv"), "h")
    return median(cells, [*by, "iu", "iv"], "h", "h", **kw).filter(F.col("n") >= min_count)


def cell_surface(points: DataFrame, by: list[str], cell: float, min_points: int, **kw) -> DataFrame:
    cells = points.select(*by, cell_floor("u", cell).alias("iu"), cell_floor("v", cell).alias("iv"), "h")
    q = quantiles(cells, [*by, "iu", "iv"], "h", {"p10": 0.1, "h": 0.5, "p90": 0.9}, **kw)
    return q.filter(F.col("n") >= min_points).select(*by, "iu", "iv", "n", "h", (F.col("p90") - F.col("p10")).alias("spread"))


def envelope(points: DataFrame, by: list[str], cell: float, pct: float, **kw) -> DataFrame:
    """Nearest-rank percentile height per cell."""
    cells = points.select(*by, cell_floor("u", cell).alias("iu"), cell_floor("v", cell).alias("iv"), "h")
    return order_statistics(cells, [*by, "iu", "iv"], "h", {"h": nearest(pct)}, **kw)


def multi_view_coverage(
    points: DataFrame, by: list[str], cell: float, half_u: float, half_v: float, lo: float, hi: float,
    camera: str = "camera", domain: DataFrame | None = None,
) -> DataFrame:
    """Area seen by at least one, two and three cameras; ``domain`` (by?, iu, iv) restricts the cells."""
    cells = (
        on_belt(points, half_u, half_v)
        .filter((F.col("h") > lo) & (F.col("h") < hi))
        .select(*by, belt_cell("u", half_u, cell).alias("iu"), belt_cell("v", half_v, cell).alias("iv"), camera)
        .groupBy(*by, "iu", "iv")
        .agg(F.count_distinct(camera).alias("views"))
    )
    area = cell * cell
    if domain is not None:
        on = [c for c in [*by, "iu", "iv"] if c in domain.columns]
        cells = cells.join(domain.select(*on).distinct(), on, "left_semi")
        total_by = [c for c in by if c in domain.columns]
        totals = domain.select(*on).distinct().groupBy(*total_by).agg((F.count(F.lit(1)) * area).alias("belt_m2"))
    out = cells.groupBy(*by).agg(*[(F.count_if(F.col("views") >= k) * area).alias(f"mv{k}_m2") for k in (1, 2, 3)])
    if domain is None:
        return out.withColumn("belt_m2", F.lit(4.0 * half_u * half_v))
    return out.join(totals, total_by) if total_by else out.withColumn("_j", F.lit(0)).join(
        totals.withColumn("_j", F.lit(0)), "_j").drop("_j")


def layer_area(points: DataFrame, by: list[str], z: str, z0: float, tol: float, cell: float = 0.05, min_points: int = 50, xy=("x", "y")) -> DataFrame:
    """Area of the distinct cells holding points within ``tol`` of ``z0``; 0 below ``min_points``."""
    band = F.abs(F.col(z) - z0) < tol
    cells = points.groupBy(*by, *[cell_floor(c, cell).alias(f"c{i}") for i, c in enumerate(xy)]).agg(
        F.count_if(band).alias("k")
    )
    return cells.groupBy(*by).agg(
        F.sum("k").alias("n"),
        F.when(F.sum("k") >= min_points, F.count_if(F.col("k") > 0) * cell * cell).otherwise(0.0).alias("area_m2"),
    )


def residual_grid(pixels: DataFrame, by: list[str], value: str, width: float, height: float, nx: int, ny: int, min_count: int = 50, **kw) -> DataFrame:
    """Median residual per image block with at least ``min_count`` pixels."""
    blocks = pixels.select(
        *by,
        F.least(F.lit(nx - 1), F.floor(F.col("u") * nx / width)).cast("long").alias("bx"),
        F.least(F.lit(ny - 1), F.floor(F.col("v") * ny / height)).cast("long").alias("by_"),
        F.col(value).alias("r"),
    )
    return median(blocks, [*by, "bx", "by_"], "r", "median", **kw).filter(F.col("n") >= min_count)


def spatial_structure(grid: DataFrame, by: list[str], **kw) -> DataFrame:
    """p95 - p5 of the block medians, and their MAD sigma."""
    grid = materialise(grid, "grid")
    q = quantiles(grid, by, "median", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, **kw).withColumnRenamed("n", "blocks")
    dev = grid.join(q.select(*by, "p50"), by).withColumn("dev", F.abs(F.col("median") - F.col("p50")))
    mad = median(dev, by, "dev", "mad", **kw)
    return q.join(mad.drop("n"), by).select(
        *by, "blocks", (F.col("p95") - F.col("p5")).alias("structure"), (F.col("mad") * 1.4826).alias("mad_sigma")
    )


def depth_quantile_bins(df: DataFrame, by: list[str], depth: str, value: str, bins: int, **kw) -> DataFrame:
    """Median residual between depth quantile edges, and the last-minus-first trend."""
    # equal pairs of depth and residual are one row with a count, met by the few edges without a shuffle
    df = materialise(df.groupBy(*by, depth, value).agg(F.count(F.lit(1)).alias("_times")), "depth-pairs")
    edges = few(materialise(quantiles(df, by, depth, {f"e{i}": i / bins for i in range(bins + 1)}, count="_times", **kw).drop("n"), "depth-edges"))
    inner = [F.when(F.col(depth) >= F.col(f"e{i}"), 1).otherwise(0) for i in range(1, bins)]
    which = inner[0]
    for c in inner[1:]:
        which = which + c
    tagged = df.join(edges, by).select(*by, which.cast("long").alias("bin"), F.col(value).alias("r"), "_times")
    med = median(tagged, [*by, "bin"], "r", "median", count="_times", **kw)
    ends = med.groupBy(*by).agg((F.max_by("median", "bin") - F.min_by("median", "bin")).alias("trend"))
    return med.join(ends, by)


def height_census(points: DataFrame, by: list[str], bin_size: float, cameras: list[str], camera: str = "camera", h: str = "h") -> DataFrame:
    return (
        points.groupBy(*by, F.floor(F.col(h) / bin_size).cast("long").alias("bin"))
        .pivot(camera, cameras)
        .agg(F.count(F.lit(1)))
        .na.fill(0, cameras)
    )


def histogram(points: DataFrame, by: list[str], value: str, bin_size: float) -> DataFrame:
    return points.groupBy(*by, F.floor(F.col(value) / bin_size).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(hist: DataFrame, by: list[str]) -> DataFrame:
    """Adds the empty bins between a group's first and last bin."""
    span = hist.groupBy(*by).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    full = span.select(*by, F.explode(F.sequence("_lo", "_hi")).alias("bin"))
    return full.join(hist, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def smooth_histogram(hist: DataFrame, by: list[str], width: int = 5) -> DataFrame:
    """Boxcar of ``width`` bins, zero padded; the bins of a histogram are few however many rows it counts."""
    half = width // 2
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(-half, width - 1 - half)
    return dense_histogram(hist, by).withColumn("smooth", F.sum("n").over(w) / width)


def histogram_peaks(smoothed: DataFrame, by: list[str], min_fraction: float, min_gap: int, top: int | None = None) -> DataFrame:
    """Greedy peaks: bins at or above ``min_fraction`` of the maximum, strongest first, kept when at
    least ``min_gap`` bins from every peak already kept. The fold runs over histogram bins only."""
    top_value = smoothed.groupBy(*by).agg(F.max("smooth").alias("_max"))
    cand = (
        smoothed.join(top_value, by)
        .filter(F.col("smooth") >= min_fraction * F.col("_max"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("smooth")).alias("s"), "bin", "n"))).alias("_c"))
    )
    kept = cand.withColumn(
        "_k",
        F.expr(
            f"""aggregate(_c, slice(_c, 1, 0), (acc, x) ->
            if(exists(acc, k -> abs(k.bin - x.bin) < {int(min_gap)}), acc, array_append(acc, x)))"""
        ),
    )
    if top:
        kept = kept.withColumn("_k", F.slice("_k", 1, top))
    return kept.select(*by, F.posexplode("_k").alias("rank", "_p")).select(
        *by, F.col("rank").cast("long").alias("rank"), F.col("_p.bin").alias("bin"), F.col("_p.n").alias("n"), (-F.col("_p.s")).alias("smooth")
    )


def suppressed_peaks(hist: DataFrame, by: list[str], radius: int, top: int, min_count: int = 1) -> DataFrame:
    """Repeatedly take the fullest bin, sum the counts within ``radius`` and clear them."""
    bins = hist.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("_h"))
    step = F.expr(
        f"""aggregate(sequence(1, {int(top)}),
        named_struct('left', _h, 'out', cast(array() as array<struct<bin:bigint,n:bigint>>)),
        (st, i) -> if(size(st.left) = 0, st,
          named_struct(
            'left', filter(st.left, b -> abs(b.bin - array_max(transform(st.left, c -> struct(c.n, -c.bin as m, c.bin))).bin) > {int(radius)}),
            'out', array_append(st.out, named_struct(
               'bin', array_max(transform(st.left, c -> struct(c.n, -c.bin as m, c.bin))).bin,
               'n', aggregate(filter(st.left, b -> abs(b.bin - array_max(transform(st.left, c -> struct(c.n, -c.bin as m, c.bin))).bin) <= {int(radius)}), 0L, (a, b) -> a + b.n))))),
        st -> st.out)"""
    )
    return (
        bins.select(*by, F.posexplode(step).alias("rank", "p"))
        .select(*by, F.col("rank").cast("long").alias("rank"), "p.*")
        .filter(F.col("n") >= min_count)
    )


def merge_peaks(peaks: DataFrame, by: list[str], gap: float, centre: str = "z", weight: str = "n") -> DataFrame:
    """Sorted sweep that joins a peak to the previous one when within ``gap`` of its running centre."""
    arr = peaks.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(centre).cast("double").alias("z"), F.col(weight).cast("double").alias("n")))).alias("_p")
    )
    merged = F.expr(
        f"""aggregate(slice(_p, 2, size(_p)), slice(_p, 1, 1), (acc, x) ->
        if(x.z - element_at(acc, -1).z <= {float(gap)},
           array_append(slice(acc, 1, size(acc) - 1), named_struct(
              'z', (element_at(acc, -1).z * element_at(acc, -1).n + x.z * x.n) / (element_at(acc, -1).n + x.n),
              'n', element_at(acc, -1).n + x.n)),
           array_append(acc, x)))"""
    )
    return arr.select(*by, F.posexplode(merged).alias("rank", "p")).select(*by, F.col("rank").cast("long").alias("rank"), "p.z", "p.n")


def dense_bands(hist: DataFrame, by: list[str], bin_size: float, fraction: float = 0.15) -> DataFrame:
    """Runs of adjacent bins above ``fraction`` of the fullest one, with their weighted centre."""
    top_value = hist.groupBy(*by).agg(F.max("n").alias("_max"))
    w = Window.partitionBy(*by).orderBy("bin")
    return (
        hist.join(top_value, by)
        .filter(F.col("n") > fraction * F.col("_max"))
        .withColumn("_island", F.col("bin") - F.row_number().over(w))
        .groupBy(*by, "_island")
        .agg(
            F.min("bin").alias("bin_lo"),
            F.max("bin").alias("bin_hi"),
            F.sum("n").alias("n"),
            (F.sum((F.col("bin") + 0.5) * bin_size * F.col("n")) / F.sum("n")).alias("centre"),
        )
        .drop("_island")
    )


def density_modes(points: DataFrame, by: list[str], value: str, bandwidth: float, grid: float, min_prominence: float, reach: float = 4.0) -> DataFrame:
    """Gaussian kernel density on a fixed grid, and its local maxima by prominence.

    Points are counted per fine bin first; only bins meet kernel offsets.
    """
    k = int(reach * bandwidth / grid)
    hist = histogram(points, by, value, grid)
    spread = hist.select(*by, "n", F.col("bin").alias("_src"), F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("_o"))
    dens = spread.groupBy(*by, (F.col("_src") + F.col("_o")).alias("bin")).agg(
        F.sum(F.col("n") * F.exp(-0.5 * F.pow(F.col("_o") * grid / bandwidth, 2))).alias("density")
    )
    w = Window.partitionBy(*by).orderBy("bin")
    local = dens.withColumn("_p", F.lag("density", 1, 0.0).over(w)).withColumn("_q", F.lead("density", 1, 0.0).over(w))
    tops = local.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "density"))).alias("_all"), F.max("density").alias("_max"))
    peaks = local.filter("density > _p and density >= _q").select(*by, "bin", "density").join(tops, by)
    # the saddle on each side: lowest density before a higher bin is met
    side = """aggregate({seq}, named_struct('lo', density, 'stop', false), (s, b) ->
        if(s.stop or b.density > density, named_struct('lo', s.lo, 'stop', true),
           named_struct('lo', least(s.lo, b.density), 'stop', false)), s -> if(s.stop, s.lo, 0D))"""
    left = F.expr(side.format(seq="reverse(filter(_all, b -> b.bin < bin))"))
    right = F.expr(side.format(seq="filter(_all, b -> b.bin > bin)"))
    return (
        peaks.withColumn("prominence", F.col("density") - F.greatest(left, right))
        .filter(F.col("prominence") >= min_prominence * F.col("_max"))
        .select(*by, "bin", ((F.col("bin") + 0.5) * grid).alias("centre"), (F.col("density") / F.col("_max")).alias("relative"),
                (F.col("prominence") / F.col("_max")).alias("prominence"))
    )


def cloud_profile(points: DataFrame, by: list[str], h: str, lo: float, hi: float, **kw) -> DataFrame:
    """Height percentiles 1 5 25 50 75 95 99 and the share of points inside [lo, hi]."""
    q = quantiles(points, by, h, {f"p{int(p * 100)}": p for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}, **kw)
    share = points.groupBy(*by).agg(
        (F.count_if((F.col(h) >= lo) & (F.col(h) <= hi)) / F.count(h)).alias("in_band")
    )
    return q.join(share, by)


def clipped_histogram(points: DataFrame, by: list[str], h: str, lo: float, hi: float, bins: int = 32) -> DataFrame:
    width = (hi - lo) / bins
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(h) - lo) / width))).cast("long")
    return points.filter(F.col(h).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def band_probe(joined: DataFrame, by: list[str], lo: float, hi: float, cell_bins: int = 12, span: float = 1.0, **kw) -> DataFrame:
    """Cells whose reference height lies in [lo, hi): count, recon median, deficit median, occupied sub-bins."""
    band = joined.filter((F.col("h_gt") >= lo) & (F.col("h_gt") < hi))
    q = quantiles(
        band.select(*by, F.explode(F.array(
            F.struct(F.lit("recon").alias("what"), F.col("h_recon").alias("val")),
            F.struct(F.lit("deficit").alias("what"), (F.col("h_gt") - F.col("h_recon")).alias("val")))).alias("_e")).select(*by, "_e.*"),
        [*by, "what"], "val", {"m": 0.5}, **kw)
    wide = q.groupBy(*by).agg(
        F.max("n").alias("cells"),
        F.max(F.when(F.col("what") == "recon", F.col("m"))).alias("recon_median"),
        F.max(F.when(F.col("what") == "deficit", F.col("m"))).alias("deficit_median"),
    )
    occ = band.groupBy(*by).agg(
        F.count_distinct(F.greatest(F.lit(0), F.least(F.lit(cell_bins - 1), F.floor(F.col("h_recon") / (span / cell_bins))))).alias("bins_hit")
    )
    return wide.join(occ, by).withColumn(
        "verdict", F.when(F.col("bins_hit") * 2 >= cell_bins, "spread").when(F.col("bins_hit") <= 2, "single layer").otherwise("partial")
    )


def select_band_cells(points: DataFrame, cells: DataFrame, cell: float, half_u: float, half_v: float) -> tuple[DataFrame, DataFrame]:
    """Points whose belt cell is selected, and those whose cell is not."""
    keyed = points.withColumn("iu", belt_cell("u", half_u, cell)).withColumn("iv", belt_cell("v", half_v, cell))
    on = [c for c in cells.columns if c in keyed.columns]
    chosen = cells.select(*on).distinct()
    return keyed.join(chosen, on, "left_semi"), keyed.join(chosen, on, "left_anti")
