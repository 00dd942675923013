"""Plane fits from distributed moments; eigenvectors are taken of one 3x3 matrix per group.

Plane columns: ``nx ny nz d`` with n.x + d = 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.functions.geometry import Vec, clamp, cross, dot, minus, norm, vec
from voxelloom.operators.groups import any_hot, median, quantiles
from voxelloom.operators.robust import _group_median
from voxelloom.session import few, materialise


WIDE = 500  # rows of a table with an array of hypotheses on each that may be broadcast

AXIS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("nx", "ny", "nz", "e0", "e1", "e2", "ax", "ay", "az")])


@F.pandas_udf(AXIS)
def smallest_axis(cov: pd.Series) -> pd.DataFrame:
    """Eigenvalues ascending, the axis of the smallest (nz >= 0) and of the largest, of 3x3 covariances."""
    m = np.stack([np.asarray(c, float).reshape(3, 3) for c in cov]) if len(cov) else np.zeros((0, 3, 3))
    w, v = np.linalg.eigh(np.nan_to_num(m))
    n = v[:, :, 0]
    n = n * np.where(n[:, 2] < 0, -1.0, 1.0)[:, None]
    return pd.DataFrame(np.column_stack([n, w, v[:, :, 2]]), columns=["nx", "ny", "nz", "e0", "e1", "e2", "ax", "ay", "az"])


def _covariance(x: str, y: str, z: str) -> Column:
    names = (x, y, z)
    return F.array(*[F.covar_pop(a, b) for a in names for b in names])


def plane_fit(points: DataFrame, by: list[str], xyz=("x", "y", "z"), min_count: int = 3) -> DataFrame:
    """Total least squares plane per group with its rms."""
    x, y, z = xyz
    agg = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), _covariance(x, y, z).alias("_cov")
    ).filter(F.col("n") >= min_count)
    e = agg.withColumn("_e", smallest_axis("_cov"))
    return e.select(
        *by, "n", "_e.nx", "_e.ny", "_e.nz",
        (-(F.col("_e.nx") * F.col("mx") + F.col("_e.ny") * F.col("my") + F.col("_e.nz") * F.col("mz"))).alias("d"),
        F.sqrt(F.greatest(F.col("_e.e0"), F.lit(0.0))).alias("rms"), "mx", "my", "mz",
    )


def signed_distance(xyz=("x", "y", "z")) -> Column:
    return dot(vec("nx", "ny", "nz"), vec(*xyz)) + F.col("d")


def tilt_deg(a: Vec, b: Vec) -> Column:
    return F.degrees(F.acos(clamp(F.abs(dot(a, b)), 0.0, 1.0)))


def plane_fit_tukey(points: DataFrame, by: list[str], iters: int = 6, c: float = 2.5, min_count: int = 8, xyz=("x", "y", "z")) -> DataFrame:
    """Tukey bisquare reweighted plane per group."""
    data = materialise(points.select(*by, *[F.col(k).cast("double").alias(n) for k, n in zip(xyz, "xyz")]).dropna(subset=list("xyz")), "plane-rows")
    hot = any_hot(data, by)
    fit: DataFrame | None = None
    for _ in range(max(1, iters)):
        if fit is None:
            weighed = data.withColumn("_w", F.lit(1.0))
            origin = data.groupBy(*by).agg(*[F.avg(k).alias("o" + k) for k in "xyz"])
        else:
            resid = data.join(few(fit.select(*by, "nx", "ny", "nz", "d")), by).withColumn("_r", signed_distance())
            s = _group_median(resid, by, F.abs("_r"), "_med", hot)
            t = F.col("_r") / (c * F.greatest(F.col("_med") * 1.4826, F.lit(1e-9)))
            t = clamp(t, -1.0, 1.0)
            weighed = resid.join(s, by).withColumn("_w", F.pow(1.0 - t * t, 2)).select(*by, "x", "y", "z", "_w")
            origin = fit.select(*by, F.col("mx").alias("ox"), F.col("my").alias("oy"), F.col("mz").alias("oz"))
        rel = weighed.join(origin, by).select(*by, "ox", "oy", "oz", "_w", *[(F.col(k) - F.col("o" + k)).alias(k) for k in "xyz"])
        w = F.col("_w")
        sums = rel.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), *[F.first("o" + k).alias("o" + k) for k in "xyz"],
            *[(F.sum(w * F.col(k)) / F.sum(w)).alias("s" + k) for k in "xyz"],
            *[(F.sum(w * F.col(a) * F.col(b)) / F.sum(w)).alias("s" + a + b) for a in "xyz" for b in "xyz" if a <= b],
        ).filter(F.col("n") >= min_count)
        cov = F.array(*[F.col("s" + min(a, b) + max(a, b)) - F.col("s" + a) * F.col("s" + b) for a in "xyz" for b in "xyz"])
        e = sums.withColumn("_e", smallest_axis(cov)).withColumns({"m" + k: F.col("o" + k) + F.col("s" + k) for k in "xyz"})
        fit = materialise(
            e.select(*by, "n", "_e.nx", "_e.ny", "_e.nz", "mx", "my", "mz").withColumn(
                "d", -(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))),
            "plane-fit",
        )
    return fit


def hypotheses(points: DataFrame, by: list[str], trials: int, seed: int, pid: str, xyz=("x", "y", "z")) -> DataFrame:
    """``trials`` planes per group through point triples chosen by hash: ``by..., hyp array<struct>``.

    A hash threshold keeps about six candidates per wanted triple before anything is ranked, so the
    window sees a bounded handful of rows however large the group is.
    """
    sizes = few(materialise(points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "ransac-sizes"))
    h = F.pmod(F.xxhash64(F.lit(seed), pid), F.lit(1 << 40)).cast("double") / float(1 << 40)
    picked = points.join(sizes, by).withColumn("_h", h).filter(F.col("_h") < F.lit(18.0 * trials + 60.0) / F.col("_n"))
    order = Window.partitionBy(*by).orderBy("_h", pid)
    triples = (
        picked.withColumn("_k", F.row_number().over(order) - 1)
        .filter(F.col("_k") < 3 * trials)
        .groupBy(*by, F.floor(F.col("_k") / 3).cast("int").alias("trial"))
        .agg(F.array_sort(F.collect_list(F.struct("_k", *[F.col(c).cast("double").alias(n) for c, n in zip(xyz, "xyz")]))).alias("t"))
        .filter("size(t) = 3")
    )
    p = [tuple(F.col("t")[i][k] for k in "xyz") for i in range(3)]
    n = cross(minus(p[1], p[0]), minus(p[2], p[0]))
    length = norm(n)
    flip = F.when(n[2] < 0, -1.0).otherwise(1.0)
    planes = triples.filter(length > 1e-12).select(
        *by, "trial", *[(n[i] / length * flip).alias("n" + "xyz"[i]) for i in range(3)], *[p[0][i].alias("p" + "xyz"[i]) for i in range(3)]
    ).withColumn("d", -dot(vec("nx", "ny", "nz"), vec("px", "py", "pz")))
    return planes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("trial", "nx", "ny", "nz", "d"))).alias("hyp"))


def best_hypothesis(points: DataFrame, hyp: DataFrame, by: list[str], tol: float, xyz=("x", "y", "z")) -> DataFrame:
    """The hypothesis with most inliers of each group, the first of equals.

    A point is tested against its group's hypotheses inside its task and only counts leave it. One column for each
    hypothesis would make a method too long to be compiled.
    """
    x, y, z = (F.col(c) for c in xyz)
    tested = points.join(hyp, by).select(*by, *xyz, F.posexplode("hyp").alias("_i", "_e"))
    near = tested.filter(F.abs(F.col("_e.nx") * x + F.col("_e.ny") * y + F.col("_e.nz") * z + F.col("_e.d")) <= tol)
    fullest = near.groupBy(*by, "_i").agg(F.count(F.lit(1)).alias("_c")).groupBy(*by).agg(F.min(F.struct((-F.col("_c")).alias("c"), "_i")).alias("_m"))
    total = points.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    best = hyp.join(total, by).join(fullest, by, "left").withColumn("_b", F.get("hyp", F.coalesce("_m._i", F.lit(0))))
    return best.select(*by, "total", F.coalesce(-F.col("_m.c"), F.lit(0).cast("long")).alias("inliers"), "_b.nx", "_b.ny", "_b.nz", "_b.d")


def plane_ransac(
    points: DataFrame, by: list[str], tol: float = 0.01, trials: int = 64, seed: int = 0, pid: str = "pid", refits: int = 3, xyz=("x", "y", "z")
) -> DataFrame:
    """Best of ``trials`` three-point planes by inliers, then refits on its inliers."""
    names = [F.col(c).cast("double").alias(n) for c, n in zip(xyz, "xyz")]
    data = materialise(points.select(*by, pid, *names), "ransac-rows")
    hyp = few(materialise(hypotheses(data, by, trials, seed, pid), "ransac-hypotheses"), WIDE)
    plane = materialise(best_hypothesis(data, hyp, by, tol), "ransac-plane")
    for _ in range(refits):
        near = data.join(few(plane.select(*by, "nx", "ny", "nz", "d")), by).filter(F.abs(signed_distance()) <= tol).select(*by, "x", "y", "z")
        fit = plane_fit(near, by).select(*by, F.col("n").alias("inliers"), "nx", "ny", "nz", "d")
        plane = materialise(plane.select(*by, "total").join(fit, by), "ransac-plane")
    return plane


def peel_planes(
    points: DataFrame, by: list[str], count: int, tol: float, min_fraction: float = 0.15, distance: tuple[float, float] | None = None, **kw
) -> tuple[DataFrame, DataFrame]:
    """Up to ``count`` planes, each fitted to what the ones before left. Returns (planes, discarded).

    A group stops when its best plane holds less than ``min_fraction`` of all its points; planes whose
    offset lies outside ``distance`` are recorded as discarded and their points removed all the same.
    """
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    left = points
    taken: DataFrame | None = None
    for rank in range(count):
        plane = plane_ransac(left, by, tol=tol, **kw).join(sizes, by).withColumn("rank", F.lit(rank).cast("long"))
        plane = materialise(plane.filter(F.col("inliers") >= min_fraction * F.col("_all")).withColumn(
            "fraction", F.col("inliers") / F.col("_all")).drop("_all"), "peeled")
        taken = plane if taken is None else taken.unionByName(plane)
        gone = left.join(plane.select(*by, "nx", "ny", "nz", "d"), by)
        left = materialise(gone.filter(F.abs(signed_distance()) > tol).select(*points.columns), "peel-rest")
    assert taken is not None
    if distance is None:
        return taken, taken.limit(0)
    ok = (F.abs("d") >= distance[0]) & (F.abs("d") <= distance[1])
    return taken.filter(ok), taken.filter(~ok)


def parallel_separation(planes: DataFrame, by: list[str], max_tilt: float = 5.0) -> DataFrame:
    """Pairs of a group's peeled planes (a few per group) that are parallel, with their separation."""
    a = planes.select(*by, F.col("rank").alias("rank_a"), *[F.col(c).alias(c + "a") for c in ("nx", "ny", "nz", "d")])
    b = planes.select(*by, F.col("rank").alias("rank_b"), *[F.col(c).alias(c + "b") for c in ("nx", "ny", "nz", "d")])
    na, nb = vec("nxa", "nya", "nza"), vec("nxb", "nyb", "nzb")
    sign = F.when(dot(na, nb) < 0, -1.0).otherwise(1.0)
    return a.join(b, by).filter("rank_a < rank_b").withColumn("tilt_deg", tilt_deg(na, nb)).filter(F.col("tilt_deg") <= max_tilt).select(
        *by, "rank_a", "rank_b", "tilt_deg", F.abs(F.col("da") - sign * F.col("db")).alias("separation"))


def identify_deck(planes: DataFrame, by: list[str], standoff: tuple[float, float] | None = None, area: str | None = None, min_area: float = 0.0) -> DataFrame:
    """The plane with most inliers among those at a plausible stand-off and patch area."""
    ok = planes
    if standoff:
        ok = ok.filter((F.abs("d") >= standoff[0]) & (F.abs("d") <= standoff[1]))
    if area:
        ok = ok.filter(F.col(area) >= min_area)
    cols = [c for c in planes.columns if c not in by]
    return ok.groupBy(*by).agg(F.max_by(F.struct(*cols), F.col("inliers")).alias("_p")).select(*by, "_p.*")


def local_flatness(points: DataFrame, by: list[str], patch: float, min_count: int = 30, xyz=("x", "y", "z"), **kw) -> DataFrame:
    """Per patch: plane rms, p97-p3 of its residuals, tilt against z, mean offset."""
    x, y, z = xyz
    cells = points.withColumn("px", F.floor(F.col(x) / patch).cast("long")).withColumn("py", F.floor(F.col(y) / patch).cast("long"))
    keys = [*by, "px", "py"]
    fit = plane_fit(cells, keys, xyz, min_count)
    resid = cells.join(fit.select(*keys, "nx", "ny", "nz", "d"), keys).withColumn("_r", signed_distance(xyz))
    q = quantiles(resid, keys, "_r", {"p3": 0.03, "p97": 0.97}, **kw).drop("n")
    return fit.join(q, keys).select(
        *keys, "n", "rms", (F.col("p97") - F.col("p3")).alias("spread"),
        F.degrees(F.acos(clamp(F.abs("nz"), 0.0, 1.0))).alias("tilt_deg"), F.col("mz").alias("offset"))


def assign_plane(points: DataFrame, planes: DataFrame, by: list[str], tol: float, plane_id: str = "plane_id", xyz=("x", "y", "z")) -> tuple[DataFrame, DataFrame]:
    """Each point takes the plane of its group with the smallest |residual| within ``tol``.

    The planes of a group travel as one array on one row, so points are not multiplied by planes.
    Returns (assigned points, groups of points without any plane).
    """
    arr = planes.groupBy(*by).agg(F.collect_list(F.struct(F.col(plane_id).alias("id"), "nx", "ny", "nz", "d")).alias("_pl"))
    x, y, z = (F.col(c) for c in xyz)

    def scored(p: Column) -> Column:
        r = p["nx"] * x + p["ny"] * y + p["nz"] * z + p["d"]
        return F.struct(F.abs(r).alias("a"), p["id"].alias("id"), r.alias("r"))

    best = points.join(arr, by).withColumn("_b", F.array_min(F.transform("_pl", scored)))
    out = best.filter(F.col("_b.a") <= tol).select(*points.columns, F.col("_b.id").alias(plane_id), F.col("_b.r").alias("residual"))
    return out, points.select(*by).distinct().join(arr.select(*by), by, "left_anti")


def plane_screen(planes: DataFrame, by: list[str], deck_d: float, reference: DataFrame | None, max_tilt: float, min_offset: float) -> DataFrame:
    """Drops planes below the deck, planes whose reference fit tilts, and weaker duplicates of another plane.

    Planes alike in normal and offset are one row with their strongest, and meet only those of the offsets near by.
    """
    keep = planes.filter(F.col("d") >= deck_d)
    if reference is not None:
        r = reference.select(*by, "plane_id", *[F.col(c).alias("r" + c) for c in ("nx", "ny", "nz")])
        keep = keep.join(r, [*by, "plane_id"]).filter(tilt_deg(vec("nx", "ny", "nz"), vec("rnx", "rny", "rnz")) <= max_tilt).drop("rnx", "rny", "rnz")
    if min_offset <= 0:
        return keep
    shape = [*by, "nx", "ny", "nz", "d"]
    rank = F.struct((-F.col("n")).alias("w"), F.col("plane_id").alias("id"))  # the stronger is the smaller
    cell = F.floor(F.col("d") / (1.001 * min_offset)).cast("long")
    known = keep.filter(F.col("n").isNotNull() & (F.abs("d") < float("inf")))
    alike = materialise(known.groupBy(*shape).agg(F.min(rank).alias("_s")).withColumn("_c", cell), "screen-planes")
    other = alike.select(*by, *[F.col(c).alias("_" + c) for c in ("nx", "ny", "nz", "d")], F.col("_s").alias("_o"), F.explode(F.array(*[F.col("_c") + k for k in (-1, 0, 1)])).alias("_c"))
    same = (tilt_deg(vec("nx", "ny", "nz"), vec("_nx", "_ny", "_nz")) <= max_tilt) & (F.abs(F.col("d") - F.col("_d")) < min_offset)
    strongest = alike.join(other, [*by, "_c"]).filter(same).groupBy(*shape).agg(F.min("_o").alias("_best"))
    return keep.join(strongest, shape, "left").filter(~F.coalesce(F.col("_best") < rank, F.lit(False))).select(*keep.columns)


def two_plane_scale_offset(planes: DataFrame, camera: str = "camera", surface: str = "surface") -> DataFrame:
    """Scale and offset of a camera against the mean of the others: measured = scale * mean + offset on both surfaces.

    ``planes`` holds one depth (``z``) per camera and surface, surfaces named 'near' and 'far'. Both are null where the
    others' surfaces lie within a micrometre of each other.
    """
    total = planes.groupBy(surface).agg(F.sum("z").alias("_s"), F.count(F.lit(1)).alias("_k"))
    loo = planes.join(total, surface).withColumn("_ref", (F.col("_s") - F.col("z")) / (F.col("_k") - 1))
    wide = loo.groupBy(camera).agg(
        *[F.max(F.when(F.col(surface) == s, F.col(c))).alias(f"{c}_{s}") for s in ("near", "far") for c in ("z", "_ref")]
    )
    apart = F.col("_ref_far") - F.col("_ref_near")
    s = F.when(F.abs(apart) >= 1e-6, (F.col("z_far") - F.col("z_near")) / apart)
    return wide.withColumn("scale", s).withColumn("offset", F.col("z_near") - F.col("scale") * F.col("_ref_near")).select(camera, "scale", "offset")


def classify_camera_bias(scale: Column, offset: Column, tilt: Column, scale_tol: float = 0.01, offset_tol: float = 0.010, tilt_tol: float = 0.5) -> Column:
    s, o, t = F.abs(scale - 1.0) > scale_tol, F.abs(offset) > offset_tol, tilt > tilt_tol
    return F.when(s & o, "scale and offset").when(s, "scale").when(o, "offset").when(t, "tilt").otherwise("consistent")


def camera_conditioning(centres: DataFrame, by: list[str], xyz=("x", "y", "z")) -> DataFrame:
    """Ratio of the second to the first singular value of the centred camera centres; 0 below three."""
    x, y, z = xyz
    agg = centres.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cams"), _covariance(x, y, z).alias("_cov"))
    e = agg.withColumn("_e", smallest_axis("_cov"))
    ratio = F.sqrt(F.greatest(F.col("_e.e1"), F.lit(0.0)) / F.col("_e.e2"))
    return e.select(*by, "n_cams", F.when((F.col("n_cams") >= 3) & (F.col("_e.e2") > 0), ratio).otherwise(0.0).alias("conditioning"))


def view_audit(points: DataFrame, plane_by: list[str], camera: str, band: float, above: float, min_count: int = 500, **kw) -> DataFrame:
    """Per view against the fused plane (columns nx ny nz d): offset, tilt, warp, share below the deck, spread.

    ``points`` carry the fused plane of their group.
    """
    h = points.withColumn("h", signed_distance())
    keys = [*plane_by, camera]
    near = h.filter(F.abs("h") <= band)
    counts = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.abs("h") <= band).alias("n_belt"),
                                  (F.count_if(F.col("h") < -band) / F.count(F.lit(1))).alias("below_fraction"))
    belt = quantiles(near, keys, "h", {"p5": 0.05, "offset": 0.5, "p95": 0.95}, **kw).filter(F.col("n") >= min_count).drop("n")
    rms = near.groupBy(*keys).agg(F.sqrt(F.avg(F.col("h") * F.col("h"))).alias("deck_rms"))
    top = median(h.filter(F.col("h") > above), keys, "h", "above_offset", **kw).filter(F.col("n") >= min_count).drop("n")
    own = plane_fit_tukey(near.select(*keys, "x", "y", "z"), keys)
    warp = near.select(*keys, "x", "y", "z", *[F.col(c).alias("f" + c) for c in ("nx", "ny", "nz")]).join(own.select(*keys, "nx", "ny", "nz", "d"), keys).withColumn("_r", signed_distance())
    tilt = warp.groupBy(*keys).agg(F.first(tilt_deg(vec("nx", "ny", "nz"), vec("fnx", "fny", "fnz"))).alias("tilt_deg"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("warp_rms"))
    p95 = quantiles(warp, keys, F.abs("_r"), {"warp_p95": 0.95}, **kw).drop("n")
    return (counts.join(belt, keys, "left").join(rms, keys, "left").join(tilt, keys, "left").join(p95, keys, "left").join(top, keys, "left")
            .withColumn("spread", F.col("p95") - F.col("p5")).drop("p5", "p95"))


def radial_profile(points: DataFrame, by: list[str], angle: str, residual: str, bins: int = 8, min_count: int = 30, **kw) -> DataFrame:
    """Median residual per field-angle bin of each view, with the amplitude over bins."""
    top = points.groupBy(*by).agg(F.max(angle).alias("_max"))
    tagged = points.join(top, by).select(
        *by, F.least(F.lit(bins - 1), F.floor(F.col(angle) / F.col("_max") * bins)).cast("long").alias("bin"), F.col(residual).alias("r"))
    med = median(tagged, [*by, "bin"], "r", "median", **kw).filter(F.col("n") >= min_count)
    amp = med.groupBy(*by).agg((F.max("median") - F.min("median")).alias("amplitude"))
    return med.join(amp, by)


EDGES = (0, 4, 8, 12, 16, 24)  # fixed values: border distance bins in pixels, the last one open


def edge_profile(pixels: DataFrame, by: list[str], distance: str, excess: str, edges=EDGES, min_count: int = 50, **kw) -> DataFrame:
    """Median depth excess by distance to the border."""
    which = F.lit(None).cast("long")
    for i, e in enumerate(edges):
        which = F.when(F.col(distance) >= e, F.lit(i).cast("long")).otherwise(which)
    tagged = pixels.select(*by, which.alias("bin"), F.col(excess).alias("e")).filter("bin is not null")
    return median(tagged, [*by, "bin"], "e", "median", **kw).filter(F.col("n") >= min_count)
