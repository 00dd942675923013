"""Spatial joins on cell keys: neighbours, support across cameras, components, density clusters.

Nothing here compares all points of a group with each other. Neighbour searches walk a cell pyramid
and drop every cell that cannot hold an answer; components contract an edge list in rounds.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.rasters import cell_floor
from voxelloom.session import materialise


def offsets(dims: int, reach: int = 1, names: str = "xyz") -> Column:
    """array<struct> of the (2 reach + 1)^dims neighbour offsets."""
    span = range(-reach, reach + 1)
    grid: list[tuple[int, ...]] = [()]
    for _ in range(dims):
        grid = [(*g, s) for g in grid for s in span]
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias("o" + names[i]) for i, v in enumerate(g)]) for g in grid])


def _axis_gap(p: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - p, p - hi, F.lit(0.0))


def _axis_far(p: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.abs(p - lo), F.abs(p - hi))


def _length(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


LEAF = 8  # targets of a cell that are met as points
DEEPEST = 24  # halvings of the first cell at most


def _finite(xyz: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in xyz])


def target_cells(
    dst: DataFrame, by: list[str], cap: float, need: int = 1, did: str = "pid", xyz: tuple[str, ...] = ("x", "y", "z"), levels: int = 4,
) -> tuple[DataFrame, int]:
    """The cell pyramid over ``dst`` that ``k_nearest`` walks, and its depth: by..., lev, k., m, lo., hi., pts.

    Cells halve from ``cap`` until the fullest holds ``LEAF`` targets, ``levels`` times at least; those with so few carry
    their points. Of targets on one place only ``need`` of least id are kept: no others are among the nearest.
    """
    names = "xyz"[: len(xyz)]
    d = dst.filter(_finite(xyz)).select(*by, F.col(did).alias("_d"), *[F.col(c).cast("double").alias("d" + n) for c, n in zip(xyz, names)])
    place = [*by, *["d" + n for n in names]]
    if need == 1:
        d = d.groupBy(*place).agg(F.min("_d").alias("_d"))
    else:
        d = d.withColumn("_i", F.row_number().over(Window.partitionBy(*place).orderBy("_d"))).filter(F.col("_i") <= need).drop("_i")
    d = materialise(d, "knn-targets")
    depth = levels
    while depth < DEEPEST:
        full = d.groupBy(*by, *[cell_floor("d" + n, cap / 2**depth).alias("k" + n) for n in names]).agg(F.count(F.lit(1)).alias("m"))
        most = full.agg(F.max("m")).first()[0] or 0
        if most <= max(LEAF, need):
            break
        depth = min(DEEPEST, depth + max(1, int(math.log2(most / LEAF) / len(names))))
    every = d.withColumns({"q" + n: cell_floor("d" + n, cap / 2**depth) for n in names}).withColumn("lev", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    every = every.select(*by, "lev", "_d", *["d" + n for n in names], *[F.expr(f"shiftright(q{n}, {depth} - lev)").alias("k" + n) for n in names])
    keys = [*by, "lev", *["k" + n for n in names]]
    cells = materialise(every.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"), *[F.min("d" + n).alias("lo" + n) for n in names], *[F.max("d" + n).alias("hi" + n) for n in names]), "knn-cells")
    few_in = cells.filter((F.col("m") <= max(LEAF, need)) | (F.col("lev") == depth)).select(*keys)
    points = every.join(few_in, keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("_d", *["d" + n for n in names])).alias("pts"))
    return materialise(cells.join(points, keys, "left"), "knn-pyramid"), depth


def k_nearest(
    src: DataFrame, dst: DataFrame, by: list[str], cap: float, k: int = 1, sid: str = "pid", did: str = "pid",
    xyz: tuple[str, ...] = ("x", "y", "z"), levels: int = 4, exclude_self: bool = False, index: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """Up to ``k`` nearest points of ``dst`` within ``cap`` for each row of ``src``: ``by..., sid, did, dist, rank``.

    Exact. The finest cell about a source row with ``k`` targets bounds its distance; the row meets the cells of that size
    within the bound, those with many targets are halved until few are left, and points are met in cells of few.
    ``index``: the ``target_cells`` of ``dst`` for this ``cap``, where several searches share them. Jobs run while this is called.
    """
    names = "xyz"[: len(xyz)]
    need = k + (1 if exclude_self else 0)
    cells, depth = index or target_cells(dst, by, cap, need, did, xyz, levels)
    s = src.filter(_finite(xyz)).select(*by, F.col(sid).alias("_s"), *[F.col(c).cast("double").alias("s" + n) for c, n in zip(xyz, names)])
    at, key = ["s" + n for n in names], ["k" + n for n in names]
    size = F.lit(float(cap)) / F.pow(F.lit(2.0), F.col("lev"))
    gap = _length([_axis_gap(F.col("s" + n), F.col("lo" + n), F.col("hi" + n)) for n in names])
    far = _length([_axis_far(F.col("s" + n), F.col("lo" + n), F.col("hi" + n)) for n in names])
    dists = F.transform("pts", lambda p: _length([F.col("s" + n) - p["d" + n] for n in names]))
    kth = F.array_min(dists) if need == 1 else F.get(F.array_sort(dists), F.lit(need - 1))
    bound = F.when(F.col("m") >= need, F.least(far, F.coalesce(kth, far)))
    slack = F.col("_ub") * (1 + 1e-9)  # the bound and the gap are rounded separately

    own = s.withColumns({"q" + n: cell_floor("s" + n, cap / 2**depth) for n in names}).withColumn("lev", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    own = own.select(*by, "_s", *at, "lev", *[F.expr(f"shiftright(q{n}, {depth} - lev)").alias("k" + n) for n in names])
    seed = own.join(cells, [*by, "lev", *key], "left").groupBy(*by, "_s", *at).agg(F.max(F.when(F.col("m") >= need, F.col("lev"))).alias("lev"), F.min(bound).alias("_ub"))
    around = seed.withColumns({"lev": F.coalesce("lev", F.lit(0)), "_ub": F.least(F.coalesce("_ub", F.lit(float(cap))), F.lit(float(cap)))})
    for n in names:
        reach = slack + F.abs(F.col("s" + n)) * 1e-15
        around = around.withColumn("k" + n, F.explode(F.sequence(cell_floor(F.col("s" + n) - reach, size), cell_floor(F.col("s" + n) + reach, size))))
    box = _length([_axis_gap(F.col("s" + n), F.col("k" + n) * size, (F.col("k" + n) + 1) * size) for n in names])
    around = around.filter(box <= slack + 1e-15 * sum((F.abs(F.col(c)) for c in at), F.lit(0.0)))

    def met(cand: DataFrame) -> DataFrame:
        """What each candidate cell within the bound gives: its near points, or the cell itself where it holds many."""
        near = F.transform("pts", lambda p: F.struct(_length([F.col("s" + n) - p["d" + n] for n in names]).alias("dist"), p["_d"].alias("_d")))
        near = F.filter(near, lambda p: (p["dist"] <= slack) & (p["dist"] <= cap))
        if need == 1:
            near = F.slice(F.array_sort(near), 1, 1)
        out = cand.filter(gap <= slack).select(*by, "_s", *at, "_ub", "lev", *key, near.alias("_near"))
        return materialise(out.filter(F.col("_near").isNull() | (F.size("_near") > 0)), "knn-met")

    halves = cells.select(*by, "lev", *[F.expr(f"shiftright(k{n}, 1)").alias("p" + n) for n in names], *key, "m", *["lo" + n for n in names], *["hi" + n for n in names], "pts")
    each = Window.partitionBy(*by, "_s")
    rows = met(around.join(cells, [*by, "lev", *key]))
    found = None
    while True:
        here = rows.filter("_near IS NOT NULL").select(*by, "_s", F.explode("_near").alias("_n")).select(*by, "_s", "_n.dist", "_n._d")
        found = here if found is None else found.unionByName(here)
        many = rows.filter("_near IS NULL")
        if many.isEmpty():
            break
        parents = many.select(*by, "_s", *at, "_ub", (F.col("lev") + 1).alias("lev"), *[F.col("k" + n).alias("p" + n) for n in names])
        inner = parents.join(halves, [*by, "lev", *["p" + n for n in names]]).filter(gap <= slack)
        rows = met(inner.withColumn("_ub", F.least("_ub", F.min(bound).over(each))))
    if exclude_self:
        found = found.filter("_s != _d")
    if k == 1:
        best = found.groupBy(*by, "_s").agg(F.min(F.struct("dist", "_d")).alias("_b"))
        return best.select(*by, F.col("_s").alias(sid), F.col("_b._d").alias("nn"), F.col("_b.dist").alias("dist"), F.lit(0).cast("long").alias("rank"))
    order = Window.partitionBy(*by, "_s").orderBy("dist", "_d")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < k).select(
        *by, F.col("_s").alias(sid), F.col("_d").alias("nn"), "dist", "rank")


def k_nearest_any(
    src: DataFrame, dst: DataFrame, by: list[str], cap: float, k: int = 1, sid: str = "pid", did: str = "pid",
    xyz: tuple[str, ...] = ("x", "y", "z"), levels: int = 4, exclude_self: bool = False, index: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """As ``k_nearest`` at any distance: rows short of ``k`` search again with four times the cap.

    Ends when every row has ``k`` neighbours or all of its group. Rows without finite coordinates have none.
    """
    src, dst = src.filter(_finite(xyz)), dst.filter(_finite(xyz))
    found = materialise(k_nearest(src, dst, by, cap, k, sid, did, xyz, levels, exclude_self, index), "k-nearest")
    sizes = dst.groupBy(*by).agg(F.least(F.count(F.lit(1)) - (1 if exclude_self else 0), F.lit(k)).alias("_want"))
    rest = src.select(*by, sid, *xyz)
    while True:
        have = found.groupBy(*by, sid).agg(F.count(F.lit(1)).alias("_have"))
        wanted = rest.join(sizes, by) if by else rest.crossJoin(sizes)
        rest = wanted.join(have, [*by, sid], "left").filter(F.coalesce("_have", F.lit(0)) < F.col("_want")).select(*by, sid, *xyz)
        if rest.isEmpty():
            return found
        rest = materialise(rest, "k-nearest-rest")
        cap, levels = 4 * cap, levels + 2  # leaf cells keep their size
        more = k_nearest(rest, dst, by, cap, k, sid, did, xyz, levels, exclude_self)
        found = materialise(found.join(rest.select(*by, sid), [*by, sid], "left_anti").unionByName(more), "k-nearest")


def nearest_neighbour(src: DataFrame, dst: DataFrame, by: list[str], cap: float, sid: str = "pid", **kw) -> DataFrame:
    """Every source row with its nearest target and distance; both NULL and ``saturated`` where none lies within ``cap``."""
    found = k_nearest(src, dst, by, cap, 1, sid, **kw).drop("rank")
    return src.join(found, [*by, sid], "left").withColumn("saturated", F.col("dist").isNull())


def distance_stats(nn: DataFrame, by: list[str], near: float = 0.010, **kw) -> DataFrame:
    """Mean, median, rms, p95, share below ``near`` and saturated count of 1-NN distances."""
    from voxelloom.operators.groups import quantiles

    q = quantiles(nn, by, "dist", {"median": 0.5, "p95": 0.95}, **kw).drop("n")
    agg = nn.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("saturated").alias("saturated"), F.avg("dist").alias("mean"),
        F.sqrt(F.avg(F.col("dist") * F.col("dist"))).alias("rms"), (F.count_if(F.coalesce(F.col("dist") < near, F.lit(False))) / F.count(F.lit(1))).alias("share_near"))
    return agg.join(q, by, "left")


def outlier_removal(points: DataFrame, by: list[str], k: int, std_ratio: float, cap: float, pid: str = "pid", xyz=("x", "y", "z")) -> DataFrame:
    """Drops points whose mean distance to ``k`` neighbours exceeds mean + ratio * sd over the group.

    ``cap`` is where the search starts, not a limit; in a group of ``k`` points or fewer all others are neighbours.
    """
    near = k_nearest_any(points, points, by, cap, k, pid, pid, xyz, exclude_self=True)
    mean = near.groupBy(*by, pid).agg(F.avg("dist").alias("mean_dist"))
    limit = mean.groupBy(*by).agg((F.avg("mean_dist") + std_ratio * F.stddev_samp("mean_dist")).alias("_limit"))
    keep = mean.join(limit, by).filter(F.col("mean_dist") <= F.col("_limit"))
    return points.join(keep.select(*by, pid, "mean_dist"), [*by, pid])


def cross_camera_support(points: DataFrame, by: list[str], size: float, camera: str = "camera", xyz=("x", "y", "z")) -> DataFrame:
    """Adds ``supported``: another camera has a point in the 27 cells around. Only occupied cells are expanded."""
    keys = ["k" + n for n in "xyz"]
    keyed = points.withColumns({k: cell_floor(c, size) for k, c in zip(keys, xyz)})
    seen = keyed.groupBy(*by, *keys).agg(F.collect_set(camera).alias("_c"))
    spread = seen.withColumn("_o", F.explode(offsets(3))).select(*by, *[(F.col(k) + F.col("_o.o" + n)).alias(k) for k, n in zip(keys, "xyz")], F.explode("_c").alias("_cam"))
    around = spread.groupBy(*by, *keys).agg(F.collect_set("_cam").alias("_around"))
    joined = keyed.join(around, [*by, *keys])
    return joined.withColumn("supported", F.size(F.array_except("_around", F.array(camera))) > 0).drop(*keys, "_around")


def radius_support(points: DataFrame, by: list[str], radius: float, camera: str = "camera", pid: str = "pid", xyz=("x", "y", "z"), **kw) -> DataFrame:
    """Adds ``supported``: another camera has a point within ``radius``.

    A cell no wider than ``radius`` corner to corner supports every point in it if it holds two cameras; only points of
    other cells are searched for, once per other camera of the rig.
    """
    keys = ["_c" + n for n in "xyz"[: len(xyz)]]
    keyed = points.filter(_finite(xyz)).select(*by, pid, camera, *[cell_floor(c, radius / math.sqrt(len(xyz)) * (1 - 1e-6)).alias(k) for k, c in zip(keys, xyz)])
    shared = keyed.groupBy(*by, *keys).agg(F.min(camera).alias("_lo"), F.max(camera).alias("_hi")).filter("_lo != _hi").select(*by, *keys)
    sure = materialise(keyed.filter(F.col(camera).isNotNull()).join(shared, [*by, *keys], "left_semi").select(*by, pid).distinct(), "support-sure")
    left = materialise(points.select(*by, pid, camera, *xyz).join(sure, [*by, pid], "left_anti"), "support-left")
    cams = points.select(*by, F.col(camera).alias("_other")).distinct()
    per = left.join(cams, by).filter(F.col(camera) != F.col("_other")) if by else _with_all(left, cams).filter(F.col(camera) != F.col("_other"))
    target = points.withColumn("_other", F.col(camera))
    found = k_nearest(per, target, [*by, "_other"], radius, 1, pid, pid, xyz, **kw).select(*by, pid)
    hits = sure.unionByName(found).distinct()
    return points.join(hits.withColumn("_hit", F.lit(True)), [*by, pid], "left").withColumn("supported", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _with_all(points: DataFrame, cams: DataFrame) -> DataFrame:
    names = cams.agg(F.collect_set("_other").alias("_all")).withColumn("_j", F.lit(0))
    return points.withColumn("_j", F.lit(0)).join(names, "_j").withColumn("_other", F.explode("_all")).drop("_j", "_all")


def unsupported_census(supported: DataFrame, by: list[str], h: str, bin_size: float, camera: str = "camera") -> DataFrame:
    return supported.groupBy(*by, camera, F.floor(F.col(h) / bin_size).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("supported")).alias("unsupported"))


# --- components -------------------------------------------------------------------------------


def connected_components(nodes: DataFrame, edges: DataFrame, by: list[str], jumps: int = 2) -> DataFrame:
    """Labels ``nodes(by..., id)`` by the smallest id reachable over ``edges(by..., a, b)``.

    Each round orders the vertices by a fresh hash, points each at its first neighbour, shortens those
    pointers, and keeps only edges between different vertices. Hashed order keeps pointer chains short
    on long thin shapes too, so the edge list shrinks by a factor per round until it is empty; every round joins
    at least two vertices of each edge list left.
    """
    both = edges.select(*by, "a", "b").union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = materialise(both, "cc-edges")
    label = materialise(nodes.select(*by, "id").distinct().withColumn("root", F.col("id")), "cc-labels")
    for turn in count():
        if both.isEmpty():
            least = label.groupBy(*by, "root").agg(F.min("id").alias("label"))
            return label.join(least, [*by, "root"]).select(*by, "id", "label")

        def order(c: str) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))

        first = both.groupBy(*by, "a").agg(F.min(order("b")).alias("_m"))
        parent = materialise(first.select(*by, "a", F.least(order("a"), F.col("_m"))["id"].alias("p")), "cc-parent")
        for _ in range(jumps):
            up = parent.select(*by, F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, [*by, "p"]).select(*by, "a", F.col("pp").alias("p"))
        parent = materialise(parent, "cc-parent")
        pa = parent.withColumnRenamed("p", "pa")
        pb = parent.select(*by, F.col("a").alias("b"), F.col("p").alias("pb"))
        both = materialise(both.join(pa, [*by, "a"]).join(pb, [*by, "b"]).select(*by, F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a != b").distinct(), "cc-edges")
        move = parent.select(*by, F.col("a").alias("root"), "p")
        label = materialise(label.join(move, [*by, "root"], "left").select(*by, "id", F.coalesce("p", "root").alias("root")), "cc-labels")


BIG = 1 << 31


def cell_id(iu: str = "iu", iv: str = "iv") -> Column:
    return F.col(iu) * BIG + F.col(iv) + (BIG >> 1)


def dilate(cells: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Square dilation, one axis at a time."""
    out = cells.select(*by, "iu", "iv").distinct()
    for axis in ("iu", "iv"):
        rest = "iv" if axis == "iu" else "iu"
        out = out.select(*by, rest, F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach)).alias(axis)).distinct()
    return out.select(*by, "iu", "iv")


def erode(cells: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Cells whose whole (2 reach + 1) square is occupied, one axis at a time."""
    out = cells.select(*by, "iu", "iv").distinct()
    for axis in ("iu", "iv"):
        rest = "iv" if axis == "iu" else "iu"
        out = (
            out.select(*by, rest, F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach)).alias(axis))
            .groupBy(*by, rest, axis).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == 2 * reach + 1).drop("_k")
        )
    return out.select(*by, "iu", "iv")


def close_cells(cells: DataFrame, by: list[str], reach: int) -> DataFrame:
    return erode(dilate(cells, by, reach), by, reach) if reach else cells.select(*by, "iu", "iv").distinct()


def label_cells(cells: DataFrame, by: list[str], conn: int = 8, close: int = 0) -> DataFrame:
    """Components of a cell set after an optional closing: ``by..., iu, iv, label``."""
    shape = materialise(close_cells(cells, by, close), "cells")
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if conn == 8 else [])
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a, b in steps]))
    here = shape.withColumn("id", cell_id())
    moved = here.withColumn("_o", step).select(*by, F.col("id").alias("a"), (F.col("iu") + F.col("_o.du")).alias("iu"), (F.col("iv") + F.col("_o.dv")).alias("iv"))
    edges = moved.join(here.select(*by, "iu", "iv", F.col("id").alias("b")), [*by, "iu", "iv"]).select(*by, "a", "b")
    labels = connected_components(here, edges, by)
    return here.join(labels, [*by, "id"]).select(*by, "iu", "iv", "label")


def component_stats(labels: DataFrame, by: list[str], cell: float) -> DataFrame:
    box = (F.max("iu") - F.min("iu") + 1) * (F.max("iv") - F.min("iv") + 1)
    return labels.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * cell * cell).alias("area"),
        F.min("iu").alias("iu_min"), F.max("iu").alias("iu_max"), F.min("iv").alias("iv_min"), F.max("iv").alias("iv_max"),
        (F.count(F.lit(1)) / box).alias("fill"))


def largest_component(labels: DataFrame, by: list[str]) -> DataFrame:
    sizes = labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_k"))
    top = sizes.groupBy(*by).agg(F.max_by("label", F.struct(F.col("_k"), -F.col("label"))).alias("label"))
    return labels.join(top, [*by, "label"], "left_semi")


def fill_holes(cells: DataFrame, by: list[str]) -> DataFrame:
    """Adds background cells that no 4-connected path links to the border of the bounding box."""
    have = materialise(cells.select(*by, "iu", "iv").distinct(), "cells")
    box = have.groupBy(*by).agg(F.min("iu").alias("u0"), F.max("iu").alias("u1"), F.min("iv").alias("v0"), F.max("iv").alias("v1"))
    grid = box.select(*by, "u0", "u1", "v0", "v1", F.explode(F.sequence("u0", "u1")).alias("iu")).select("*", F.explode(F.sequence("v0", "v1")).alias("iv"))
    empty = materialise(grid.join(have, [*by, "iu", "iv"], "left_anti"), "background")
    labels = label_cells(empty, by, conn=4)
    rim = empty.filter("iu = u0 or iu = u1 or iv = v0 or iv = v1").select(*by, "iu", "iv")
    outside = labels.join(rim, [*by, "iu", "iv"], "left_semi").select(*by, "label").distinct()
    holes = labels.join(outside, [*by, "label"], "left_anti").select(*by, "iu", "iv")
    return have.unionByName(holes)


def deck_surfaces(cells: DataFrame, by: list[str], cell: float, close: int) -> DataFrame:
    """Closed and hole-filled cells, components by falling area."""
    filled = fill_holes(close_cells(cells, by, close), by)
    stats = component_stats(label_cells(filled, by), by, cell)
    order = Window.partitionBy(*by).orderBy(F.desc("cells"), "label")
    return stats.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def clamp_min_points(min_points: int, eps: float, voxel: float) -> int:
    """A face sampled once per voxel cannot hold more neighbours than its disc."""
    return max(1, min(min_points, int(0.4 * math.pi * (eps / voxel) ** 2)))


def dbscan(points: DataFrame, by: list[str], eps: float, min_points: int, voxel: float, pid: str = "pid", xyz=("x", "y", "z")) -> DataFrame:
    """Density clusters ``by..., pid, cluster`` (-1 noise); cluster ids are dense per group.

    Points are reduced to one per voxel first, which bounds the rows of an eps cell by
    (eps/voxel + 1)^3, so the neighbour join grows linearly. Each point takes its voxel's cluster.
    """
    names = "xyz"[: len(xyz)]
    if voxel < eps / 16:
        raise ValueError("voxel must be at least eps/16: it bounds the points of a neighbourhood")
    keyed = points.select(*by, pid, *[F.col(c).cast("double").alias(n) for c, n in zip(xyz, names)]).withColumns({"v" + n: cell_floor(n, voxel) for n in names})
    vox = materialise(
        keyed.groupBy(*by, *["v" + n for n in names]).agg(F.min(F.struct(pid, *names)).alias("_p")).select(
            *by, *["v" + n for n in names], F.col(f"_p.{pid}").alias("id"), *[F.col("_p." + n).alias(n) for n in names]),
        "voxels")
    need = clamp_min_points(min_points, eps, voxel)
    here = vox.select(*by, F.col("id").alias("b"), *[F.col(n).alias("b" + n) for n in names], *[cell_floor(n, eps).alias("k" + n) for n in names])
    around = vox.select(*by, F.col("id").alias("a"), *names, F.explode(offsets(len(names))).alias("_o")).select(
        *by, "a", *names, *[(cell_floor(n, eps) + F.col("_o.o" + n)).alias("k" + n) for n in names])
    near = around.join(here, [*by, *["k" + n for n in names]]).filter(_length([F.col(n) - F.col("b" + n) for n in names]) <= eps).select(*by, "a", "b")
    near = materialise(near, "near")
    core = near.groupBy(*by, "a").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= need).select(*by, F.col("a").alias("id"))
    core = materialise(core, "core")
    ca, cb = core.withColumnRenamed("id", "a"), core.withColumnRenamed("id", "b")
    labels = connected_components(core, near.join(ca, [*by, "a"]).join(cb, [*by, "b"]), by)
    border = near.join(labels.withColumnRenamed("id", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("id")).agg(F.min("label").alias("label"))
    final = vox.join(labels, [*by, "id"], "left").withColumnRenamed("label", "_core").join(border, [*by, "id"], "left")
    final = final.withColumn("label", F.coalesce("_core", "label"))
    from voxelloom.operators.groups import rank_in_group

    ids = rank_in_group(final.filter("label is not null").select(*by, "label").distinct(), by, [("label", "asc")], "cluster")
    voxel_cluster = final.join(ids, [*by, "label"], "left").select(*by, *["v" + n for n in names], F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
    return keyed.join(voxel_cluster, [*by, *["v" + n for n in names]]).select(*by, pid, "cluster")


def smooth_cells(cells: DataFrame, by: list[str], value: str, reach: int, sigma: float | None = None) -> DataFrame:
    """Box or Gaussian average over the valid cells around, separable, for occupied cells."""
    out = cells.select(*by, "iu", "iv", F.col(value).cast("double").alias("_s"), F.lit(1.0).alias("_m"))
    weight = F.exp(-0.5 * F.pow(F.col("_o") / sigma, 2)) if sigma else F.lit(1.0)
    for axis in ("iu", "iv"):
        rest = "iv" if axis == "iu" else "iu"
        out = (
            out.withColumn("_o", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
            .groupBy(*by, rest, (F.col(axis) + F.col("_o")).alias(axis))
            .agg(F.sum(F.col("_s") * weight).alias("_s"), F.sum(F.col("_m") * weight).alias("_m"))
        )
    return cells.join(out.select(*by, "iu", "iv", (F.col("_s") / F.col("_m")).alias("smooth")), [*by, "iu", "iv"])


def diffuse_holes(cells: DataFrame, domain: DataFrame, by: list[str], value: str, passes: int = 4) -> DataFrame:
    """Fills empty cells of ``domain`` with the mean of occupied 8-neighbours, up to ``passes`` rings."""
    have = cells.select(*by, "iu", "iv", F.col(value).cast("double").alias("val"))
    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a, b in ring]))
    for _ in range(passes):
        have = materialise(have, "filled")
        reach = have.withColumn("_o", step).groupBy(*by, (F.col("iu") + F.col("_o.du")).alias("iu"), (F.col("iv") + F.col("_o.dv")).alias("iv")).agg(F.avg("val").alias("val"))
        fresh = reach.join(domain.select(*by, "iu", "iv"), [*by, "iu", "iv"], "left_semi").join(have.select(*by, "iu", "iv"), [*by, "iu", "iv"], "left_anti")
        have = have.unionByName(fresh.select(*by, "iu", "iv", "val"))
    return have


def cell_periodicity(cells: DataFrame, by: list[str], relief: str, pitch_min: int, pitch_max: int, min_terms: int = 8, share: float = 0.85) -> DataFrame:
    """Normalised autocorrelation of cell relief over lags in an annulus; the smallest radius reaching ``share`` of the peak."""
    lags = [(a, b) for a in range(-pitch_max, pitch_max + 1) for b in range(-pitch_max, pitch_max + 1) if pitch_min**2 <= a * a + b * b <= pitch_max**2]
    mean = cells.groupBy(*by).agg(F.avg(relief).alias("_mean"), F.var_pop(relief).alias("_var"))
    x = cells.join(mean, by).select(*by, "iu", "iv", "_var", (F.col(relief) - F.col("_mean")).alias("_x"))
    step = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("du"), F.lit(b).cast("long").alias("dv")) for a, b in lags]))
    moved = x.withColumn("_o", step).select(*by, "_var", F.col("_x").alias("_y"), F.col("_o.du").alias("du"), F.col("_o.dv").alias("dv"),
                                           (F.col("iu") + F.col("_o.du")).alias("iu"), (F.col("iv") + F.col("_o.dv")).alias("iv"))
    corr = moved.join(x.drop("_var"), [*by, "iu", "iv"]).groupBy(*by, "du", "dv").agg(
        (F.sum(F.col("_x") * F.col("_y")) / F.greatest(F.count(F.lit(1)), F.lit(min_terms)) / F.max("_var")).alias("rho"))
    peak = corr.groupBy(*by).agg(F.max("rho").alias("peak"))
    radius = F.sqrt((F.col("du") * F.col("du") + F.col("dv") * F.col("dv")).cast("double"))
    return corr.join(peak, by).filter(F.col("rho") >= share * F.col("peak")).groupBy(*by).agg(F.max("peak").alias("peak"), F.min(radius).alias("pitch"))


def local_maxima(cells: DataFrame, by: list[str], value: str, reach: int) -> DataFrame:
    """Cells no other cell within ``reach`` exceeds (ties to the smaller index)."""
    ring = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a or b]
    step = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("du"), F.lit(b).cast("long").alias("dv")) for a, b in ring]))
    here = cells.select(*by, "iu", "iv", F.col(value).alias("_v"))
    other = here.withColumn("_o", step).select(*by, F.col("_v").alias("_w"), F.struct("iu", "iv").alias("_from"),
                                              (F.col("iu") + F.col("_o.du")).alias("iu"), (F.col("iv") + F.col("_o.dv")).alias("iv"))
    beaten = here.join(other, [*by, "iu", "iv"]).filter((F.col("_w") > F.col("_v")) | ((F.col("_w") == F.col("_v")) & (F.col("_from") < F.struct("iu", "iv"))))
    return cells.join(beaten.select(*by, "iu", "iv").distinct(), [*by, "iu", "iv"], "left_anti")


def suction_site(cells: DataFrame, by: list[str], value: str, radius: int, tolerance: float, cell: float, min_coverage: float = 0.9, smooth: int = 1, max_range: float = 1.0) -> DataFrame:
    """Best disc per group on heights averaged over ``smooth`` cells each way: the least range + 0.02 * distance to the centre.

    Any disc that is covered and spans less than ``max_range`` may win; ``tolerance`` is only for flat_fraction, the share
    of cells with a disc as flat as that. A group without such a disc has null places. Equal scores go by iv, then iu.
    """
    disc = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    step = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("du"), F.lit(b).cast("long").alias("dv")) for a, b in disc]))
    here = smooth_cells(cells.select(*by, "iu", "iv", value), by, value, smooth).select(*by, "iu", "iv", F.col("smooth").alias("_v"))
    centre = cells.groupBy(*by).agg(F.avg("iu").alias("_cu"), F.avg("iv").alias("_cv"))
    # the cell itself comes with step (0, 0): places that only neighbours reach are no cells
    stats = here.withColumn("_o", step).groupBy(*by, (F.col("iu") + F.col("_o.du")).alias("iu"), (F.col("iv") + F.col("_o.dv")).alias("iv")).agg(
        (F.count(F.lit(1)) / len(disc)).alias("coverage"), (F.max("_v") - F.min("_v")).alias("range"), F.bool_or((F.col("_o.du") == 0) & (F.col("_o.dv") == 0)).alias("_cell"))
    stats = stats.filter("_cell").join(centre, by)
    dist = F.hypot(F.col("iu") - F.col("_cu"), F.col("iv") - F.col("_cv")) * cell
    scored = stats.withColumn("_ok", (F.col("coverage") > min_coverage) & (F.col("range") < max_range)).withColumn("score", F.col("range") + 0.02 * dist)
    return scored.groupBy(*by).agg(
        F.min_by(F.struct("iu", "iv", "range", "score"), F.when(F.col("_ok"), F.struct("score", "iv", "iu"))).alias("_s"),
        (F.count_if(F.col("_ok") & (F.col("range") <= tolerance)) / F.count(F.lit(1))).alias("flat_fraction")).select(*by, "_s.*", "flat_fraction")
