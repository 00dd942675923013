"""Surfaces among points that no parcel claimed, taken off each raster component from the top down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.boxes import min_area_rect, rect_distance
from voxelloom.operators.groups import nearest, order_statistics, quantiles
from voxelloom.operators.rasters import cell_floor
from voxelloom.operators.spatial import label_cells, largest_component
from voxelloom.session import materialise


def peel_unclaimed(
    points: DataFrame, claimed: DataFrame | None, by: list[str], cell: float, close: int = 0, pct: float = 0.90, top_pct: float = 0.95, band: float = 0.030, max_relief: float = 0.080, min_cells: int = 24, min_points: int = 200,
    min_gap: float = 0.040, min_dim: float = 0.05, max_dim: float = 2.0, max_aspect: float = 12.0, min_area: float = 0.0, min_coverage: float = 0.5, max_levels: int | None = None, pid: str = "pid",
) -> DataFrame:
    """Every surface of every component of unclaimed points: by..., label, level, accepted, reason, height, relief, cells, n_points, cu, cv, length, width, yaw, coverage.

    ``points``: by..., ``pid``, u, v, h (belt frame); ``claimed``: by..., ``pid`` of points that belong to a parcel. The
    free points are gathered on the raster, after a closing of ``close`` cells. Of each component, and of all at once, the
    top surface is taken: the largest connected patch of envelope cells (``pct`` of a cell's heights) within a band below
    the component's ``top_pct``; the band widens up to ``max_relief`` where the patch is too small or its own relief asks
    for it. What lies in the patch's rectangle at or below the surface goes with it, and the rest is looked at again,
    until fewer than ``min_points`` are left, no patch of ``min_cells`` is found, or ``max_levels`` were taken. A surface
    less than ``min_gap`` below the last accepted one of its component is the same one; that and failed size tests are
    reported with the reason. ``height`` is the patch's mean, ``relief`` its p97 - p3.

    Each round works on all components together and on what is left of them only.
    """
    free = points.select(*by, pid, *[F.col(c).cast("double").alias(c) for c in ("u", "v", "h")]).withColumns({"iu": cell_floor("u", cell), "iv": cell_floor("v", cell)})
    if claimed is not None:
        free = free.join(claimed.select(*by, pid).distinct(), [*by, pid], "left_anti")
    free = materialise(free, "free")
    labels = label_cells(free.select(*by, "iu", "iv").distinct(), by, close=close)
    keys = [*by, "label"]
    left = materialise(free.join(labels, [*by, "iu", "iv"]), "free-left")
    last = None  # height of the last accepted surface
    found = None
    level = 0
    while max_levels is None or level < max_levels:
        sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
        rows = materialise(left.join(sizes.select(*keys), keys, "left_semi"), "free-round")
        if rows.isEmpty():
            break
        env = materialise(order_statistics(rows, [*keys, "iu", "iv"], "h", {"e": nearest(pct)}).drop("n"), "free-envelope")
        top = quantiles(env, keys, "e", {"_top": top_pct}).drop("n")
        state = materialise(top.select(*keys, "_top", F.lit(float(band)).alias("_band")), "free-bands")
        patches = None
        for _ in range(6):
            want = env.join(state, keys).filter(F.col("e") >= F.col("_top") - F.col("_band"))
            part = label_cells(want.withColumnRenamed("label", "part").select(*by, "part", "iu", "iv"), [*by, "part"], close=close)
            big = largest_component(part, [*by, "part"]).select(*by, F.col("part").alias("label"), "iu", "iv")
            patch = materialise(want.join(big, [*keys, "iu", "iv"], "left_semi").select(*keys, "iu", "iv", "e", "_band"), "free-patch")
            shape = quantiles(patch, keys, "e", {"_p3": 0.03, "_p97": 0.97})
            j = state.join(shape, keys, "left")
            few = F.coalesce("n", F.lit(0)) < min_cells
            wide = F.col("_band") >= max(max_relief, band) - 1e-6
            relief = F.least(F.greatest(1.6 * (F.col("_p97") - F.col("_p3")), F.lit(float(band))), F.lit(float(max(max_relief, band))))
            more = F.when(few, F.least(F.greatest(2 * F.col("_band"), F.lit(0.02)), F.lit(float(max(max_relief, band))))).otherwise(relief)
            done = F.when(few, wide).otherwise((more <= 1.05 * F.col("_band")) | wide)
            j = materialise(j.withColumns({"_few": few, "_done": done, "_next": more}), "free-bands")
            ended = patch.join(j.filter("_done and not _few").select(*keys), keys, "left_semi")
            patches = ended if patches is None else patches.unionByName(ended)
            state = materialise(j.filter("not _done").select(*keys, "_top", F.col("_next").alias("_band")), "free-bands")
            spare = patch.join(j.filter("not _done and not _few").select(*keys), keys, "left_semi")
            if state.isEmpty():
                break
        else:
            patches = patches.unionByName(spare)  # the band still moves after six tries: the last patch stands
        patches = materialise(patches, "free-patches")
        if patches.isEmpty():
            break
        facts = quantiles(patches, keys, "e", {"_p3": 0.03, "_p97": 0.97}).withColumnRenamed("n", "cells").join(patches.groupBy(*keys).agg(F.avg("e").alias("height")), keys)
        inside = rows.join(patches.select(*keys, "iu", "iv", "e"), [*keys, "iu", "iv"]).filter(F.col("h") >= F.col("e") - F.greatest(F.lit(2.5 * cell), F.lit(float(band))))
        rect = min_area_rect(inside, keys, cell, lo=0.0, hi=1.0).drop("n")
        surface = materialise(facts.join(rect, keys).withColumn("relief", F.col("_p97") - F.col("_p3")).drop("_p3", "_p97"), "free-surfaces")
        margin = 2.0 * cell
        taken = (rect_distance(F.col("u"), F.col("v")) <= margin) & (F.col("h") <= F.col("height") + F.col("relief") + margin)
        here = materialise(rows.join(surface.select(*keys, "height", "relief", "cu", "cv", "length", "width", "yaw"), keys).withColumn("_t", taken), "free-taken")
        count = here.filter("_t").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
        j = surface.join(count, keys, "left").withColumn("n_points", F.coalesce("n_points", F.lit(0).cast("long")))
        j = j.withColumn("_last", F.lit(None).cast("double")) if last is None else j.join(last, keys, "left")
        reason = F.when(F.col("_last") - F.col("height") < min_gap, "the surface above again").when(F.col("n_points") < min_points, "few points in its footprint").when((F.col("width") < min_dim) | (F.col("length") > max_dim), "size").when(
            F.col("length") / F.greatest("width", F.lit(1e-6)) > max_aspect, "aspect").when(F.col("length") * F.col("width") < min_area, "area").when(F.col("coverage") < min_coverage, "coverage").when(F.col("relief") > max_relief, "relief")
        round_ = materialise(j.select(*keys, F.lit(level).cast("long").alias("level"), reason.isNull().alias("accepted"), reason.alias("reason"), "height", "relief", F.col("cells").cast("long").alias("cells"), "n_points", "cu", "cv", "length", "width", "yaw", "coverage", "_last"), "free-found")
        found = round_.drop("_last") if found is None else found.unionByName(round_.drop("_last"))
        heights = round_.select(*keys, F.when(F.col("accepted"), F.col("height")).otherwise(F.col("_last")).alias("_last"))
        last = materialise(heights if last is None else heights.unionByName(last.join(heights.select(*keys), keys, "left_anti")), "free-last")
        stuck = count.filter("n_points > 0").select(*keys)  # a surface that takes nothing ends its component
        left = materialise(here.filter("not _t").join(stuck, keys, "left_semi").select(*left.columns), "free-left")
        level += 1
    if found is None:
        kind = {f.name: f.dataType.simpleString() for f in points.schema}
        head = ", ".join(f"`{c}` {kind[c]}" for c in by)
        return points.sparkSession.createDataFrame([], (head + ", " if head else "") + "label long, level long, accepted boolean, reason string, height double, relief double, cells long, n_points long, cu double, cv double, length double, width double, yaw double, coverage double")
    return found
