"""Volumetric fusion of depth maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.geometry import project_pinhole
from voxelloom.operators.rasters import cell_floor
from voxelloom.operators.spatial import offsets


def tsdf_fuse(points: DataFrame, cameras: DataFrame, pixels: DataFrame, by: list[str], voxel: float, trunc: float) -> tuple[DataFrame, DataFrame]:
    """Average truncated signed distance of the voxels near points, and the voxels where it changes sign.

    Only voxels within the truncation of an occupied one exist; each is projected into the rig's few
    cameras and meets their depth by pixel. Returns (voxels, surface points).
    """
    reach = max(1, int(trunc / voxel + 0.999))
    occ = points.select(*by, *[cell_floor(c, voxel).alias("k" + c) for c in "xyz"]).distinct()
    grid = occ.withColumn("_o", F.explode(offsets(3, reach))).select(*by, *[(F.col("k" + c) + F.col("_o.o" + c)).alias("k" + c) for c in "xyz"]).distinct()
    centre = tuple((F.col("k" + c) + 0.5) * voxel for c in "xyz")
    cam = grid.join(cameras, by) if by else grid.withColumn("_j", F.lit(0)).join(
        cameras.agg(F.collect_list(F.struct(*cameras.columns)).alias("_c")).withColumn("_j", F.lit(0)), "_j").withColumn("_c", F.explode("_c")).select("kx", "ky", "kz", "_c.*")
    u, v, z = project_pinhole(centre)  # type: ignore[arg-type]
    seen = cam.select(*by, "camera", "kx", "ky", "kz", z.alias("_z"), F.rint(u).cast("long").alias("u"), F.rint(v).cast("long").alias("v")).filter("u is not null")
    hit = seen.join(pixels.select(*by, "camera", "u", "v", F.col("z").alias("_d")), [*by, "camera", "u", "v"]).withColumn("_s", (F.col("_d") - F.col("_z")) / trunc).filter("_s >= -1")
    vox = hit.groupBy(*by, "kx", "ky", "kz").agg(F.avg(F.least(F.col("_s"), F.lit(1.0))).alias("tsdf"), F.count(F.lit(1)).alias("weight"))
    axis = F.explode(F.array(*[F.struct(*[F.lit(1 if c == a else 0).alias("o" + c) for c in "xyz"]) for a in "xyz"]))
    nxt = vox.withColumn("_o", axis).select(*by, F.col("tsdf").alias("_t"), "_o", *[(F.col("k" + c) - F.col("_o.o" + c)).alias("k" + c) for c in "xyz"])
    edge = vox.join(nxt, [*by, "kx", "ky", "kz"]).filter("tsdf * _t < 0")
    f = F.col("tsdf") / (F.col("tsdf") - F.col("_t"))
    return vox, edge.select(*by, *[((F.col("k" + c) + 0.5 + f * F.col("_o.o" + c)) * voxel).alias(c) for c in "xyz"])
