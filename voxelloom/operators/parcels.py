"""Belt footprint, faces per camera and parcel tables, composed from the cell, plane and box operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.geometry import incidence_deg, vec
from voxelloom.operators.boxes import comb_fraction, face_weight, label_parcels, min_area_rect, parcel_components, top_face
from voxelloom.operators.rasters import cell_floor
from voxelloom.operators.spatial import label_cells, largest_component
from voxelloom.session import materialise


def belt_footprint(points: DataFrame, by: list[str], cell: float, close: int, step_deg: float = 1.0, **kw) -> DataFrame:
    """Rectangle of the belt: the largest component of the closed deck cells, measured on the cells
    that were occupied before closing. ``points`` are the deck (and object) points in plan, ``u v``."""
    cells = materialise(points.select(*by, cell_floor("u", cell).alias("iu"), cell_floor("v", cell).alias("iv")).distinct(), "belt-cells")
    main = largest_component(label_cells(cells, by, close=close), by)
    inside = cells.join(main.select(*by, "iu", "iv"), [*by, "iu", "iv"], "left_semi")
    centres = materialise(inside.select(*by, ((F.col("iu") + 0.5) * cell).alias("u"), ((F.col("iv") + 0.5) * cell).alias("v")), "belt-cells")
    return min_area_rect(centres, by, cell, step_deg, **kw)


def per_view_faces(points: DataFrame, centres: DataFrame, by: list[str], min_points: int = 60, bin_size: float = 0.004, res: float = 0.02, **face_options) -> tuple[DataFrame, DataFrame]:
    """Top face of a cluster as each camera sees it, with its weight. Returns (faces, skipped with reason).

    ``points``: ``camera pid x y z``; ``centres``: ``camera kx ky kz``. The weight is the inlier count,
    less for a grazing or combed view.
    """
    keys = [*by, "camera"]
    pts = materialise(points, "view-points")
    n = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    enough = n.filter(F.col("n_points") >= min_points).select(*keys)
    kept = pts.join(enough, keys, "left_semi")
    face = materialise(top_face(kept, keys, min_points=min_points, **face_options), "view-faces")
    near = kept.join(face.select(*keys, "nx", "ny", "nz", "d"), keys).filter(
        F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d")) <= 0.012).join(centres, "camera")
    # along and across the horizontal part of the viewing ray of the group
    mid = near.groupBy(*keys).agg(*[F.avg(c).alias("m" + c) for c in "xyz"], *[F.first("k" + c).alias("k" + c) for c in "xyz"])
    ray = mid.withColumn("_t", F.atan2(F.col("my") - F.col("ky"), F.col("mx") - F.col("kx")))
    turned = near.select(*keys, "x", "y").join(ray.select(*keys, "_t"), keys).select(
        *keys, (F.cos("_t") * F.col("x") + F.sin("_t") * F.col("y")).alias("along"), (F.cos("_t") * F.col("y") - F.sin("_t") * F.col("x")).alias("across"))
    comb = comb_fraction(turned, keys, "along", "across", bin_size)
    rect = min_area_rect(near.select(*keys, F.col("x").alias("u"), F.col("y").alias("v")), keys, res, 1.0).select(*keys, "cu", "cv", "length", "width", "yaw")
    inc = face.join(mid, keys).select(*keys, incidence_deg(vec("nx", "ny", "nz"), vec("mx", "my", "mz"), vec("kx", "ky", "kz")).alias("incidence"))
    faces = face.join(comb, keys).join(rect, keys).join(inc, keys).select(
        *keys, "inliers", F.col("top").alias("offset"), F.col("tilt_deg").alias("tilt"), "incidence", "comb", "cu", "cv", "length", "width", "yaw",
        face_weight(F.col("inliers"), F.col("incidence"), F.col("comb")).alias("weight"))
    skipped = n.join(face.select(*keys), keys, "left_anti").select(
        *keys, "n_points", F.when(F.col("n_points") < min_points, "too few points").otherwise("no plane within the tilt and inlier limits").alias("reason"))
    return faces, skipped


def parcel_table(reference: DataFrame, fused: DataFrame, by: list[str], cell: float, lo: float, **kw) -> DataFrame:
    """Parcels of the reference raster beside the same cells of the fused raster: heights, dimensions, differences."""
    ref = materialise(reference, "ref-raster")
    tall = ref.filter(F.col("h") > lo)
    labels = materialise(label_cells(tall.select(*by, "iu", "iv"), by), "parcel-labels")
    parcels = materialise(label_parcels(parcel_components(ref, by, cell, lo, labels=labels, **kw), by), "parcels")
    cells = labels.join(fused.select(*by, "iu", "iv", F.col("h").alias("h_fused")), [*by, "iu", "iv"], "left").join(tall.select(*by, "iu", "iv", "h"), [*by, "iu", "iv"])
    cells = materialise(cells, "parcel-cells")
    from voxelloom.operators.groups import median

    seen = cells.groupBy(*by, "label").agg(F.count("h_fused").alias("fused_cells"), F.avg(F.col("h_fused") - F.col("h")).alias("mean_difference"))
    height = median(cells, [*by, "label"], "h_fused", "fused_height").drop("n")
    return parcels.join(seen, [*by, "label"]).join(height, [*by, "label"], "left").withColumn("height_difference", F.col("fused_height") - F.col("core_height"))
