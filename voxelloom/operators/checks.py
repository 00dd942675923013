"""Gates on records and pixels: serial numbers, curtains, clipped channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def serial_gate(records: DataFrame, cameras: DataFrame, by: list[str], camera: str = "camera", serial: str = "serial") -> DataFrame:
    """Records whose serial is not the one that the rig knows for their camera: by..., camera, serial, wanted, records.

    ``cameras``: camera, serial. Serials are compared as text. A record without a serial passes; a camera that the rig does
    not know has no wanted serial and is reported when it has one of its own.
    """
    known = cameras.select(F.col(camera).alias("_camera"), F.col(serial).cast("string").alias("wanted"))
    got = F.col(serial).cast("string")
    j = records.join(known, F.col(camera).eqNullSafe(F.col("_camera")), "left").filter(got.isNotNull() & ~got.eqNullSafe(F.col("wanted")))
    return j.groupBy(*by, camera, got.alias("serial"), "wanted").agg(F.count(F.lit(1)).alias("records"))


def curtain_reasons(clusters: DataFrame, short_side: Column, skirt_ratio: Column, min_short: float, max_skirt: float) -> DataFrame:
    """``clusters`` with ``curtain_reasons``: a thin vertical sheet has a tiny short side or more points at mid height than on top.

    An empty list keeps the cluster; a side that is NULL gives no reason.
    """
    reasons = F.array_compact(F.array(F.when(short_side < min_short, "short side"), F.when(skirt_ratio > max_skirt, "skirt")))
    return clusters.withColumn("curtain_reasons", reasons)


def channel_clipping(pixels: DataFrame, by: list[str], channels: list[str], low: float = 2, high: float = 254) -> DataFrame:
    """Shares of pixels whose brightest channel is at least ``high``, or at most ``low``, and the mean level of all channels.

    NULL channels do not count; pixels without any are left out of all three.
    """
    top = F.greatest(*channels)  # skips NULL
    level = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in channels[1:]), F.coalesce(F.col(channels[0]), F.lit(0.0)))
    count = sum((F.col(c).isNotNull().cast("int") for c in channels[1:]), F.col(channels[0]).isNotNull().cast("int"))
    seen = pixels.filter(top.isNotNull())
    return seen.groupBy(*by).agg(
        F.avg((top >= high).cast("double")).alias("clipped_high"), F.avg((top <= low).cast("double")).alias("clipped_low"), (F.sum(level) / F.sum(count)).alias("level"))
