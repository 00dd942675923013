"""Edge-keeping smoothing of rasters by running sums, at a cost that does not grow with the radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _box(df: DataFrame, by: list[str], columns: list[str], radius: int, axis: str) -> DataFrame:
    """Sums of 2 radius + 1 neighbours along one axis, border values repeated; ``_a`` counts from 0 to ``_n`` - 1 along it.

    Two values of one running sum bound every window, so a wide window costs what a narrow one does.
    """
    rest = "iv" if axis == "iu" else "iu"
    w = Window.partitionBy(*by, rest).orderBy(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at, n = F.col(axis) - F.col(f"{axis}0"), F.col(f"{axis}n")
    df = df.withColumns({f"_s{c}": F.sum(c).over(upto) for c in columns} | {f"_f{c}": F.first(c).over(whole) for c in columns} | {f"_l{c}": F.last(c).over(whole) for c in columns} | {f"_t{c}": F.sum(c).over(whole) for c in columns})
    before, after = F.greatest(F.lit(0), radius - at), F.greatest(F.lit(0), at + radius - (n - 1))
    sums = {}
    for c in columns:
        high = F.coalesce(F.lead(f"_s{c}", radius).over(w), F.col(f"_t{c}"))
        low = F.coalesce(F.lag(f"_s{c}", radius + 1).over(w), F.lit(0.0))
        sums[c] = high - low + before * F.col(f"_f{c}") + after * F.col(f"_l{c}")
    return df.withColumns(sums).drop(*[f"_{k}{c}" for k in "sflt" for c in columns])


def guided_filter(cells: DataFrame, by: list[str], guide: str, value: str, radius: int, eps: float) -> DataFrame:
    """``value`` smoothed where ``guide`` is, keeping the guide's edges: by..., iu, iv, smooth.

    ``cells``: by..., iu, iv and both columns, one row for each cell of a group's rectangle. The filter is linear in the
    guide inside each window of ``radius`` cells, with ``eps`` against small variances; borders repeat. A group with a
    missing, repeated or NULL cell has NULL for all of its cells: its windows would not be whole. ``radius`` 0 gives the
    value itself.
    """
    rows = cells.select(*by, F.col("iu").cast("long").alias("iu"), F.col("iv").cast("long").alias("iv"), F.col(guide).cast("double").alias("I"), F.col(value).cast("double").alias("p"))
    if radius < 1:
        return rows.select(*by, "iu", "iv", F.col("p").alias("smooth"))
    box = rows.groupBy(*by).agg(
        F.min("iu").alias("iu0"), F.min("iv").alias("iv0"), (F.max("iu") - F.min("iu") + 1).alias("iun"), (F.max("iv") - F.min("iv") + 1).alias("ivn"),
        F.count(F.when(F.col("I").isNotNull() & F.col("p").isNotNull(), 1)).alias("_k"), F.count(F.lit(1)).alias("_rows"), F.count_distinct("iu", "iv").alias("_cells"))
    box = box.withColumn("_whole", (F.col("_k") == F.col("iun") * F.col("ivn")) & (F.col("_rows") == F.col("_k")) & (F.col("_cells") == F.col("_k"))).select(*by, "iu0", "iv0", "iun", "ivn", "_whole")
    area = float((2 * radius + 1) ** 2)
    x = rows.join(box, by).withColumns({"mI": F.col("I"), "mp": F.col("p"), "mIp": F.col("I") * F.col("p"), "mII": F.col("I") * F.col("I")})
    for axis in ("iu", "iv"):
        x = _box(x, by, ["mI", "mp", "mIp", "mII"], radius, axis)
    mean_i, mean_p = F.col("mI") / area, F.col("mp") / area
    a = (F.col("mIp") / area - mean_i * mean_p) / (F.col("mII") / area - mean_i * mean_i + eps)
    x = x.withColumn("a", a).withColumn("b", mean_p - F.col("a") * mean_i)
    for axis in ("iv", "iu"):  # the last windows lie along iv, so these need no new exchange
        x = _box(x, by, ["a", "b"], radius, axis)
    return x.select(*by, "iu", "iv", F.when(F.col("_whole"), F.col("a") / area * F.col("I") + F.col("b") / area).alias("smooth"))
