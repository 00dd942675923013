"""Exact order statistics and ranks per group, safe when one group holds a large share of all rows.

A count per group, combined before the shuffle, tells first whether any group exceeds ``hot_rows``.
If none does, the built-in aggregate or one window is used. Otherwise equal values (for ranks, rows) are
counted and written once, and those of hot groups are spread over value buckets (splitters from a mergeable
quantile sketch), so no task receives a whole group and the result stays exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.session import few, materialise

HOT_ROWS = 2_000_000
BUCKETS = 256

Rank = Callable[[Column], Column]


def linear(q: float) -> Rank:
    """Fractional rank of linear interpolation."""
    return lambda n: F.lit(float(q)) * (n - 1)


def nearest(q: float) -> Rank:
    """Nearest rank, halves to even."""
    return lambda n: F.rint(F.lit(float(q)) * (n - 1))


def truncated(q: float) -> Rank:
    """Index int(q*n), kept inside the group."""
    return lambda n: F.least(F.floor(F.lit(float(q)) * n), n - 1).cast("double")


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a NULL key meets a NULL key; columns as after ``join(right, keys, how)``."""
    r = right.select(*[F.col(k).alias("_r_" + k) for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_r_" + k))
    return left.join(r, same, how).drop(*["_r_" + k for k in keys])


def hot_groups(df: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of groups above ``hot_rows``; at most rows/hot_rows of them."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)


def any_hot(df: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> bool:
    return not hot_groups(df, by, hot_rows).isEmpty()


def _bucketed(values: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Bucket ``_b`` of each row (by..., _v, _k); a group's buckets hold about as many distinct values each."""
    # written once: the sketch depends on the order in which parts arrive, and every use must see the same buckets
    splitters = materialise(values.groupBy(*by).agg(
        F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("_sp")
    ), "hot-splitters")
    return _beside(values, few(splitters), by).withColumn(
        "_b", F.size(F.filter("_sp", lambda s: s < F.col("_v")))
    ).drop("_sp")


def _hot_values(counted: DataFrame, hot: DataFrame, by: list[str], ranks: dict[str, Rank], buckets: int) -> DataFrame:
    tagged = _bucketed(_beside(counted, hot.select(*by), by), by, buckets)
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    filled = tagged.groupBy(*by, "_b").agg(F.sum("_k").alias("_c")).withColumn(
        "_start", F.coalesce(F.sum("_c").over(upto), F.lit(0))
    )
    wanted = hot.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("double").alias("pos"), F.col("_n").alias("n"))
                    for name, rank in ranks.items()
                ]
            )
        ).alias("_w"),
    ).select(*by, "_w.*")
    wanted = wanted.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
    located = _beside(wanted, filled, by).filter("_r >= _start and _r < _start + _c")
    distinct = _beside(tagged, located.select(*by, "_b").distinct(), [*by, "_b"], "left_semi")
    running = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = _beside(distinct.withColumn("_end", F.sum("_k").over(running)), located, [*by, "_b"]).filter(
        "_r - _start < _end and _r - _start >= _end - _k"
    )
    weight = F.when(F.col("pos") == F.floor("pos"), 1.0).otherwise(1.0 - F.abs(F.col("pos") - F.col("_r")))
    return hits.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.sum(F.when(F.col("name") == name, F.col("_v") * weight)).alias(name) for name in ranks],
    )


def _order_statistics(
    df: DataFrame, by: list[str], value: str | Column, ranks: dict[str, Rank], plain: Callable, hot_rows: int, buckets: int, count: str | None
) -> DataFrame:
    src, keys = _keyed(df, by)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = src.select(*keys, v.alias("_v"), *([F.col(count).alias("_k")] if count else [])).filter("_v is not null and not isnan(_v)")
    if not any_hot(rows, keys, hot_rows):
        out = plain(rows, keys, bool(count))
        return out if by else out.drop("_all")
    # equal values become one row with a count before anything is placed: values are mostly far fewer than rows, and
    # a group is hot by those that are left
    total = F.sum("_k") if count else F.count(F.lit(1))
    counted = materialise(rows.groupBy(*keys, "_v").agg(total.alias("_k")), "hot-values")
    sizes = counted.groupBy(*keys).agg(F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_d"))
    hot = few(materialise(sizes.filter(F.col("_d") > hot_rows).drop("_d"), "hot-groups"))
    if hot.isEmpty():
        out = plain(counted, keys, True)
    else:
        cold = plain(_beside(counted, hot.select(*keys), keys, "left_anti"), keys, True)
        out = cold.unionByName(_hot_values(counted, hot, keys, ranks, buckets))
    return out if by else out.drop("_all")


def quantiles(
    df: DataFrame, by: list[str], value: str | Column, qs: dict[str, float], hot_rows: int = HOT_ROWS, buckets: int = BUCKETS, count: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles: ``by..., n, <names>``; NULL and NaN values are skipped.

    ``count`` names a column of how many rows each row stands for.
    """

    def plain(rows: DataFrame, keys: list[str], counted: bool) -> DataFrame:
        times = [F.col("_k")] if counted else []
        return rows.groupBy(*keys).agg(
            (F.sum("_k") if counted else F.count(F.lit(1))).alias("n"), *[F.percentile("_v", F.lit(float(q)), *times).alias(k) for k, q in qs.items()]
        )

    return _order_statistics(df, by, value, {k: linear(q) for k, q in qs.items()}, plain, hot_rows, buckets, count)


def order_statistics(
    df: DataFrame, by: list[str], value: str | Column, ranks: dict[str, Rank], hot_rows: int = HOT_ROWS, buckets: int = BUCKETS
) -> DataFrame:
    """Values at ranks computed from the group size by any rule (``nearest``, ``truncated``, ``linear``)."""

    def plain(rows: DataFrame, keys: list[str], counted: bool) -> DataFrame:
        if counted:
            pairs = rows.groupBy(*keys).agg(F.sum("_k").alias("n"), F.array_sort(F.collect_list(F.struct("_v", "_k"))).alias("_s"))
            lists = pairs.withColumn("_s", F.flatten(F.transform("_s", lambda x: F.array_repeat(x["_v"], x["_k"].cast("int")))))
        else:
            lists = rows.groupBy(*keys).agg(
                F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("_v")).alias("_s")
            )
        cols = []
        for name, rank in ranks.items():
            pos = rank(F.col("n")).cast("double")
            lo = F.get("_s", F.floor(pos).cast("int"))
            hi = F.get("_s", F.ceil(pos).cast("int"))
            cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
        return lists.select(*keys, "n", *cols)

    return _order_statistics(df, by, value, ranks, plain, hot_rows, buckets, None)


def median(df: DataFrame, by: list[str], value: str | Column, name: str = "median", **kw) -> DataFrame:
    return quantiles(df, by, value, {name: 0.5}, **kw)


def rank_in_group(
    df: DataFrame,
    by: list[str],
    order: list[tuple[str, str]],
    name: str = "rank",
    hot_rows: int = HOT_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """0-based rank by ``order`` = [(column, 'asc'|'desc'), ...]; the first column numeric or a timestamp.

    NULL comes first ascending and last descending, NaN the other way round, in groups of any size.
    """
    src, keys = _keyed(df, by)
    lead, way = order[0]
    kind = dict(src.dtypes)[lead]
    lead_value = F.unix_micros(lead) if kind == "timestamp" else F.col(lead)
    key = lead_value.cast("double") * (1.0 if way == "asc" else -1.0)
    cols = src.columns
    ordering = [F.col(c).asc() if w == "asc" else F.col(c).desc() for c, w in order]
    if not any_hot(src, keys, hot_rows):
        whole = Window.partitionBy(*keys).orderBy(*ordering)
        out = src.withColumn(name, (F.row_number().over(whole) - 1).cast("long"))
        return out if by else out.drop("_all")
    rows = materialise(src.withColumn("_v", key), "hot-rows")
    hot = hot_groups(rows, keys, hot_rows)
    number = F.when(~F.isnan("_v"), F.col("_v"))
    # written once: counts and ranks below must see the same buckets
    splitters = materialise(_beside(rows, hot.select(*keys), keys).groupBy(*keys).agg(
        F.percentile_approx(number, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("_sp")
    ), "hot-splitters")
    ends = {"asc": (-1, buckets), "desc": (buckets, -1)}[way]  # buckets of NULL and NaN
    tagged = _beside(rows, splitters, keys, "left").withColumn(
        "_b",
        F.when(F.col("_sp").isNull(), 0)
        .when(F.col("_v").isNull(), ends[0])
        .when(F.isnan("_v"), ends[1])
        .otherwise(F.size(F.filter("_sp", lambda s: s < F.col("_v")))),
    )
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.filter("_sp is not null")
        .groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_b", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(*keys, "_b").orderBy(*ordering)
    out = (
        _beside(tagged.drop("_sp"), starts, [*keys, "_b"], "left")
        .withColumn(name, (F.row_number().over(within) - 1 + F.coalesce("_start", F.lit(0))).cast("long"))
        .select(*cols, name)
    )
    return out if by else out.drop("_all")


def lag_in_group(
    df: DataFrame, by: list[str], order: list[tuple[str, str]], value: str, steps: int = 1, name: str = "prev", **kw
) -> DataFrame:
    """Value ``steps`` rows earlier; with hot groups ranks plus an equi-join, so no window spans one whole."""
    cols = df.columns
    if not any_hot(df, by, kw.get("hot_rows", HOT_ROWS)):
        w = Window.partitionBy(*by).orderBy(*[F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in order])
        return df.select(*cols, (F.row_number().over(w) - 1).cast("long").alias("row_index"), F.lag(value, steps).over(w).alias(name))
    ranked = materialise(rank_in_group(df, by, order, "_rk", **kw), "hot-ranks")  # tied rows keep one rank on both sides
    back = ranked.select(*by, (F.col("_rk") + steps).alias("_rk"), F.col(value).alias(name))
    return _beside(ranked, back, [*by, "_rk"], "left").select(*cols, "_rk", name).withColumnRenamed("_rk", "row_index")


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, name: str = "wmedian", bins: int = BUCKETS) -> DataFrame:
    """First value whose cumulative weight reaches half of the total.

    Weights are summed per (group, value) first; the running sum is taken over value buckets, then
    inside the one bucket that crosses the half.
    """
    src, keys = _keyed(df, by)
    rows = (
        src.select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
        .filter("_v is not null and _w is not null and _w > 0")
        .groupBy(*keys, "_v")
        .agg(F.sum("_w").alias("_w"))
    )
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_w").alias("_total"))
    tagged = rows.join(span, keys).withColumn(
        "_b",
        F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))
        .otherwise(0)
        .cast("int"),
    )
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        tagged.groupBy(*keys, "_b")
        .agg(F.sum("_w").alias("_bw"), F.first("_total").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_bw").over(upto), F.lit(0.0)))
        .filter("_before < 0.5 * _total and _before + _bw >= 0.5 * _total * (1 - 1e-12)")
        .groupBy(*keys)
        .agg(F.min("_b").alias("_b"), F.min_by("_before", "_b").alias("_before"))
    )
    running = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        tagged.join(sums, [*keys, "_b"])
        .withColumn("_cum", F.col("_before") + F.sum("_w").over(running))
        .filter("_cum >= 0.5 * _total * (1 - 1e-12)")
        .groupBy(*keys)
        .agg(F.min("_v").alias(name))
    )
    return out if by else out.drop("_all")
