"""Line and multi-column regressions by distributed moments, reweighted in passes.

Every pass reads the rows, combines weighted sums before the shuffle and writes one row per group.
Only that small table is carried to the next pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.groups import HOT_ROWS, any_hot, median, quantiles
from voxelloom.session import few, materialise


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal(m: pd.Series, b: pd.Series) -> pd.Series:
    """Least-squares solution of row-major normal equations, one per row."""
    out = []
    for mi, bi in zip(m, b):
        if mi is None or bi is None or not np.all(np.isfinite(mi)):
            out.append(None)
            continue
        k = len(bi)
        a = np.asarray(mi, float).reshape(k, k)
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        x = np.linalg.lstsq(a / np.outer(scale, scale), np.asarray(bi, float) / scale, rcond=1e-12)[0] / scale
        out.append(x.tolist())
    return pd.Series(out)


def _group_median(df: DataFrame, by: list[str], value: Column, name: str, hot: bool, count: str | None = None) -> DataFrame:
    """Median of each group, written where one is ``hot``; ``count`` names how many rows each row stands for."""
    if hot:
        return few(materialise(median(df, by, value, name, count=count).drop("n"), "fit-median"))
    return df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias(name))


def predict(k: int, coef: str = "coef") -> Column:
    total = F.col("_x0") * F.col(coef)[0]
    for i in range(1, k):
        total = total + F.col(f"_x{i}") * F.col(coef)[i]
    return total


def _moments(k: int, w2: Column, count: str | None = None) -> list[Column]:
    """Sums of the normal equations; ``count`` names how many rows each row stands for."""
    times = F.col(count) if count else F.lit(1)
    m = [F.sum(w2 * times * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(k) for j in range(k)]
    b = [F.sum(w2 * times * F.col(f"_x{i}") * F.col("_y")) for i in range(k)]
    return [F.array(*m).alias("_m"), F.array(*b).alias("_b"), F.sum(times).alias("n") if count else F.count(F.lit(1)).alias("n"),
            F.sum(w2 * times).alias("sum_w"), F.sum(w2 * w2 * times).alias("sum_w2")]


def least_squares(df: DataFrame, by: list[str], design: list[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """Ordinary (or row-weighted, weight squared in the normal equations) least squares: ``by..., coef, n``."""
    k = len(design)
    w2 = F.lit(1.0) if weight is None else weight * weight
    rows = df.select(*by, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(design)], y.cast("double").alias("_y"), w2.alias("_w2"))
    rows = rows.dropna(subset=[*[f"_x{i}" for i in range(k)], "_y", "_w2"])
    return (
        rows.groupBy(*by).agg(*_moments(k, F.col("_w2")))
        .withColumn("coef", solve_normal("_m", "_b"))
    )


Weight = Callable[[Column, Column], Column]


def huber_weight(c: float) -> Weight:
    return lambda r, s: F.when(r <= c * s, 1.0).otherwise(c * s / F.greatest(r, F.lit(1e-12)))


def geman_weight(c: float) -> Weight:
    return lambda r, s: 1.0 / (1.0 + F.pow(r / (c * s), 2))


def reweighted_fit(
    df: DataFrame, by: list[str], design: list[Column], y: Column, weight: Weight, iters: int,
    scale: str = "median", floor: float = 1e-9, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Iteratively reweighted least squares per group: ``by..., coef array, n, sum_w, sum_w2, scale``.

    The weight multiplies design row and target, so its square enters the normal equations.
    ``scale='median'`` is 1.4826 median|r|; ``'mad'`` takes deviations from the median residual.
    The coefficients returned are those of the last solve; its weights come from the pass before.
    Where a group is hot, equal rows become one with a count before the passes.
    """
    k = len(design)
    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    rows = src.select(*keys, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(design)], y.cast("double").alias("_y"))
    data = materialise(rows.dropna(subset=[*[f"_x{i}" for i in range(k)], "_y"]), "fit-rows")
    hot = any_hot(data, keys, hot_rows)
    count = "_k" if hot else None
    if hot:
        data = materialise(data.groupBy(*data.columns).agg(F.count(F.lit(1)).alias("_k")), "fit-counted")
    coef: DataFrame | None = None
    for _ in range(iters):
        if coef is None:
            moments = data.groupBy(*keys).agg(*_moments(k, F.lit(1.0), count)).withColumn("scale", F.lit(None).cast("double"))
        else:
            resid = data.join(few(coef.select(*keys, "coef")) if hot else coef.select(*keys, "coef"), keys).withColumn("_r", predict(k) - F.col("_y"))
            if scale == "mad":
                centre = _group_median(resid, keys, F.col("_r"), "_c", hot, count)
                resid = resid.join(centre, keys)
                spread = _group_median(resid, keys, F.abs(F.col("_r") - F.col("_c")), "_med", hot, count)
            else:
                spread = _group_median(resid, keys, F.abs("_r"), "_med", hot, count)
            s = F.greatest(F.col("_med") * 1.4826, F.lit(floor))
            weighed = resid.join(spread, keys).withColumn("scale", s).withColumn("_w", weight(F.abs("_r"), F.col("scale")))
            moments = weighed.groupBy(*keys).agg(*_moments(k, F.col("_w") * F.col("_w"), count), F.first("scale").alias("scale"))
        coef = materialise(moments.withColumn("coef", solve_normal("_m", "_b")), "fit-coef")
    out = coef.drop("_b")
    return out.withColumnRenamed("_m", "normal") if by else out.withColumnRenamed("_m", "normal").drop("_all")


def robust_line(df: DataFrame, by: list[str], x: str, y: str, huber: float = 2.0, iters: int = 6, **kw) -> DataFrame:
    """Huber line y = p x + q."""
    fit = reweighted_fit(df, by, [F.col(x), F.lit(1.0)], F.col(y), huber_weight(huber), iters, **kw)
    return fit.select(*by, F.col("coef")[0].alias("p"), F.col("coef")[1].alias("q"), "n")


def robust_regression(df: DataFrame, by: list[str], columns: list[Column], y: str, huber: float = 2.0, iters: int = 8, **kw) -> DataFrame:
    return reweighted_fit(df, by, columns, F.col(y), huber_weight(huber), iters, **kw).select(*by, "coef", "n")


def robust_line_cov(df: DataFrame, by: list[str], x: str, y: str, huber: float = 1.345, iters: int = 20, **kw) -> DataFrame:
    """Huber line with covariance, effective count, condition number and residual scale.

    All but the line come from the weights of its own residuals. The covariance is the inverse of the weighted normal
    matrix times the weighted residual variance over ``n_eff`` - 2 (one at least); NULL where that matrix is singular,
    and the condition number is infinite. A scale that vanishes is replaced by the residuals' standard deviation.
    """
    keys = list(by) or ["_all"]
    src = (df if by else df.withColumn("_all", F.lit(0))).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    fit = reweighted_fit(src, keys, [F.col("_x"), F.lit(1.0)], F.col("_y"), huber_weight(huber), iters, scale="mad", floor=1e-12, **kw)
    line = fit.select(*keys, F.col("coef")[0].alias("p"), F.col("coef")[1].alias("q"), "n")
    resid = materialise(src.join(line, keys).withColumn("_r", F.col("_y") - F.col("p") * F.col("_x") - F.col("q")), "line-residuals")
    centred = resid.join(median(resid, keys, "_r", "_c", **kw).drop("n"), keys)
    spread = median(centred, keys, F.abs(F.col("_r") - F.col("_c")), "_mad", **kw).drop("n")
    weighed = resid.join(spread, keys).withColumn("_s", 1.4826 * F.col("_mad")).withColumn("_w", huber_weight(huber)(F.abs("_r"), F.greatest("_s", F.lit(1e-12))))
    w2 = F.col("_w") * F.col("_w")
    sums = weighed.groupBy(*keys, "p", "q", "n").agg(
        F.sum(w2 * F.col("_x") * F.col("_x")).alias("sxx"), F.sum(w2 * F.col("_x")).alias("sx"), F.sum(w2).alias("s1"), F.sum(w2 * w2).alias("s2"),
        F.sum(w2 * F.col("_r") * F.col("_r")).alias("rss"), F.max("_s").alias("_s"), F.stddev_pop("_r").alias("_sd"))
    n_eff = F.col("s1") * F.col("s1") / F.greatest("s2", F.lit(1e-12))
    var = F.col("rss") / F.greatest(n_eff - 2, F.lit(1.0))
    det = F.col("sxx") * F.col("s1") - F.col("sx") * F.col("sx")
    half = (F.col("sxx") + F.col("s1")) / 2
    high = half + F.sqrt(F.greatest(half * half - det, F.lit(0.0)))
    sound = det > 0
    return sums.select(
        *by,
        "p",
        "q",
        "n",
        n_eff.alias("n_eff"),
        F.when(F.col("_s") > 1e-12, F.col("_s")).otherwise(F.col("_sd") + 1e-12).alias("scale"),
        F.when(sound, var * F.col("s1") / det).alias("var_p"),
        F.when(sound, var * F.col("sxx") / det).alias("var_q"),
        F.when(sound, -var * F.col("sx") / det).alias("cov_pq"),
        F.when(sound, high * high / det).otherwise(float("inf")).alias("condition"),
    )


def prediction_se(x: Column) -> Column:
    return F.sqrt(x * x * F.col("var_p") + 2.0 * x * F.col("cov_pq") + F.col("var_q"))


def soft_scale_shift(df: DataFrame, by: list[str], x: str, y: str, c: float = 2.0, iters: int = 10, **kw) -> DataFrame:
    """Line with 1/(1+(r/cs)^2) weights."""
    fit = reweighted_fit(df, by, [F.col(x), F.lit(1.0)], F.col(y), geman_weight(c), iters, **kw)
    return fit.select(*by, F.col("coef")[0].alias("scale"), F.col("coef")[1].alias("shift"), "n")


def trimmed_line(df: DataFrame, by: list[str], x: str, y: str, iters: int = 5, trim: float = 2.5, min_count: int = 20) -> DataFrame:
    """Line with rows beyond ``trim`` population sigmas dropped between fits; NULL below ``min_count``."""
    data = materialise(df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"]), "fit-rows")
    fits = None
    r = F.col("_y") - (F.col("p") * F.col("_x") + F.col("q"))
    for _ in range(iters):
        rows = data
        if fits is not None:
            rows = data.join(fits.select(*by, "p", "q", "sigma"), by).filter(
                F.col("p").isNull() | (F.col("sigma") <= 1e-12) | (F.abs(r) < trim * F.col("sigma"))
            ).select(*by, "_x", "_y")
        lines = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("p"), F.regr_intercept("_y", "_x").alias("q"),
            F.var_pop("_y").alias("_vy"), F.var_pop("_x").alias("_vx"),
        )
        # the residual variance of an OLS line follows from the moments
        sigma = F.sqrt(F.greatest(F.col("_vy") - F.col("p") * F.col("p") * F.col("_vx"), F.lit(0.0)))
        enough = F.col("n") >= min_count
        fits = materialise(
            lines.select(*by, "n", F.when(enough, F.col("p")).alias("p"), F.when(enough, F.col("q")).alias("q"), F.when(enough, sigma).alias("sigma")),
            "fit-coef",
        )
    return fits


def polynomial_surface(df: DataFrame, by: list[str], u: str, v: str, y: str, order: int) -> DataFrame:
    """Polynomial of the given order in (u, v): coefficients, rms before and after, variance explained."""
    cu, cv = F.col(u), F.col(v)
    design = [F.pow(cu, i - j) * F.pow(cv, j) for i in range(order + 1) for j in range(i + 1)]
    fit = least_squares(df, by, design, F.col(y)).select(*by, "coef", F.col("n").alias("_n"))
    total = F.lit(0.0)
    for i, d in enumerate(design):
        total = total + d * F.col("coef")[i]
    resid = df.join(fit, by).withColumn("_e", F.col(y) - total)
    return resid.groupBy(*by).agg(
        F.max("_n").alias("n"),
        F.first("coef").alias("coef"),
        F.sqrt(F.avg(F.col(y) * F.col(y))).alias("rms_before"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rms_after"),
        (1.0 - F.var_pop("_e") / F.var_pop(y)).alias("explained"),
    )


def deficit_by_height(df: DataFrame, by: list[str], h: str, deficit: str, lo: float, width: float, bands: int, min_count: int = 50, **kw) -> DataFrame:
    """Median deficit in [lo, hi) height bands with enough rows."""
    tagged = df.filter((F.col(h) >= lo) & (F.col(h) < lo + width * bands)).select(
        *by, F.floor((F.col(h) - lo) / width).cast("long").alias("band"), F.col(deficit).alias("d")
    )
    return (
        median(tagged, [*by, "band"], "d", "median_deficit", **kw)
        .filter(F.col("n") >= min_count)
        .withColumn("band_lo", lo + F.col("band") * width)
    )


def band_slope(bands: DataFrame, by: list[str], width: float) -> DataFrame:
    """Slope through the band mid-points; needs two bands."""
    mid = F.col("band_lo") + width / 2
    return bands.groupBy(*by).agg(F.count(F.lit(1)).alias("bands"), F.regr_slope(F.col("median_deficit"), mid).alias("slope"))


MODELS: dict[str, list[str]] = {
    "none": [],
    "constant": ["1.0"],
    "relief": ["1.0", "h"],
    "positional": ["1.0", "h", "h * u", "h * v"],
}


def holdout_split(df: DataFrame, by: list[str], split: str, order_key: str | None = None, **kw) -> DataFrame:
    """Adds ``train``: below the group median along u, along v, or alternate rows by ``order_key``."""
    if split in ("along", "across"):
        axis = "u" if split == "along" else "v"
        m = median(df, by, axis, "_m", **kw).drop("n")
        return df.join(m, by).withColumn("train", F.col(axis) < F.col("_m")).drop("_m")
    from voxelloom.operators.groups import rank_in_group

    ranked = rank_in_group(df, by, [(order_key, "asc")], "_k", **kw)
    return ranked.withColumn("train", F.col("_k") % 2 == 0).drop("_k")


def holdout_fit(
    df: DataFrame, by: list[str], split: str = "along", deficit: str = "d", huber: float | None = 2.0, iters: int = 8,
    order_key: str | None = None, **kw,
) -> DataFrame:
    """Constant, relief and positional models fitted on one half and scored on the other."""
    rows = materialise(holdout_split(df, by, split, order_key, **kw), "holdout")
    train, test = rows.filter("train"), rows.filter("not train")
    parts = []
    for name, terms in MODELS.items():
        cols = [F.expr(t) for t in terms]
        if not terms:
            scored = test.groupBy(*by).agg(
                F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(F.col(deficit) * F.col(deficit))).alias("rms")
            )
        else:
            if huber is None:
                fit = least_squares(train, by, cols, F.col(deficit)).select(*by, "coef")
            else:
                fit = robust_regression(train, by, cols, deficit, huber, iters).select(*by, "coef")
            pred = F.col("coef")[0] * cols[0]
            for i in range(1, len(cols)):
                pred = pred + F.col("coef")[i] * cols[i]
            e = F.col(deficit) - pred
            scored = test.join(fit, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(e * e)).alias("rms"))
        parts.append(scored.select(*by, F.lit(name).alias("model"), "n_test", "rms"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leave_one_out(df: DataFrame, by: list[str], fold: str, x: str, y: str) -> DataFrame:
    """For each value of ``fold``: the line of the other folds, and its residuals on this one.

    A fold's line comes from the group's total moments minus the fold's own, so nothing is replicated.
    """
    own = df.groupBy(*by, fold).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"),
    )
    names = ["n", "sx", "sy", "sxx", "sxy"]
    total = own.groupBy(*by).agg(*[F.sum(c).alias("t_" + c) for c in names], F.count(F.lit(1)).alias("folds"))
    rest = (own.join(total, by) if by else own.withColumn("_j", F.lit(0)).join(total.withColumn("_j", F.lit(0)), "_j").drop("_j"))
    rest = rest.select(*by, fold, "folds", *[(F.col("t_" + c) - F.col(c)).alias(c) for c in names])
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    p = F.when(F.abs(det) > 1e-12, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    lines = rest.withColumn("p", p).withColumn("q", (F.col("sy") - F.col("p") * F.col("sx")) / F.col("n"))
    return df.join(lines.select(*by, fold, "folds", "p", "q"), [*by, fold]).withColumn(
        "held_out_residual", F.col(y) - (F.col("p") * F.col(x) + F.col("q"))
    )


def leave_one_height_out(df: DataFrame, by: list[str], label: str, x: str, y: str, min_folds: int = 2, **kw) -> DataFrame:
    scored = leave_one_out(df, by, label, x, y).filter(F.col("folds") >= min_folds)
    keys = [*by, label]
    rms = scored.groupBy(*keys).agg(
        F.first("p").alias("p"), F.first("q").alias("q"),
        F.sqrt(F.avg(F.col("held_out_residual") * F.col("held_out_residual"))).alias("held_out_rms"),
    )
    return rms.join(median(scored, keys, "held_out_residual", "held_out_median", **kw), keys)


def leave_one_plane_out(df: DataFrame, by: list[str], plane: str, measured: str, true: str, **kw) -> DataFrame:
    """At least three planes: median and rms of measured-true before, and of the held-out line after."""
    scored = leave_one_out(df, by, plane, measured, true).filter(F.col("folds") >= 3)
    keys = [*by, plane]
    before = F.col(measured) - F.col(true)
    rms = scored.groupBy(*keys).agg(
        F.sqrt(F.avg(before * before)).alias("rms_before"),
        F.sqrt(F.avg(F.col("held_out_residual") * F.col("held_out_residual"))).alias("rms_after"),
    )
    med = quantiles(scored.withColumn("_b", before), keys, "_b", {"median_before": 0.5}, **kw)
    after = median(scored, keys, "held_out_residual", "median_after", **kw).drop("n")
    return rms.join(med, keys).join(after, keys)


def power_law(df: DataFrame, by: list[str], n: str, t: str, min_points: int = 3) -> DataFrame:
    """Exponent of t ~ a n^k from logs, and the rms misfit in units of t of a n^k, a n and a n^2 with the fitted a."""
    rows = df.filter((F.col(n) > 0) & (F.col(t) > 0)).select(*by, F.col(n).cast("double").alias("_n"), F.col(t).cast("double").alias("_t"))
    ln_n, ln_t = F.ln("_n"), F.ln("_t")
    fit = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.regr_slope(ln_t, ln_n).alias("exponent"), F.exp(F.regr_intercept(ln_t, ln_n)).alias("_a")).filter(F.col("points") >= min_points)
    laws = {"rms_power": F.col("exponent"), "rms_linear": F.lit(1.0), "rms_quadratic": F.lit(2.0)}
    return rows.join(fit, by).groupBy(*by).agg(
        F.max("points").alias("points"), F.max("exponent").alias("exponent"),
        *[F.sqrt(F.avg(F.pow(F.col("_a") * F.pow("_n", k) - F.col("_t"), 2))).alias(name) for name, k in laws.items()])


def plane_leverage_se(df: DataFrame, by: list[str], z: str, at: Column, s_eff: Column) -> DataFrame:
    """Standard error of a line at ``at``: s_eff sqrt(1/n + (z - mean)^2 / Sxx)."""
    m = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(z).alias("zbar"), (F.var_pop(z) * F.count(F.lit(1))).alias("sxx"))
    return m.withColumn("se", s_eff * F.sqrt(1.0 / F.col("n") + F.pow(at - F.col("zbar"), 2) / F.col("sxx")))
