"""Depth field z' = z (s + a x + b y) + c of each camera against reference planes, in one stage or bootstrapped in two.

Planes are n.x = off in the camera's frame, pixels carry the ray (rx, ry, 1). What is minimised is the perpendicular
distance to the plane. Every pass reads the pixels once and leaves one 6 x 6 matrix for each group and plane.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.session import few, materialise

THETA = "sabc"
_SOLVED = T.StructType([T.StructField(k, T.DoubleType()) for k in THETA])


def windows(first: float, last: float, passes: int) -> list[float]:
    """Assignment windows, shrinking geometrically."""
    return [float(w) for w in np.geomspace(max(first, 1e-4), max(last, 1e-4), max(1, passes))]


def _ridged(gram: np.ndarray, columns: list[int], target: np.ndarray, priors: list[tuple[int, float, float]]) -> np.ndarray:
    """Least squares from moments; a prior (column, value, sd) is worth sqrt(rows) observations at the residual scale.

    ``gram`` holds the products of [q, xq, yq, r, target, 1]; ``target`` is the combination of them to be met.
    """
    a, b, n = gram[np.ix_(columns, columns)], gram[columns] @ target, gram[5, 5]
    x = np.linalg.lstsq(a, b, rcond=1e-14)[0]
    if priors:
        resid = target.copy()
        resid[columns] -= x
        mean = resid @ gram[:, 5] / n
        sigma = np.sqrt(max(resid @ gram @ resid / n - mean * mean, 0.0)) + 1e-9
        for k, value, sd in priors:
            w = (np.sqrt(max(n, 1.0)) * sigma / sd) ** 2
            a[k, k] += w
            b[k] += w * value
        x = np.linalg.lstsq(a, b, rcond=1e-14)[0]
    return x


def _solver(fix_scale: bool, ridge_s: float, ridge_c: float):
    @F.pandas_udf(_SOLVED)
    def solve(gram: pd.Series, dof: pd.Series) -> pd.DataFrame:
        rows = []
        for g, k in zip(gram, dof):
            g = np.asarray(g, float).reshape(6, 6)
            y = np.array([0, 0, 0, 0, 1.0, 0])
            if fix_scale:
                x = _ridged(g, [1, 2, 3], y - np.array([1.0, 0, 0, 0, 0, 0]), [(2, 0.0, ridge_c)] if ridge_c > 0 else [])
                rows.append((1.0, *x))
            elif k == 4:
                x = _ridged(g, [0, 1, 2, 3], y, [p for p in ((0, 1.0, ridge_s), (3, 0.0, ridge_c)) if p[2] > 0])
                rows.append(tuple(x))
            else:
                rows.append((*_ridged(g, [0, 1, 2], y, []), 0.0))
        return pd.DataFrame(rows, columns=list(THETA), dtype=float)

    return solve


def _assigned(pixels: DataFrame, fit: DataFrame, planes: DataFrame, by: list[str], window: float) -> DataFrame:
    """by..., plane, dz, q, xq, yq, r, off: each pixel with every plane within ``window`` of its corrected depth."""
    # a handful of planes for each group; pixels of a few groups stay where they are, and no list is walked for a pixel
    known = few(materialise(fit.select(*by, *THETA).join(planes.select(*by, "plane", "nx", "ny", "nz", "off"), by), "field-known"))
    now = pixels.join(known, by).withColumns({"_dc": F.col("z") * (F.col("s") + F.col("a") * F.col("rx") + F.col("b") * F.col("ry")) + F.col("c"), "r": F.col("nx") * F.col("rx") + F.col("ny") * F.col("ry") + F.col("nz")})
    now = now.withColumn("_zt", F.when(F.abs("r") > 1e-9, F.col("off") / F.col("r"))).filter((F.col("_zt") > 0) & (F.abs(F.col("_dc") - F.col("_zt")) <= window)).withColumn("q", F.col("z") * F.col("r"))
    return now.select(*by, "plane", (F.col("_dc") - F.col("_zt")).alias("dz"), "q", (F.col("rx") * F.col("q")).alias("xq"), (F.col("ry") * F.col("q")).alias("yq"), "r", "off")


def field_fit(
    pixels: DataFrame, planes: DataFrame, by: list[str], steps: list[float], dof: int = 4, fix_scale: bool = False, ridge_s: float = 0.0, ridge_c: float = 0.0, min_plane_points: int = 400,
    min_samples: int = 2000, max_scale_dev: float = 0.2, max_gain_span: float = 0.25, max_offset: float = 0.5, start: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fits (s, a, b, c) per group against all its planes at once: (fit, log).

    ``pixels``: by..., z, rx, ry; ``planes``: by..., plane, nx, ny, nz, off. Each pass assigns pixels through the field so
    far within its window of ``steps``; planes with ``min_plane_points`` take part. One plane cannot tell s from c, so c is
    then 0, or with ``fix_scale`` s stays 1 and c is solved. A pass whose result leaves the guard rails (scale, gain span
    over the frame, offset, positive gain) changes nothing. A pass without enough samples ends the group: it keeps what
    it had, or, before any pass, is unsolved with s 1 and zeros.

    fit: by..., s, a, b, c, solved, accepted (passes), reason. log: by..., pass, n, planes, s, a, b, c, span, rejected.
    """
    rows = materialise(pixels.filter("z > 0").select(*by, *[F.col(c).cast("double").alias(c) for c in ("z", "rx", "ry")]), "field-pixels")
    frame = rows.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("rx", "ry") for n, f in (("lo", F.min), ("hi", F.max))])
    frame = materialise(frame, "field-frames")
    first = frame.select(*by)
    if start is None:
        first = first.withColumns(dict(zip(THETA, (F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))))
    else:
        first = first.join(start.select(*by, *THETA), by)
    state = materialise(first.withColumns({"going": F.lit(True), "passes": F.lit(0), "accepted": F.lit(0), "reason": F.lit(None).cast("string")}), "field-state")
    columns = ("q", "xq", "yq", "r", "off", "_one")
    solve = _solver(fix_scale, ridge_s, ridge_c)
    logs = None
    for k, window in enumerate(steps):
        hit = _assigned(rows, state.filter("going"), planes, by, window).withColumn("_one", F.lit(1.0))
        per = hit.groupBy(*by, "plane").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(x) * F.col(y)).alias(f"m{i}{j}") for i, x in enumerate(columns) for j, y in enumerate(columns) if i <= j])
        per = per.filter(F.col("n") >= min_plane_points)
        gram = F.array(*[F.col(f"m{min(i, j)}{max(i, j)}") for i in range(6) for j in range(6)])
        sums = per.groupBy(*by).agg(F.count(F.lit(1)).alias("planes"), F.sum("n").alias("n"), *[F.sum(f"m{i}{j}").alias(f"m{i}{j}") for i in range(6) for j in range(i, 6)]).filter(F.col("n") >= min_samples)
        use = F.when((F.col("planes") >= 2) & F.lit(dof == 4), 4).otherwise(3)
        new = sums.withColumn("_x", solve(gram, use)).select(*by, "planes", "n", *[F.col(f"_x.{c}").alias("n" + c) for c in THETA])
        j = state.join(frame, by).join(new, by, "left")
        corners = [F.col("ns") + F.col("na") * F.col(f"{x}_rx") + F.col("nb") * F.col(f"{y}_ry") for x in ("lo", "hi") for y in ("lo", "hi")]
        low, high = F.least(*corners), F.greatest(*corners)
        bad = F.when(F.lit(not fix_scale) & (F.abs(F.col("ns") - 1) > max_scale_dev), "scale").when(high - low > max_gain_span, "gain span").when(F.abs("nc") > max_offset, "offset").when(~(low > 0), "gain not positive")
        going, enough = F.col("going"), F.col("n").isNotNull()
        j = j.withColumns({"_bad": F.when(going & enough, bad), "_span": high - low})
        step = materialise(j, "field-pass")
        log = step.filter(going & enough).select(*by, F.lit(k).cast("long").alias("pass"), "n", F.col("planes").cast("long").alias("planes"), *[F.col("n" + c).alias(c) for c in THETA], F.col("_span").alias("span"), F.col("_bad").alias("rejected"))
        logs = log if logs is None else logs.unionByName(log)
        good = going & enough & F.col("_bad").isNull()
        state = materialise(step.select(
            *by, *[F.when(good, F.col("n" + c)).otherwise(F.col(c)).alias(c) for c in THETA], (going & enough).alias("going"), (F.col("passes") + (going & enough).cast("int")).alias("passes"),
            (F.col("accepted") + good.cast("int")).alias("accepted"), F.when(going & ~enough, F.when(F.col("passes") > 0, "too few samples in a later window").otherwise("too few samples")).otherwise(F.col("reason")).alias("reason")), "field-state")
    return state.select(*by, *THETA, (F.col("passes") > 0).alias("solved"), "accepted", "reason"), logs


def field_residuals(pixels: DataFrame, planes: DataFrame, fit: DataFrame, by: list[str], window: float, min_count: int = 100) -> DataFrame:
    """by..., plane, n, rms: perpendicular residual of the corrected depth on each plane with ``min_count`` pixels within ``window``."""
    near = _assigned(pixels.filter("z > 0"), fit, planes, by, window)
    r = F.col("dz") * F.col("r")
    return near.groupBy(*by, "plane").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(r * r)).alias("rms")).filter(F.col("n") >= min_count)


def field_fit_bootstrapped(
    pixels: DataFrame, planes: DataFrame, by: list[str], bootstrap: str, wide: float, narrow: float, final: float, passes: int = 4, slack: float = 0.0005, min_eval: int = 100, **options,
) -> tuple[DataFrame, DataFrame]:
    """Fits the plane named ``bootstrap`` alone within wide windows, then all planes from there within narrow ones: (fit, log).

    One plane cannot be taken for another however wide the window, and after it the others are near enough for a narrow
    one. The second stage counts only if its worst residual over the planes is no more than ``slack`` above the first
    stage's worst on the planes it did not see. fit: by..., s, a, b, c, stage, reason, held_rms (first stage, unseen
    planes), worst_rms (second stage, all), unverified. Stages: ``stage2``; ``stage1_kept`` with the reason;
    ``stage1_only`` where there is no other plane; ``stage1_failed``; ``single`` for groups without the plane, which are
    fitted in one stage. log: passes of every stage, by..., stage, pass, ....
    """
    rows = materialise(pixels.select(*by, "z", "rx", "ry"), "field-source")
    every = materialise(planes.select(*by, F.col("plane").cast("string").alias("plane"), "nx", "ny", "nz", "off"), "field-planes")
    boot = every.filter(F.col("plane") == bootstrap)
    rest = every.join(boot.select(*by).distinct(), by, "left_semi").filter(F.col("plane") != bootstrap)
    groups = materialise(rows.select(*by).distinct(), "field-groups")
    known = few(materialise(groups.join(boot.select(*by).distinct(), by, "left_semi"), "field-known"))
    lone = few(materialise(groups.join(known, by, "left_anti"), "field-lone"))
    one, log1 = field_fit(rows.join(known, by, "left_semi"), boot, by, windows(wide, final, passes), dof=3, **options)
    one = materialise(one, "field-one")
    held = field_residuals(rows, rest, one.filter("solved"), by, final, min_eval).groupBy(*by).agg(F.max("rms").alias("held_rms"))
    more = rest.select(*by).distinct()
    second = few(materialise(one.filter("solved").join(more, by, "left_semi"), "field-second"))
    two, log2 = field_fit(rows.join(second.select(*by), by, "left_semi"), every, by, windows(narrow, final, passes), start=second, **options)
    two = materialise(two, "field-two")
    worst = field_residuals(rows, every, two.filter("accepted > 0"), by, final, min_eval).groupBy(*by).agg(F.max("rms").alias("worst_rms"))
    single, log3 = field_fit(rows.join(lone, by, "left_semi"), every, by, windows(wide, final, passes), **options)
    j = one.join(more.withColumn("_more", F.lit(True)), by, "left").join(two.select(*by, *[F.col(c).alias("t" + c) for c in THETA], F.col("solved").alias("t_solved"), F.col("accepted").alias("t_accepted"), F.col("reason").alias("t_reason")), by, "left").join(held, by, "left").join(worst, by, "left")
    why = F.when(~F.col("t_solved"), F.concat(F.lit("second stage: "), F.col("t_reason"))).when(F.col("t_accepted") == 0, "every pass of the second stage was rejected").when(
        F.col("held_rms").isNull(), "nothing to hold the first stage against").when(F.coalesce(F.col("worst_rms") <= F.col("held_rms") + slack, F.lit(False)), F.lit(None)).otherwise("the second stage is worse")
    j = j.withColumn("_why", why).withColumn("stage", F.when(~F.col("solved"), "stage1_failed").when(F.col("_more").isNull(), "stage1_only").when(F.col("_why").isNull(), "stage2").otherwise("stage1_kept"))
    taken = F.col("stage") == "stage2"
    unsure = (F.col("stage") == "stage1_kept") & (F.col("t_accepted") > 0) & F.col("held_rms").isNull()
    out = j.select(*by, *[F.when(taken, F.col("t" + c)).otherwise(F.col(c)).alias(c) for c in THETA], "stage", F.when(F.col("stage") == "stage1_failed", F.col("reason")).when(F.col("stage") == "stage1_kept", F.col("_why")).alias("reason"),
                   "held_rms", "worst_rms", F.coalesce(unsure, F.lit(False)).alias("unverified"))
    alone = single.select(*by, *THETA, F.lit("single").alias("stage"), "reason", F.lit(None).cast("double").alias("held_rms"), F.lit(None).cast("double").alias("worst_rms"), F.lit(False).alias("unverified"))
    logs = log1.withColumn("stage", F.lit(1)).unionByName(log2.withColumn("stage", F.lit(2))).unionByName(log3.withColumn("stage", F.lit(0)))
    return out.unionByName(alone), logs
