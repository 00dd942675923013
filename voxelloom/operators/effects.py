"""Placement effects: pooled line, per-camera deviations and per-capture drift, with their scatter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.groups import median, quantiles
from voxelloom.operators.robust import least_squares

STATS = ["n", "sx", "sy", "sxx", "sxy"]


def placement_rows(samples: DataFrame, by: list[str], value: str, truth: str, **kw) -> DataFrame:
    """One row per placement and camera: medians, and the rms about the median."""
    long = samples.select(*by, F.col(value).alias("h_meas"), F.col(truth).alias("h_true")).unpivot(by, ["h_meas", "h_true"], "what", "val")
    med = median(long, [*by, "what"], "val", "m", **kw).groupBy(*by).agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("what") == "h_meas", F.col("m"))).alias("h_meas"),
        F.max(F.when(F.col("what") == "h_true", F.col("m"))).alias("h_true"),
    )
    within = samples.select(*by, F.col(value).alias("_v")).join(med.select(*by, "h_meas"), by).groupBy(*by).agg(
        F.sqrt(F.avg(F.pow(F.col("_v") - F.col("h_meas"), 2))).alias("within_rms")
    )
    return med.join(within, by)


def effect_cells(rows: DataFrame, by: list[str], x: str, y: str, camera: str = "camera", capture: str = "capture") -> DataFrame:
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    return rows.filter(cx.isNotNull() & cy.isNotNull()).groupBy(*by, F.col(camera).alias("camera"), F.col(capture).alias("capture")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(cx).alias("sx"), F.sum(cy).alias("sy"), F.sum(cx * cx).alias("sxx"), F.sum(cx * cy).alias("sxy")
    )


def _pooled(cells: DataFrame, by: list[str]) -> DataFrame:
    t = cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in STATS])
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    p = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    return t.filter(F.abs(det) > 1e-12).withColumn("p_bar", p).select(
        *by, "p_bar", ((F.col("sy") - F.col("p_bar") * F.col("sx")) / F.col("n")).alias("q_bar")
    )


def solve_effects(cells: DataFrame, by: list[str], slopes: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pooled, cameras, captures) from ``effect_cells``.

    Capture offsets are eliminated in closed form, which leaves a system of two unknowns per camera;
    only that camera-by-camera matrix (a rig has a handful of cameras) reaches the solver.
    Slopes and offsets of the cameras, and the capture offsets, each sum to zero.
    """
    pooled = _pooled(cells, by)
    c = cells.join(pooled, by).select(
        *by, "camera", "capture", "n", "sx", "sxx",
        (F.col("sy") - F.col("p_bar") * F.col("sx") - F.col("q_bar") * F.col("n")).alias("sr"),
        (F.col("sxy") - F.col("p_bar") * F.col("sxx") - F.col("q_bar") * F.col("sx")).alias("sxr"),
    )
    totals = c.groupBy(*by, "capture").agg(F.sum("n").alias("tn"), F.sum("sr").alias("tr"))
    left = c.join(totals, [*by, "capture"])
    right = c.select(*by, "capture", F.col("camera").alias("camera_b"), F.col("n").alias("n_b"), F.col("sx").alias("sx_b"))
    pairs = left.join(right, [*by, "capture"])
    own = F.when(F.col("camera") == F.col("camera_b"), 1.0).otherwise(0.0)
    matrix = pairs.groupBy(*by, "camera", "camera_b").agg(
        F.sum(own * F.col("sxx") - F.col("sx") * F.col("sx_b") / F.col("tn")).alias("aa"),
        F.sum(own * F.col("sx") - F.col("sx") * F.col("n_b") / F.col("tn")).alias("ab"),
        F.sum(own * F.col("sx") - F.col("n") * F.col("sx_b") / F.col("tn")).alias("ba"),
        F.sum(own * F.col("n") - F.col("n") * F.col("n_b") / F.col("tn")).alias("bb"),
        F.sum(own * (F.col("sxr") - F.col("sx") * F.col("tr") / F.col("tn"))).alias("ra"),
        F.sum(own * (F.col("sr") - F.col("n") * F.col("tr") / F.col("tn"))).alias("rb"),
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cams = sorted(pdf["camera"].unique())
        at = {cam: i for i, cam in enumerate(cams)}
        k = len(cams)
        m, rhs = np.zeros((2 * k, 2 * k)), np.zeros(2 * k)
        i, j = pdf["camera"].map(at).to_numpy(), pdf["camera_b"].map(at).to_numpy()
        m[i, j], m[i, k + j], m[k + i, j], m[k + i, k + j] = (pdf[c].to_numpy() for c in ("aa", "ab", "ba", "bb"))
        np.add.at(rhs, i, pdf["ra"].to_numpy())
        np.add.at(rhs, k + i, pdf["rb"].to_numpy())
        if not slopes:
            m, rhs = m[k:, k:], rhs[k:]
        blocks = len(rhs) // k
        gauge = np.kron(np.eye(blocks), np.ones((1, k)))
        kkt = np.block([[m, gauge.T], [gauge, np.zeros((blocks, blocks))]])
        theta = np.linalg.lstsq(kkt, np.concatenate([rhs, np.zeros(blocks)]), rcond=None)[0][: len(rhs)]
        a = theta[:k] if slopes else np.zeros(k)
        out = pd.DataFrame({"camera": cams, "a": a, "b": theta[-k:]})
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out[[*by, "camera", "a", "b"]]

    types = dict(cells.dtypes)
    schema = ", ".join([*[f"`{b}` {types[b]}" for b in by], f"camera {types['camera']}", "a double", "b double"])
    keys = by or ["_all"]
    if not by:
        raise ValueError("effects are solved per rig: pass at least one grouping key")
    cameras = matrix.groupBy(*keys).applyInPandas(solve, schema)
    per = left.join(cameras, [*by, "camera"]).groupBy(*by, "capture").agg(
        (F.sum(F.col("sr") - F.col("a") * F.col("sx") - F.col("b") * F.col("n")) / F.sum("n")).alias("e0")
    )
    captures = per.join(per.groupBy(*by).agg(F.avg("e0").alias("_g")), by).select(*by, "capture", (F.col("e0") - F.col("_g")).alias("e"))
    return pooled, cameras, captures


def cluster_bootstrap(cells: DataFrame, by: list[str], draws: int, seed: int = 0, min_rows: int = 3) -> DataFrame:
    """Standard deviation (ddof 1) of pooled and per-camera effects over resampled captures.

    A capture drawn twice keeps the same offset in both copies, so a multiplicity on its cells is the
    same fit. Draws with a camera below ``min_rows`` or a single height are left out.
    """
    from voxelloom.operators.groups import rank_in_group

    ids = cells.select(*by, "capture").distinct().withColumn("_h", F.xxhash64("capture"))
    numbered = rank_in_group(ids, by, [("_h", "asc"), ("capture", "asc")], "_i").drop("_h")
    counts = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picks = (
        counts.select(*by, "_k", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        .repartition(tasks, *by, "draw")  # the draws of one rig must not become rows in one task
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))).alias("_slot"))
        .select(*by, "draw", F.pmod(F.xxhash64(F.lit(seed), "draw", "_slot"), F.col("_k")).alias("_i"))
        .groupBy(*by, "draw", "_i").agg(F.count(F.lit(1)).alias("_m"))
    )
    drawn = cells.join(picks.join(numbered, [*by, "_i"]), [*by, "capture"]).select(
        *by, "draw", "camera", "capture", *[(F.col(c) * F.col("_m")).alias(c) for c in STATS], F.round(F.col("sx") / F.col("n"), 3).alias("_x")
    )
    cams = cells.groupBy(*by).agg(F.count_distinct("camera").alias("_cams"))
    ok = (
        drawn.groupBy(*by, "draw", "camera").agg(F.sum("n").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        .groupBy(*by, "draw").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .join(cams, by).filter((F.col("n") >= min_rows) & (F.col("c") == F.col("_cams")) & (F.col("hi") > F.col("lo")))
    )
    pooled, cameras, _ = solve_effects(drawn.join(ok.select(*by, "draw"), [*by, "draw"], "left_semi").drop("_x"), [*by, "draw"])
    rig = pooled.groupBy(*by).agg(F.count(F.lit(1)).alias("draws"), F.stddev_samp("p_bar").alias("p_sd"), F.stddev_samp("q_bar").alias("q_sd"))
    return cameras.groupBy(*by, "camera").agg(F.stddev_samp("a").alias("a_sd"), F.stddev_samp("b").alias("b_sd")).join(rig, by)


def common_mode_split(rows: DataFrame, label: list[str], capture: str, camera: str, error: str, min_views: int = 3, min_captures: int = 3) -> DataFrame:
    """Height error shared by all views of a capture against the part that differs between them."""
    per_view = rows.groupBy(*label, capture, camera).agg(F.avg(error).alias("_e"))
    cap = per_view.groupBy(*label, capture).agg(
        F.count(F.lit(1)).alias("k"), F.avg("_e").alias("m"), F.sum("_e").alias("s"), F.sum(F.col("_e") * F.col("_e")).alias("ss")
    ).filter(F.col("k") >= min_views)
    resid_ss = F.sum(F.col("ss") - F.col("k") * F.col("m") * F.col("m"))
    total_var = F.sum("ss") / F.sum("k") - F.pow(F.sum("s") / F.sum("k"), 2)
    return cap.groupBy(*label).agg(
        F.count(F.lit(1)).alias("n_captures"),
        F.stddev_samp("m").alias("shared_sd"),
        F.sqrt(resid_ss / (F.sum("k") - 1)).alias("per_view_sd"),
        F.when(total_var > 0, 1.0 - (resid_ss / F.sum("k")) / total_var).otherwise(0.0).alias("shared_fraction"),
    ).filter(F.col("n_captures") >= min_captures)


def layer_stats(rows: DataFrame, label: list[str], capture: str, before: str, after: str | None = None, **kw) -> DataFrame:
    """Spread over cameras per capture (two rows or more): median and largest, before and after correction."""
    values = [c for c in (before, after) if c]
    cap = rows.groupBy(*label, capture).agg(
        F.count(F.lit(1)).alias("k"), *[(F.max(c) - F.min(c)).alias(f"_{i}") for i, c in enumerate(values)]
    ).filter("k >= 2")
    out = cap.groupBy(*label).agg(F.count(F.lit(1)).alias("n_captures"), *[F.max(f"_{i}").alias(f"{n}_max") for i, n in enumerate(["before", "after"][: len(values)])])
    for i, n in enumerate(["before", "after"][: len(values)]):
        out = out.join(median(cap, label, f"_{i}", f"{n}_median", **kw).drop("n"), label)
    return out


def range_anchor(samples: DataFrame, by: list[str], true: str, measured: str, **kw) -> DataFrame:
    """Per camera and label: median true and measured range, excess and ratio."""
    long = samples.select(*by, F.col(true).alias("true"), F.col(measured).alias("measured")).unpivot(by, ["true", "measured"], "what", "val")
    med = median(long, [*by, "what"], "val", "m", **kw).groupBy(*by).agg(
        F.max(F.when(F.col("what") == "true", F.col("m"))).alias("true_median"),
        F.max(F.when(F.col("what") == "measured", F.col("m"))).alias("measured_median"),
    )
    return med.withColumn("excess", F.col("measured_median") - F.col("true_median")).withColumn(
        "ratio", F.col("measured_median") / F.col("true_median")
    )


def range_anchor_rig(anchors: DataFrame, by: list[str]) -> DataFrame:
    return anchors.groupBy(*by).agg(F.avg("ratio").alias("ratio_mean"), F.stddev_pop("ratio").alias("ratio_sd"))


def relief_report(rows: DataFrame, by: list[str], label: str, x: str, y: str) -> DataFrame:
    """Slope k per group by least squares, and the rms of placements between and within labels."""
    lines = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("k"), F.regr_intercept(y, x).alias("c"))
    r = rows.join(lines, by).withColumn("_r", F.col(y) - (F.col("k") * F.col(x) + F.col("c")))
    per = r.groupBy(*by, label).agg(F.count(F.lit(1)).alias("m"), F.avg("_r").alias("mean"), F.var_pop("_r").alias("v"))
    parts = per.groupBy(*by).agg(
        F.sqrt(F.sum(F.col("m") * F.col("mean") * F.col("mean")) / F.sum("m")).alias("between_rms"),
        F.sqrt(F.sum(F.col("m") * F.col("v")) / F.sum("m")).alias("within_rms"),
    )
    return lines.join(parts, by)


def relief_field(placements: DataFrame, by: list[str], x: str, y: str, h_true: str, h_meas: str, within: str, min_rows: int = 3, min_field: int = 8, **kw) -> DataFrame:
    """Loss of relief per group, and whether it varies over the belt. One row per placement comes in.

    The deficit h_true - h_meas is fitted as k h + c (``compression offset``), with the rms it leaves between placements
    and the median of their own ``within``; from ``min_field`` rows on also as c0 + h (k0 + kx x + ky y), with the rms
    that leaves. Rows with a NULL in a number are left out, as are groups under ``min_rows``; of columns that
    repeat each other the field takes the shortest solution; without spread in h there is no line.
    """
    h, numbers = F.col("_h"), ["_h", "_m", "_px", "_py"]
    rows = placements.select(*by, F.col(h_true).cast("double").alias("_h"), (F.col(h_true) - F.col(h_meas)).cast("double").alias("_m"), F.col(x).cast("double").alias("_px"),
                             F.col(y).cast("double").alias("_py"), F.col(within).cast("double").alias("_w")).dropna(subset=numbers)
    design = [F.lit(1.0), h, h * F.col("_px"), h * F.col("_py")]
    lines = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_m", "_h").alias("compression"), F.regr_intercept("_m", "_h").alias("offset")).filter(F.col("n") >= min_rows)
    field = least_squares(rows, by, design, F.col("_m")).select(*by, F.when(F.col("n") >= min_field, F.col("coef")).alias("_c"))
    own = median(rows, by, "_w", "within_rms", **kw).drop("n")
    fitted = lines.join(field, by).join(own, by, "left")
    c = F.col("_c")
    left = F.col("_m") - (F.col("compression") * h + F.col("offset"))
    after = F.col("_m") - (c[0] + h * (c[1] + c[2] * F.col("_px") + c[3] * F.col("_py")))
    rms = rows.join(fitted.select(*by, "compression", "offset", "_c"), by).groupBy(*by).agg(F.sqrt(F.avg(left * left)).alias("between_rms"), F.sqrt(F.avg(after * after)).alias("field_rms"))
    return fitted.join(rms, by).select(
        *by, "n", "compression", "offset", "between_rms", "within_rms", "field_rms", *[c[i].alias(name) for i, name in enumerate(("field_c0", "field_k0", "field_kx", "field_ky"))])


def plane_separation_report(rows: DataFrame, by: list[str], label: str, camera: str, measured: str, true: str, **kw) -> DataFrame:
    """Per label: nominal and measured height, scatter, and the largest camera-to-camera difference."""
    per = median(rows, [*by, label, camera], measured, "m", **kw).drop("n")
    across = per.groupBy(*by, label).agg((F.max("m") - F.min("m")).alias("camera_delta"))
    med = quantiles(rows, [*by, label], measured, {"measured_median": 0.5}, **kw)
    nominal = rows.groupBy(*by, label).agg(F.avg(true).alias("nominal"), F.stddev_samp(measured).alias("scatter"))
    return med.join(nominal, [*by, label]).join(across, [*by, label]).withColumn("error", F.col("measured_median") - F.col("nominal"))


def belt_vs_board_drift(belt: DataFrame, board: DataFrame, by: list[str], capture: str, excess: str, min_pixels: int = 500, **kw) -> DataFrame:
    """Median belt excess (enough pixels) beside the board's, and their correlation over captures."""
    keys = [*by, capture]
    b = median(belt, keys, excess, "belt_excess", **kw).filter(F.col("n") >= min_pixels).drop("n")
    o = median(board, keys, excess, "board_excess", **kw).drop("n")
    both = b.join(o, keys)
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("captures"), F.corr("belt_excess", "board_excess").alias("correlation"),
        F.avg(F.col("board_excess") - F.col("belt_excess")).alias("mean_difference"),
    )


def grade_summary(matched: DataFrame, by: list[str], parcel: str, error: str, centre: str, spread: str, **kw) -> DataFrame:
    """Height error mean, sd, signed worst; centre mean and worst; correlation with view spread if more
    than four rows; repeatability as the median over parcels of their sd."""
    base = matched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("held"), F.avg(error).alias("mean_error"), F.stddev_samp(error).alias("sd_error"),
        F.max_by(error, F.struct(F.abs(error), F.col(error))).alias("worst_error"), F.avg(centre).alias("centre_mean"), F.max(centre).alias("centre_worst"),
        F.when(F.count(F.lit(1)) > 4, F.corr(error, spread)).alias("r_error_spread"),
    )
    per = matched.groupBy(*by, parcel).agg(F.count(F.lit(1)).alias("k"), F.stddev_samp(error).alias("_sd")).filter("k >= 2")
    return base.join(median(per, by, "_sd", "repeatability", **kw).drop("n"), by, "left")


def centred(df: DataFrame, by: list[str], value: str, name: str = "centred", how: str = "mean", **kw) -> DataFrame:
    """Value minus its group's mean or median, by joining one row per group."""
    if how == "mean":
        ref = df.groupBy(*by).agg(F.avg(value).alias("_ref"))
    else:
        ref = median(df, by, value, "_ref", **kw).drop("n")
    return df.join(ref, by).withColumn(name, F.col(value) - F.col("_ref")).drop("_ref")
