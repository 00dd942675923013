"""Passes over hot groups meet equal rows once, with a count, and give what plain passes give."""

import math

import pytest
from pyspark.sql import functions as F

from voxelloom.operators import align, groups, rasters, robust


@pytest.fixture
def rows(spark):
    r = spark.range(6000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("u"), (F.col("id") % 5 * 3 + F.col("id") % 7 + 20).cast("double").alias("h"))
    return r.withColumns({"h0": F.lit(60.0), "h1": -F.col("h")})


def _written(monkeypatch, *modules):
    """Rows of every table written by ``modules``, by tag."""
    sizes, plain = {}, groups.materialise

    def spy(df, tag="table"):
        out = plain(df, tag)
        sizes[tag] = max(sizes.get(tag, 0), out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "materialise", spy)
    return sizes


OPS = {
    "quantiles": lambda r, n: groups.quantiles(r, ["g"], "h", {"a": 0.3, "b": 0.5}, hot_rows=n),
    "order_statistics": lambda r, n: groups.order_statistics(r, ["g"], "h", {"a": groups.nearest(0.3), "b": groups.linear(0.77)}, hot_rows=n),
    "depth_quantile_bins": lambda r, n: rasters.depth_quantile_bins(r, ["g"], "u", "h", 4, hot_rows=n),
    "gauge_from_deck": lambda r, n: align.gauge_from_deck(r, ["g"], "h", 40.0, 3, 15.0, 1, hot_rows=n),
    "gauge_multi_camera": lambda r, n: align.gauge_multi_camera(r, ["g"], 0.5, 8.0, hot_rows=n),
    "robust_line": lambda r, n: robust.robust_line(r, ["g"], "u", "h", iters=3, hot_rows=n),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_equal_rows_are_met_once(rows, monkeypatch, name):
    want = sorted(OPS[name](rows, 10**9).collect())
    written = _written(monkeypatch, groups, align, rasters, robust)
    for hot_rows in (100, 4):  # hot by rows alone, and by distinct values
        got = sorted(OPS[name](rows, hot_rows).collect())
        assert len(got) == len(want) and all(x == pytest.approx(y, rel=1e-9) for a, b in zip(got, want) for x, y in zip(a, b))
    written.pop("fit-rows", None)
    assert written and max(written.values()) <= 3 * 35, written


def test_bilinear_samples_meet_one_row_each(spark):
    from voxelloom.operators import joins

    z = {(u, v): 1.0 + 0.3 * u + 0.07 * u * v for u in range(6) for v in range(4) if (u, v) != (2, 2)}
    pix = spark.createDataFrame([("a", u, v, d) for (u, v), d in z.items()], "camera string, u long, v long, z double")
    at = [("a", i, 0.13 * i % 6.3 - 0.4, 0.29 * i % 4.1 - 0.3) for i in range(300)] + [("b", 900, 1.5, 1.5), ("a", 901, None, 1.0), ("a", 902, 2.0, 1.0)]
    keys = spark.createDataFrame(at, "camera string, kp_id long, u double, v double")
    for inverse in (False, True):
        df = joins.sample_depth(keys, pix, ["camera"], 6, 4, "bilinear", inverse)
        got = {r["kp_id"]: r["depth"] for r in df.collect()}
        assert len(got) == len(at) and sum(v is not None for v in got.values()) > 50
        for camera, i, u, v in at:
            four = None if u is None else [(z.get((math.floor(u) + a, math.floor(v) + b)), (u % 1 if a else 1 - u % 1) * (v % 1 if b else 1 - v % 1)) for a in (0, 1) for b in (0, 1)]
            if camera != "a" or four is None or any(d is None for d, _ in four):
                assert got[i] is None, i
            else:
                want = 1 / sum(w / d for d, w in four) if inverse else sum(w * d for d, w in four)
                assert got[i] == pytest.approx(want, rel=1e-12), i
        plan = df._jdf.queryExecution().toString()
        assert "Exchange hashpartitioning" not in plan and "Generate" not in plan  # keypoints stay where they are


def test_hypotheses_are_counted_in_one_loop(spark):
    from voxelloom.operators import planes

    pts = [("a" if i % 4 else "b", i, 0.1 * (i % 13), 0.07 * (i % 17), 0.5 + 0.002 * (i % 3) if i % 5 else 0.1 * (i % 7)) for i in range(400)]
    df = spark.createDataFrame(pts, "g string, pid long, x double, y double, z double")
    hyp = planes.hypotheses(df, ["g"], 16, 3, "pid")
    best = planes.best_hypothesis(df, hyp, ["g"], 0.01)
    assert best._jdf.queryExecution().toString().count("count_if(") == 0  # a column for each trial was not compiled
    got = {r["g"]: r for r in best.collect()}
    for h in hyp.collect():
        mine = [p for p in pts if p[0] == h["g"]]
        counts = [sum(abs(e["nx"] * p[2] + e["ny"] * p[3] + e["nz"] * p[4] + e["d"]) <= 0.01 for p in mine) for e in h["hyp"]]
        first, r = h["hyp"][counts.index(max(counts))], got[h["g"]]
        assert (r["total"], r["inliers"], r["nx"], r["ny"], r["nz"], r["d"]) == (len(mine), max(counts), first["nx"], first["ny"], first["nz"], first["d"])
