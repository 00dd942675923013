"""Queries and operators cover all of their input: one test for each place that once took a part of it."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from voxelloom.operators import align, boxes, spatial

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@given
def test_match_by_dimensions_meets_every_reference(spark):
    got = entry_mod.queries()["match_by_dimensions"](spark, FOLDER).collect()
    ids = {r["p_partkey"] for r in spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey").collect()}
    # each part is detected at its own size, so all find one of that size and no reference is left
    assert {r["id"] for r in got} == ids == {r["ref_id"] for r in got} and max(r["cost"] for r in got) == 0.0


def test_match_by_dimensions_equals_the_ordered_walk(spark):
    rng = np.random.default_rng(21)
    det = pd.DataFrame({"scene": rng.integers(0, 4, 500), "id": rng.permutation(500), "length": rng.integers(1, 12, 500) / 8, "width": rng.integers(1, 12, 500) / 8})
    ref = pd.DataFrame({"scene": rng.integers(0, 4, 400), "id": rng.permutation(400) + 1000, "length": rng.integers(1, 14, 400) / 8, "width": rng.integers(1, 14, 400) / 8})
    det.loc[det.scene == 3, ["length", "width"]] = rng.random(((det.scene == 3).sum(), 2))
    want = {}
    for scene, part in det.groupby("scene"):
        free = ref[ref.scene == scene].sort_values("id")
        l, w = free[["length", "width"]].max(axis=1), free[["length", "width"]].min(axis=1)
        for d in part.sort_values("id").itertuples():
            if len(l):
                best = ((max(d.length, d.width) - l).abs() + (min(d.length, d.width) - w).abs()).idxmin()
                want[d.id] = ref.id[best]
                l, w = l.drop(best), w.drop(best)
    got = boxes.match_by_dimensions(spark.createDataFrame(det), spark.createDataFrame(ref), ["scene"]).collect()
    assert {r["id"]: r["ref_id"] for r in got} == want


@given
def test_views_meet_every_ordered_pair_of_cameras(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    cameras = {r["label"] for r in e.select("label").distinct().collect()}
    for name in ("cross_view_residual", "zbuffer_overlap_all"):
        got = entry_mod.queries()[name](spark, FOLDER).collect()
        assert {r["view"] for r in got} == {r["camera"] for r in got} == cameras and any(r["view"] > r["camera"] + 1 for r in got) and any(r["view"] < r["camera"] for r in got)


def test_outlier_removal_keeps_points_farther_apart_than_the_cap(spark):
    rng = np.random.default_rng(22)
    xyz = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(0, 4, (60, 3)), rng.normal(0, 1, (3, 3))])
    camera = np.repeat([0, 1, 2], [60, 60, 3])
    df = frame(spark, camera=camera, pid=np.arange(len(xyz)), x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2])
    got = {r["pid"]: r["mean_dist"] for r in spatial.outlier_removal(df, ["camera"], 4, 1.0, 0.4).collect()}
    want = {}
    for c in range(3):
        p, ids = xyz[camera == c], np.flatnonzero(camera == c)
        mean = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), axis=1)[:, 1:5].mean(axis=1)
        want |= {i: m for i, m in zip(ids, mean) if m <= mean.mean() + mean.std(ddof=1)}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_icp_gates_at_all_distances_and_says_whether_it_converged(spark):
    rng = np.random.default_rng(23)
    q = rng.uniform(-1, 1, (200, 2))
    c, s = math.cos(0.02), math.sin(0.02)
    p = (q - [0.02, -0.01]) @ np.array([[c, -s], [s, c]])
    far = np.arange(200) >= 120  # four in ten points have nothing near: the gate at 70 % lies beyond the cap
    p[far] += [30, 0]
    src = frame(spark, rig=np.zeros(200, int), pid=np.arange(200), x=p[:, 0], y=p[:, 1])
    dst = frame(spark, rig=np.zeros(200, int), pid=np.arange(200), x=q[:, 0], y=q[:, 1])
    d = np.linalg.norm(p[:, None] - q[None], axis=2).min(axis=1)
    one = align.icp_planar(src, dst, ["rig"], 8.0, 1, levels=1).first()
    assert one["pairs"] == (d <= np.percentile(d, 70)).sum() == 140 and not one["converged"]
    assert align.icp_planar(dst, dst, ["rig"], 0.5, 1, levels=1).first()["converged"]


@given
def test_cluster_bootstrap_draws_as_often_as_the_reference(spark):
    got = entry_mod.queries()["cluster_bootstrap"](spark, FOLDER).collect()
    assert got and all(20 < r["draws"] <= 400 for r in got)


def test_neighbours_where_one_cell_of_the_cap_holds_most_points(spark):
    rng = np.random.default_rng(12)
    b = np.vstack([rng.normal(0, 0.01, (1500, 3)), np.repeat(rng.uniform(-1, 1, (4, 3)), 30, axis=0), rng.uniform(-40, 40, (60, 3))])
    a = np.vstack([rng.normal(0, 0.02, (150, 3)), b[1490:1530], rng.uniform(-45, 45, (60, 3)), [[np.nan, 0, 0]]])
    to = lambda p: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "pid long, x double, y double, z double")
    cells, depth = spatial.target_cells(to(np.vstack([b, [[np.inf, 0, 0]]])), [], 8.0, levels=2)
    assert depth > 2 and cells.filter("pts is not null").agg(F.max("m")).first()[0] <= spatial.LEAF
    dist = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for k in (1, 3):
        want = {(i, r): (int(j), dist[i, j]) for i in range(len(a) - 1) for r, j in enumerate(np.lexsort((np.arange(len(b)), dist[i]))[:k]) if dist[i, j] <= 8.0}
        got = {(r["pid"], r["rank"]): (r["nn"], r["dist"]) for r in spatial.k_nearest(to(a), to(b), [], 8.0, k, levels=2).collect()}
        assert got.keys() == want.keys()
        for key, (nn, d) in got.items():
            assert nn == want[key][0] and abs(d - want[key][1]) < 1e-12
    own = spatial.k_nearest(to(b), to(b), [], 0.5, 1, levels=2, exclude_self=True).collect()
    near = np.sqrt(((b[:, None] - b[None]) ** 2).sum(2)) + np.where(np.eye(len(b)) > 0, np.inf, 0)
    assert {r["pid"]: round(r["dist"], 9) for r in own} == {i: round(near[i].min(), 9) for i in range(len(b)) if near[i].min() <= 0.5}


def test_radius_support_in_shared_cells_and_beyond(spark):
    rng = np.random.default_rng(13)
    p = np.vstack([rng.normal(0, 0.05, (300, 3)), rng.uniform(-1, 1, (200, 3))])
    cam = [None if i % 50 == 0 else i % 3 for i in range(len(p))]
    rows = [(i, c, *map(float, r)) for i, (c, r) in enumerate(zip(cam, p))] + [(900, 1, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "pid long, camera long, x double, y double, z double")
    got = {r["pid"]: r["supported"] for r in spatial.radius_support(df, [], 0.1).collect()}
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= 0.1
    assert got == {900: False} | {i: any(near[i, j] and cam[j] is not None and cam[j] != c for j in range(len(p))) if c is not None else False for i, c in enumerate(cam)}


def test_pixels_of_few_groups_stay_where_they_are(spark):
    """A pass of the depth field broadcasts fits and planes; pixels are neither shuffled nor given lists."""
    from voxelloom.operators import depth_field

    pixels = spark.range(1000).selectExpr("id % 2 AS g", "2.0 + id % 7 / 10 AS z", "id % 11 / 50 AS rx", "id % 5 / 50 AS ry")
    planes = spark.createDataFrame([(g, n, 0.0, 0.0, 1.0, z) for g in (0, 1) for n, z in (("deck", 2.0), ("top", 2.3))], "g long, plane string, nx double, ny double, nz double, off double")
    fit = spark.createDataFrame([(g, 1.0, 0.0, 0.0, 0.0) for g in (0, 1)], "g long, s double, a double, b double, c double")
    got = depth_field._assigned(pixels, fit, planes, ["g"], 0.15)
    plan = got._jdf.queryExecution().toString()
    assert "Generate" not in plan and "broadcast" in plan
    assert got.count() == sum(abs(2.0 + i % 7 / 10 - z) <= 0.15 for i in range(1000) for z in (2.0, 2.3))
