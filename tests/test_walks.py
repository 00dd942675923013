"""Ordered matching and descriptor search against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from voxelloom.operators import boxes, joins


def _pairs(det, ref, radius):
    free, out = dict(ref), {}
    for i, (x, y) in sorted(det.items()):
        near = sorted((float(np.hypot(x - u, y - v)), k) for k, (u, v) in free.items() if np.hypot(x - u, y - v) < radius)
        if near:
            out[i] = near[0][1]
            del free[near[0][1]]
    return out


def test_crowded_places_are_walked_without_pairs(spark, monkeypatch):
    """45 detections and references on nine places and 30 anywhere: the ordered walk, and no table of pairs."""
    rng = np.random.default_rng(3)
    det = {k: (0.45 * (k % 3) + 0.02, 0.45 * (k // 3 % 3)) for k in range(45)} | {1000 + k: tuple(map(float, p)) for k, p in enumerate(rng.uniform(0, 3, (30, 2)))}
    ref = {k: (0.45 * (k % 3), 0.45 * (k // 3 % 3) + k % 4 / 100) for k in range(45)} | {1000 + k: tuple(map(float, p)) for k, p in enumerate(rng.uniform(0, 3, (30, 2)))}
    frame = lambda d: spark.createDataFrame([("a", k, *p) for k, p in d.items()], "g string, id long, x double, y double")
    want = _pairs(det, ref, 0.9)
    slow = boxes.match_greedy(frame(det), frame(ref), ["g"], 0.9, walk_rows=0).collect()
    assert {r["id"]: r["ref_id"] for r in slow} == want

    def no_pairs(*args, **kw):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(boxes, "_candidates", no_pairs)
    got = boxes.match_greedy(frame(det), frame(ref), ["g"], 0.9).collect()
    assert {r["id"]: r["ref_id"] for r in got} == want and sorted(got[0].asDict()) == ["dist", "g", "id", "ref_id"]


def test_descriptors_meet_as_matrices(spark, monkeypatch):
    """Several blocks a side, equal descriptors, an image of one descriptor: the two nearest by distance and id."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 6)).astype(np.float32)
    v[50:60] = v[40:50]
    rows = [(k % 2, k, [float(x) for x in a]) for k, a in enumerate(v)] + [(2, 900, [1.0] * 6)]
    df = spark.createDataFrame(rows, "image int, kp_id long, desc array<float>")
    monkeypatch.setattr(joins, "SIDE", 7)
    got = {(r["image"], r["kp_id"]): r for r in joins.descriptor_match(df, df.filter("image < 2").withColumn("image", (F.col("image") + 1) % 2).unionByName(df.filter("image = 2")), ["image"], 2.0).collect()}
    want = 0
    for image, k, _ in rows[:-1]:
        near = sorted((float(np.sqrt(((v[k].astype(float) - v[j].astype(float)) ** 2).sum())), j) for j in range(90) if j % 2 != image)
        if near[0][0] < 2.0 * near[1][0]:
            want += 1
            r = got[(image, k)]
            assert r["match"] == near[0][1] and abs(r["d1"] - near[0][0]) < 1e-12 and abs(r["d2"] - near[1][0]) < 1e-12
    assert len(got) == want
