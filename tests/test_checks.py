"""Pose angles at a right-angled pitch, and gates."""

import numpy as np
from pyspark.sql import functions as F

from voxelloom.functions import geometry as g
from voxelloom.operators import checks


def turn(roll, pitch, yaw):
    (a, b), (c, d), (e, f) = [(np.cos(np.radians(x)), np.sin(np.radians(x))) for x in (roll, pitch, yaw)]
    return np.array([[e, -f, 0], [f, e, 0], [0, 0, 1]]) @ np.array([[c, 0, d], [0, 1, 0], [-d, 0, c]]) @ np.array([[1, 0, 0], [0, a, -b], [0, b, a]])


def test_pose_angles(spark):
    cases = [(10.0, 20.0, 30.0), (-50.0, -80.0, 170.0), (25.0, 90.0, 0.0), (25.0, 90.0, 15.0), (40.0, -90.0, 0.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(k, [float(x) for x in turn(*c).ravel()]) for k, c in enumerate(cases)], "k int, R array<double>")
    p = g.pose_columns(F.col("R"))
    for r in df.select("k", "R", *[p[n].alias(n) for n in p]).collect():
        back = turn(r["roll_deg"], r["pitch_deg"], r["yaw_deg"])
        assert np.abs(back - np.array(r["R"]).reshape(3, 3)).max() < 1e-6
        if abs(cases[r["k"]][1]) == 90:
            assert r["yaw_deg"] == 0
    q = df.select(*[p[n].alias(n) for n in ("qw", "qx", "qy", "qz")]).collect()
    assert all(abs(sum(v * v for v in r) - 1) < 1e-9 for r in q)


def test_gates(spark):
    records = spark.createDataFrame([(1, "a", "7"), (1, "a", "8"), (1, "a", "8"), (1, "b", None), (2, "x", "9"), (2, None, "7")], "run int, camera string, serial string")
    cameras = spark.createDataFrame([("a", 7), ("b", 5)], "camera string, serial int")
    assert {tuple(r) for r in checks.serial_gate(records, cameras, ["run"]).collect()} == {(1, "a", "8", "7", 2), (2, "x", "9", None, 1), (2, None, "7", None, 1)}
    pix = spark.createDataFrame([(1, 255.0, 0.0, 1.0), (1, 2.0, None, 1.0), (1, 100.0, 200.0, None), (1, None, None, None)], "g int, r double, gg double, b double")
    r = checks.channel_clipping(pix, ["g"], ["r", "gg", "b"]).first()
    assert (r["clipped_high"], r["clipped_low"], r["level"]) == (1 / 3, 1 / 3, (255 + 0 + 1 + 2 + 1 + 100 + 200) / 7)
    c = checks.curtain_reasons(pix, F.col("r"), F.col("gg"), 50.0, 100.0).select("curtain_reasons").collect()
    assert [x[0] for x in c] == [[], ["short side"], ["skirt"], []]
