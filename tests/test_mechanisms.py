"""Alignment, searches, filters, recovery, logs and timed streams against plain numpy or known scenes."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import camera_bias, depth_field, guided, recovery, search, two_planes
from voxelloom.sources import logs
from voxelloom.streaming import alignment, timers, windows

# ---- two planes


def plain_proposals(pix, cams, reference, min_points, upper_min, min_plane, tol=0.01, assign=0.08):
    """Stage one for one frame of (camera, z, rx, ry) rows with the deck given by least squares on its own points."""
    def world(rows, cam):
        r, t = cams[cam]
        return (np.column_stack([rows[:, 1] * rows[:, 0], rows[:, 2] * rows[:, 0], rows[:, 0]]) - t) @ r

    ref = world(np.array([p[1:4] for p in pix if p[0] == reference]), reference)
    best = None
    for i, j, k in itertools.islice(itertools.combinations(range(0, len(ref), 7), 3), 4000):
        n = np.cross(ref[j] - ref[i], ref[k] - ref[i])
        if np.linalg.norm(n) > 1e-9:
            n = n / np.linalg.norm(n)
            inside = np.abs((ref - ref[i]) @ n) <= tol
            if best is None or inside.sum() > best[0]:
                best = (inside.sum(), n, n @ ref[i])
    _, n, off = best
    for _ in range(2):
        near = ref[np.abs(ref @ n - off) <= tol]
        c = near.mean(0)
        m = np.linalg.svd(near - c)[2][-1]
        n = m if m @ n >= 0 else -m
        off = n @ c
    n, off = (n, off) if off > 0 else (-n, -off)
    h = ref @ n - off
    h = h[(h >= 0.04) & (h <= 0.6)]
    planes = [off]
    if len(h) >= upper_min:
        bins = max(8, int((h.max() - h.min()) / 0.005))
        counts, edges = np.histogram(h, bins)
        peak = (edges[:-1] + edges[1:])[int(np.argmax(np.convolve(counts, np.ones(3), "same")))] / 2
        if (np.abs(h - peak) <= 2 * tol).sum() >= upper_min // 2 and peak >= 0.08:
            planes.append(off + peak)
    out = {}
    for cam, (r, t) in cams.items():
        if cam == reference:
            continue
        rows = np.array([p[1:4] for p in pix if p[0] == cam])
        nc = r @ n
        samples = []
        for o in planes:
            zt = (o + nc @ t) / (rows[:, 1] * nc[0] + rows[:, 2] * nc[1] + nc[2])
            ok = (zt > 0) & (np.abs(rows[:, 0] - zt) <= assign)
            samples.append(np.column_stack([rows[ok, 0], zt[ok]]))
        both = np.concatenate(samples)
        if len(planes) == 2 and sum(len(s) >= min_plane for s in samples) >= 2 and len(both) >= min_points:
            w, a, b = np.ones(len(both)), 1.0, 0.0
            for _ in range(4):
                x = np.column_stack([both[:, 0], np.ones(len(both))])
                a, b = np.linalg.lstsq(x * w[:, None], both[:, 1] * w, rcond=None)[0]
                res = both[:, 1] - a * both[:, 0] - b
                s = 1.4826 * np.median(np.abs(res - np.median(res)))
                u = np.abs(res) / s
                w = np.where(u <= 1.345, 1.0, 1.345 / np.maximum(u, 1e-9))
            if 0.9 <= a <= 1.1:
                out[cam] = ("affine", a, b)
                continue
            out[cam] = ("offset_only_scale_rejected", 1.0, float(np.median(both[:, 1] - both[:, 0])))
        elif len(both):
            out[cam] = ("offset_only", 1.0, float(np.median(both[:, 1] - both[:, 0])))
        else:
            out[cam] = ("none", None, None)
    return out


def rig(seed, frames=3):
    """Pixels of frames of three tilted cameras over a deck and two tops; the second frame has no top, the third no deck."""
    rng = np.random.default_rng(seed)
    tilt = lambda d: np.array([[1, 0, 0], [0, math.cos(d), -math.sin(d)], [0, math.sin(d), math.cos(d)]])
    cams = {"ref": (np.eye(3), np.zeros(3)), "left": (tilt(0.1), np.array([0.2, 0.1, 0.05])), "right": (tilt(-0.12), np.array([-0.3, 0.0, 0.1])), "far": (np.eye(3), np.array([0.0, 0.0, 5.0]))}
    n, deck = np.array([0.02, -0.03, math.sqrt(1 - 0.0013)]), 2.0
    pix = []
    for f in range(frames):
        for cam, (r, t) in cams.items():
            rx, ry = rng.uniform(-0.4, 0.4, 900), rng.uniform(-0.4, 0.4, 900)
            nc = r @ n
            top = (rng.random(900) < 0.35) & (f != 1)
            z = (np.where(top, deck + 0.25, deck) + nc @ t) / (rx * nc[0] + ry * nc[1] + nc[2])
            a, b = {"ref": (1, 0), "left": (1.02, -0.03), "right": (0.97, 0.05), "far": (1.0, 0.9)}[cam]
            z = (z - b) / a + rng.normal(0, 0.0015, 900)
            z[rng.random(900) < 0.05] += 0.05
            if f == 2 and cam == "ref":
                z[:] = np.nan
            pix += [(f, cam, float(v), float(x), float(y)) for v, x, y in zip(z, rx, ry)]
    return cams, pix


def test_two_plane_proposals(spark):
    cams, pix = rig(1)
    df = spark.createDataFrame([(*p, k) for k, p in enumerate(pix)], "frame int, camera string, z double, rx double, ry double, pid long")
    cam = spark.createDataFrame([(c, [float(x) for x in r.ravel()], [float(x) for x in t]) for c, (r, t) in cams.items()], "camera string, R array<double>, t array<double>")
    opts = {"min_points": 300, "upper_min_points": 100, "min_plane_points": 60, "plane_tol": 0.01}
    got = {(r["frame"], r["camera"]): r for r in two_planes.two_plane_proposals(df, cam, ["frame"], "ref", **opts).collect()}
    assert len(got) == 12
    for f in (0, 1):
        want = plain_proposals([p[1:] for p in pix if p[0] == f], cams, "ref", 300, 100, 60)
        assert got[f, "ref"]["model"] == "reference" and (got[f, "ref"]["a"], got[f, "ref"]["b"]) == (1.0, 0.0)
        assert (got[f, "ref"]["upper_offset"] is None) == (f == 1) and abs(got[f, "ref"]["deck_offset"] - 2.0) < 0.002
        for c, (model, a, b) in want.items():
            assert got[f, c]["model"] == model
            assert a is None and got[f, c]["a"] is None or abs(got[f, c]["a"] - a) < 2e-4 and abs(got[f, c]["b"] - b) < 5e-4
    assert abs(got[0, "left"]["a"] - 1.02) < 0.01 and abs(got[0, "right"]["a"] - 0.97) < 0.01 and got[0, "far"]["model"] == "none"
    assert all(not got[2, c]["ok"] and got[2, c]["reason"] == "too few reference points" and got[2, c]["a"] is None for c in cams)


def test_alignment_is_tracked_through_bad_frames(spark, scratch):
    rows = [("r", 1, "x", True, 1.05, 0.4), ("r", 2, "x", True, 1.0, 0.0), ("r", 3, "x", False, None, None), ("r", 4, "x", True, None, None), ("r", 5, "x", True, 1.04, 0.2), ("r", 5, "y", True, 1.2, 0.1), ("s", 1, "x", False, None, None), ("s", 2, "x", True, 0.9, -0.3)]
    df = spark.createDataFrame(rows, "rig string, seq long, camera string, ok boolean, a double, b double").withColumns({"ts": F.timestamp_seconds("seq"), "model": F.lit("affine")})
    for part in (df.filter("seq <= 2"), df.filter("seq > 2")):  # two batches
        part.select("rig", "ts", "seq", "camera", "ok", "model", "a", "b").coalesce(1).write.mode("append").parquet(f"{scratch}/p")
        time.sleep(1.1)
    got = windows.replay(alignment.track_alignment(spark.readStream.schema(alignment.read_proposals(spark, f"{scratch}/p").schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/p")))
    r = {(x["rig"], x["seq"], x["camera"]): (round(x["a"], 9), round(x["b"], 9), x["used"], x["clamped"]) for x in got.collect()}
    assert r["r", 1, "x"] == (1.05, 0.4, True, False)
    assert r["r", 2, "x"] == (round(1.05 - 0.3 * 0.01, 9), round(0.4 - 0.3 * 0.15, 9), True, True)
    assert r["r", 3, "x"][:3] == (*r["r", 2, "x"][:2], False) and r["r", 4, "x"] == r["r", 3, "x"]
    assert r["r", 5, "y"] == (round(1 + 0.3 * 0.01, 9), round(0.3 * 0.1, 9), True, True)
    assert r["s", 1, "x"] == (1.0, 0.0, False, False) and r["s", 2, "x"] == (0.9, -0.3, True, False)


# ---- timers and novelty


def test_an_idle_rig_fires_without_a_further_frame(spark, scratch):
    frames = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [1.0]), ("a", 3, [1.0]), ("b", 1, [5.0])], "rig string, seq long, grey array<double>").withColumn("ts", F.timestamp_seconds("seq"))
    frames.coalesce(1).write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(frames.schema).parquet(f"{scratch}/in")
    q = timers.settle_trigger_timed(stream, 0.5, 2, 3.0, 4.0).writeStream.foreachBatch(lambda b, i: windows.append_log(b, i, f"{scratch}/out")).option("checkpointLocation", f"{scratch}/c").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end:
            time.sleep(2)
            try:
                rows = spark.read.schema("rig string, seq long, ts timestamp, diff double, fired boolean, forced boolean").parquet(f"{scratch}/out").collect()
            except Exception:  # the first batch has not been written yet
                continue
            if sum(r["forced"] for r in rows) >= 2:
                break
        time.sleep(6)
    finally:
        q.stop()
    rows = spark.read.schema("rig string, seq long, ts timestamp, diff double, fired boolean, forced boolean").parquet(f"{scratch}/out").collect()
    assert sorted((r["rig"], r["seq"]) for r in rows if r["seq"] is not None) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert [(r["rig"], r["seq"]) for r in rows if r["fired"] and not r["forced"]] == [("a", 3)]
    assert sorted((r["rig"], r["seq"], r["fired"]) for r in rows if r["forced"]) == [("a", None, True), ("b", None, True)]  # once each


def test_novel_views_equal_brute_force(spark, scratch):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for r in "ab":
        seen = []
        for k in range(150):
            angle, t = rng.uniform(0, 2 * math.pi), rng.uniform(-1.5, 1.5, 3)
            m = [math.cos(angle), -math.sin(angle), 0, math.sin(angle), math.cos(angle), 0, 0, 0, 1]
            if k % 40 == 7:
                rows.append((r, k, None, None))
                want[r, k] = True
                continue
            far = all(math.degrees(math.acos(np.clip((np.dot(m, n) - 1) / 2, -1, 1))) >= 40 or math.dist(t, u) >= 0.8 for n, u in seen)
            if far:
                seen.append((m, t))
            rows.append((r, k, [float(x) for x in m], [float(x) for x in t]))
            want[r, k] = far
    df = spark.createDataFrame(rows, "rig string, seq long, R array<double>, t array<double>").withColumn("ts", F.timestamp_seconds("seq"))
    for k in range(3):
        df.filter((F.col("seq") >= 50 * k) & (F.col("seq") < 50 * k + 50)).coalesce(1).write.mode("append").parquet(f"{scratch}/v")
        time.sleep(1.1)
    got = windows.replay(timers.novel_views(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/v"), 40.0, 0.8))
    assert {(x["rig"], x["seq"]): x["accepted"] for x in got.collect()} == want and 20 < sum(want.values()) < 280


# ---- searches


def test_phase_correlation_finds_shifts_of_several_cameras(spark, monkeypatch):
    monkeypatch.setattr(search, "SPAN", 16)
    rng = np.random.default_rng(4)
    base = (rng.random((90, 50)) < 0.2).astype(float)
    rows, want = [], {}
    for k, (du, dv) in enumerate([(0, 0), (7, -3), (-20, 11), (44, 25), (-45, -24)]):
        moved = np.roll(base, (-du, -dv), (0, 1)) * (rng.random(base.shape) < 0.9)
        for side, image in (("a", base), ("b", moved)):
            rows += [(k, side, int(i), int(j), 1.0) for i, j in zip(*np.nonzero(image))]
        r = np.fft.irfft2((c := np.fft.rfft2(base) * np.conj(np.fft.rfft2(moved))) / np.maximum(np.abs(c), 1e-12), s=base.shape)
        want[k] = (du % 90 if du % 90 <= 45 else du % 90 - 90, dv % 50 if dv % 50 <= 25 else dv % 50 - 50, float(r.max()))
    df = spark.createDataFrame([(*r, 90, 50) for r in [*rows, (9, "a", 3, 4, 1.0)]], "camera int, side string, iu int, iv int, value double, nu int, nv int")
    got = {r["camera"]: (r["du"], r["dv"], r["score"]) for r in search.phase_correlation(df.repartition(3), ["camera"]).collect()}
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-6 for k in want) and got[9] == (0, 0, 0.0)


def test_inplane_offset_finds_yaw_and_shift(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.uniform((x, y), (x + w, y + d), (900, 2)) for x, y, w, d in ((0, 0, 0.3, 0.2), (0.6, 0.1, 0.15, 0.4), (0.2, 0.55, 0.25, 0.1))])
    c = pts.mean(0)
    th = math.radians(2.0)
    rot = np.array([[math.cos(th), -math.sin(th)], [math.sin(th), math.cos(th)]])
    rows = [("ref", *map(float, p)) for p in pts] + [("side", *map(float, (p - c) @ rot + c - (0.06, -0.04))) for p in pts] + [("thin", 0.0, 0.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "run int, camera string, u double, v double")
    got = search.inplane_offset(df, ["run"], "ref", 0.02, [-4.0, -2.0, 0.0, 2.0, 4.0], margin=0.2).collect()
    assert [(r["camera"], r["yaw_deg"], r["at_edge"]) for r in got] == [("side", 2.0, False)]
    shift = np.array([0.06, -0.04])  # the camera is turned about the reference's centroid before it is moved
    assert abs(got[0]["du"] - (rot @ shift)[0]) <= 0.021 and abs(got[0]["dv"] - (rot @ shift)[1]) <= 0.021


@pytest.mark.parametrize("flip", [1, -1])
def test_footprint_slide_equals_brute_force(spark, flip):
    rng = np.random.default_rng(6)
    ref = np.column_stack([rng.uniform(-2, 2, 3000), rng.uniform(-0.5, 0.5, 3000), rng.uniform(0, 0.4, 3000)])
    ref = ref[np.sin(3 * ref[:, 0]) + np.cos(5 * ref[:, 1] + ref[:, 0]) > 0.2]
    mov = ref[np.abs(ref[:, 0]) < 1.2][::2] * (flip, flip, 1) - (0.3 * flip, 0, 0)
    to = lambda a: spark.createDataFrame([(0, *map(float, p)) for p in a], "g int, u double, v double, h double")
    other = spark.createDataFrame([(1, 0.0, 0.0, 0.1)], "g int, u double, v double, h double")
    got = {r["g"]: r for r in search.footprint_slide(to(ref), to(mov).union(other), ["g"], 2.5, 0.6, 0.05, 0.6, (0.05, 0.35)).collect()}

    def mask(p, s):
        p = p[(p[:, 2] > 0.05) & (p[:, 2] < 0.35) & (np.abs(p[:, 1]) <= 0.6)]
        m = np.zeros((int(5 / 0.05) + 1, int(1.2 / 0.05) + 1), bool)
        m[np.floor((s * p[:, 0] + 2.5) / 0.05).astype(int), np.floor((s * p[:, 1] + 0.6) / 0.05).astype(int)] = True
        return m

    a, best = mask(ref, 1), (-1.0, 0, "")
    for yaw, s in (("0", 1), ("180", -1)):
        b = mask(mov, s)
        c0, c1 = np.flatnonzero(b.any(1))[[0, -1]] + (0, 1)
        for k in range(-12, 13):
            if c0 + k >= 0 and c1 + k <= len(a):
                score = (a[c0 + k : c1 + k] & b[c0:c1]).sum() / max((a[c0 + k : c1 + k] | b[c0:c1]).sum(), 1)
                if score > best[0]:
                    best = (score, k, yaw)
    assert (round(got[0]["score"], 9), round(got[0]["slide"] / 0.05), got[0]["yaw"]) == (round(best[0], 9), best[1], best[2])
    assert best[2] == ("0" if flip == 1 else "180") and (got[1]["slide"], got[1]["score"]) == (0.0, 0.0)


@pytest.mark.parametrize("tile", [1, 4, 100])
def test_slide_and_scale_equals_every_candidate(spark, tile):
    rng = np.random.default_rng(7)
    ref = np.column_stack([rng.uniform(-1, 1, 300), rng.uniform(-0.3, 0.3, 300), 2 - rng.choice([0.0, 0.2, 0.3], 300, p=[0.6, 0.2, 0.2])])
    mov = (ref[::2] - (0.1, 0, 0)) / 1.05 + rng.normal(0, 0.004, (150, 3))
    to = lambda a: spark.createDataFrame([(0, *map(float, p)) for p in a], "g int, x double, y double, z double")
    frames = spark.createDataFrame([(0, [0.0, 0.0, 2.0], [1.0, 0.0, 0.0], [0.0, 0.0, -1.0])], "g int, centre array<double>, ex array<double>, n array<double>")
    scales, slides = (0.95, 1.12, 0.05), (-0.2, 0.2, 0.1)
    got = search.slide_and_scale(to(mov), to(ref), frames, ["g"], scales, slides, 0.03, 0.1, 0.2, min_points=10, fine=4, tile=tile).first()

    def score(s, d):
        q = mov * s + (d, 0, 0)
        h = 2 - q[:, 2]
        if abs(np.median(h)) > 0.2 or (h > 0.1).sum() < 10:
            return -1
        q = q[h > 0.1]
        return (np.sqrt(((q[:, None] - ref[None]) ** 2).sum(2)).min(1) <= 0.03).mean()

    best = max(((score(s, d), -i, -j, s, d) for i, s in enumerate(np.arange(*scales)) for j, d in enumerate(np.arange(slides[0], slides[1] + 1e-9, slides[2]))))
    s0, d0 = best[3:]
    fine = max(((score(s, d), -i, -j, s, d) for i in range(8) for j in range(8) for s, d in [(s0 - 0.05 + i * 0.05 / 4, d0 - 0.1 + j * 0.1 / 4)]))
    want = fine if fine[0] > best[0] else best
    assert (round(got["support"], 9), round(got["scale"], 9), round(got["slide"], 9)) == (round(float(want[0]), 9), round(float(want[3]), 9), round(float(want[4]), 9))
    assert abs(want[3] - 1.05) < 0.03 and abs(want[4] - 0.1) < 0.06


def test_depth_scale_is_found_and_refined(spark):
    rng = np.random.default_rng(8)
    u, v = rng.uniform(-0.5, 0.5, 800), rng.uniform(-0.5, 0.5, 800)
    z = 2 + 0.3 * np.sin(3 * u) * np.cos(2 * v)
    p = np.column_stack([u, v, z])
    n = np.column_stack([0.9 * np.cos(3 * u) * np.cos(2 * v), -0.6 * np.sin(3 * u) * np.sin(2 * v), -np.ones(800)])
    n /= np.linalg.norm(n, axis=1)[:, None]
    true, t = 1.1, np.array([0.6, 0.1, 0.0])
    rows = [(0, "c", k, *map(float, a / true), *map(float, b)) for k, (a, b) in enumerate(zip(p, n))] + [(0, "s", 1000 + k, *map(float, (a + t) / true), 0.0, 0.0, 0.0) for k, a in enumerate(p[::2])]
    rows += [(1, "c", k, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0) for k in range(3)]  # too few
    df = spark.createDataFrame(rows, "g int, camera string, pid long, x double, y double, z double, nx double, ny double, nz double")
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    cams = spark.createDataFrame([("c", eye, [0.0, 0.0, 0.0]), ("s", eye, [float(x) for x in t])], "camera string, R array<double>, t array<double>")
    best, probes = search.depth_scale(df, cams, ["g"], "c", 0.9, 1.3, 5, 0.2, refine=6)
    got = {r["g"]: r for r in best.collect()}
    assert abs(got[0]["scale"] - true) < 0.02 and not got[0]["degenerate"] and not got[0]["at_edge"] and got[1]["scale"] is None
    for r in probes.filter("g = 0").collect():
        k = r["k"]
        side, ref = (p[::2] + t) / true * k - t, p / true * k
        d = np.sqrt(((side[:, None] - ref[None]) ** 2).sum(2))
        at, ok = d.argmin(1), d.min(1) <= 0.2 * k
        gap = np.abs(((side - ref[at]) * n[at]).sum(1))[ok]
        assert abs(r["score"] - np.median(gap) / np.median(np.linalg.norm(ref, axis=1))) < 1e-9


# ---- depth field, guided filter, recovery, logs


def test_bootstrapped_field_where_planes_are_nearer_than_the_first_window(spark):
    rng = np.random.default_rng(9)
    truth = np.array([1.03, 0.012, -0.02, 0.015])
    offs = {"deck": 2.0, "low": 1.913, "high": 1.75}
    rows = []
    for g in ("cam", "alone", "lost"):
        for name, off in offs.items():
            m = {"deck": 4000, "low": 900, "high": 900}[name]
            rx, ry = rng.uniform(-0.4, 0.4, m), rng.uniform(-0.3, 0.3, m)
            z = (off - truth[3]) / (truth[0] + truth[1] * rx + truth[2] * ry) + rng.normal(0, 0.001, m)
            rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(z, rx, ry) if g != "alone" or name == "deck"]
    pix = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "z", "rx", "ry"]))
    planes = spark.createDataFrame([(g, name, 0.0, 0.0, 1.0, off) for g in ("cam", "alone", "lost") for name, off in offs.items() if not (g == "lost" and name == "deck") and not (g == "alone" and name != "deck")], "g string, plane string, nx double, ny double, nz double, off double")
    fit, log = depth_field.field_fit_bootstrapped(pix, planes, ["g"], "deck", 0.15, 0.03, 0.02, min_plane_points=200, min_samples=500)
    got = {r["g"]: r for r in fit.collect()}
    assert got["cam"]["stage"] == "stage2" and got["cam"]["worst_rms"] <= got["cam"]["held_rms"] + 0.0005
    assert np.abs(np.array([got["cam"][c] for c in "sabc"]) - truth).max() < 0.006
    assert got["alone"]["stage"] == "stage1_only" and got["alone"]["c"] == 0.0 and got["lost"]["stage"] == "single"
    cold, _ = depth_field.field_fit(pix.filter("g = 'cam'"), planes.filter("g = 'cam'"), ["g"], depth_field.windows(0.15, 0.02, 4), min_plane_points=200, min_samples=500)
    apart = lambda r: max(abs(off * 1.0 - ((off - truth[3]) / truth[0] * r["s"] + r["c"])) for off in offs.values())
    assert apart(got["cam"]) < 0.002 and apart(got["cam"]) <= apart(cold.first())
    assert {(r["stage"], r["pass"]) for r in log.filter("g = 'cam'").collect()} >= {(1, 0), (1, 3), (2, 0), (2, 3)}


def test_field_fit_equals_numpy(spark):
    rng = np.random.default_rng(10)
    rx, ry = rng.uniform(-0.4, 0.4, 3000), rng.uniform(-0.3, 0.3, 3000)
    off = np.where(rng.random(3000) < 0.5, 2.0, 1.6)
    z = off / (1.02 + 0.01 * rx) - 0.01 + rng.normal(0, 0.002, 3000)
    pix = spark.createDataFrame(pd.DataFrame({"g": 0, "z": z, "rx": rx, "ry": ry}))
    planes = spark.createDataFrame([(0, "a", 0.0, 0.0, 1.0, 2.0), (0, "b", 0.0, 0.0, 1.0, 1.6)], "g long, plane string, nx double, ny double, nz double, off double")
    near = [np.abs(z - o) <= 0.15 for o in (2.0, 1.6)]
    q = np.concatenate([z[m] for m in near])
    x, y, t = np.concatenate([rx[m] for m in near]), np.concatenate([ry[m] for m in near]), np.concatenate([np.full(m.sum(), o) for m, o in zip(near, (2.0, 1.6))])
    a = np.column_stack([q, x * q, y * q, np.ones(len(q))])
    for options, columns, target, priors in (({}, [0, 1, 2, 3], t, []), ({"dof": 3}, [0, 1, 2], t, []), ({"fix_scale": True}, [1, 2, 3], t - q, []), ({"ridge_s": 0.01, "ridge_c": 0.02}, [0, 1, 2, 3], t, [(0, 1.0, 0.01), (3, 0.0, 0.02)]), ({"fix_scale": True, "ridge_c": 0.02}, [1, 2, 3], t - q, [(2, 0.0, 0.02)])):
        m, y_ = a[:, columns], target
        sol = np.linalg.lstsq(m, y_, rcond=None)[0]
        if priors:
            w = math.sqrt(len(m)) * (np.std(y_ - m @ sol) + 1e-9)
            extra = [(np.eye(len(columns))[k] * w / sd, value * w / sd) for k, value, sd in priors]
            sol = np.linalg.lstsq(np.vstack([m] + [e[0][None] for e in extra]), np.concatenate([y_, [e[1] for e in extra]]), rcond=None)[0]
        want = np.zeros(4)
        want[0] = 1.0 if 0 not in columns else 0.0
        want[columns] = sol
        fit, _ = depth_field.field_fit(pix, planes, ["g"], [0.15], min_plane_points=100, min_samples=100, **options)
        r = fit.first()
        assert np.abs(np.array([r[c] for c in "sabc"]) - want).max() < 1e-7, options
    bad, log = depth_field.field_fit(pix, planes, ["g"], [0.15], min_plane_points=100, min_samples=100, max_scale_dev=0.0001)
    assert [bad.first()[c] for c in "sabc"] == [1, 0, 0, 0] and log.first()["rejected"] == "scale"
    none, _ = depth_field.field_fit(pix, planes, ["g"], [0.15], min_samples=10_000)
    assert not none.first()["solved"] and none.first()["reason"] == "too few samples"


@pytest.mark.parametrize("radius", [1, 3, 12])
def test_guided_filter_equals_numpy(spark, radius):
    rng = np.random.default_rng(11)
    guide, value = rng.random((9, 14)), rng.random((9, 14))

    def box(x):
        d = 2 * radius + 1
        y = np.pad(x, radius, mode="edge")
        return np.array([[y[i : i + d, j : j + d].mean() for j in range(x.shape[1])] for i in range(x.shape[0])])

    mi, mp = box(guide), box(value)
    a = (box(guide * value) - mi * mp) / (box(guide * guide) - mi * mi + 0.01)
    want = box(a) * guide + box(mp - a * mi)
    cells = [(0, i - 4, j + 100, float(guide[i, j]), float(value[i, j])) for i in range(9) for j in range(14)]
    df = spark.createDataFrame([*cells, *[(1, *c[1:]) for c in cells[:-5]]], "g int, iu long, iv long, i double, p double")
    got = guided.guided_filter(df.repartition(3), ["g"], "i", "p", radius, 0.01).collect()
    assert all(abs(r["smooth"] - want[r["iu"] + 4, r["iv"] - 100]) < 1e-9 for r in got if r["g"] == 0) and sum(r["g"] == 0 for r in got) == 126
    assert all(r["smooth"] is None for r in got if r["g"] == 1)


def slab(rng, u, v, length, width, h, n):
    return np.column_stack([rng.uniform(u, u + length, n), rng.uniform(v, v + width, n), h + rng.normal(0, 0.002, n)])


def test_stacked_unclaimed_surfaces_come_out_as_two(spark):
    rng = np.random.default_rng(12)
    pts = np.concatenate([slab(rng, 0, 0, 0.3, 0.25, 0.40, 3000), slab(rng, 0.3, 0, 0.5, 0.3, 0.18, 4000), slab(rng, 0, 0, 0.3, 0.25, 0.18, 800), slab(rng, 3, 3, 0.4, 0.3, 0.25, 3000), slab(rng, 6, 6, 0.05, 0.02, 0.3, 40)])
    df = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(pts)], "capture int, pid long, u double, v double, h double")
    got = recovery.peel_unclaimed(df, None, ["capture"], 0.02, close=1).collect()
    good = sorted((round(r["height"], 2), r["level"]) for r in got if r["accepted"])
    assert good == [(0.18, 1), (0.25, 0), (0.40, 0)]
    low = next(r for r in got if r["accepted"] and r["level"] == 1)
    assert abs(low["length"] - 0.5) < 0.05 and abs(low["width"] - 0.3) < 0.05
    assert [r["level"] for r in recovery.peel_unclaimed(df, None, ["capture"], 0.02, close=1, max_levels=1).collect()] == [0, 0]
    claimed = df.filter("u > 2").select("capture", "pid")
    assert sorted(round(r["height"], 2) for r in recovery.peel_unclaimed(df, claimed, ["capture"], 0.02, close=1).collect() if r["accepted"]) == [0.18, 0.40]
    assert recovery.peel_unclaimed(df.filter("false"), None, ["capture"], 0.02).count() == 0


def test_logs_whose_header_changes_inside_a_file(spark, scratch):
    heads = ["capture,id,x_m", "capture,id,y_m,note", "capture,note,id"]
    want, lines = [], ["1,2,lost"]
    for h, head in enumerate(heads):
        lines.append(head)
        for k in range(40):
            row = {"capture": str(h), "id": str(k), "x_m": f"{k}.5", "y_m": "", "note": f'say ""{k}"", twice'}
            lines.append(",".join(f'"{row[c]}"' if c == "note" else row[c] for c in head.split(",")))
            want.append({c: (row[c].replace('""', '"') or None) for c in head.split(",")})
    with open(f"{scratch}/boxes_log_1.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    size = sum(len(x) + 1 for x in lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 2 + 1))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = logs.read_drifting_logs(spark, scratch).orderBy("split", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r["split"] for r in got}) == 2 and got[0]["row"] is None and [r["row"] for r in got[1:]] == want


# ---- bias, poses, folds


def tls(p):
    c = p.mean(0)
    n = np.linalg.svd(p - c)[2][-1]
    return n, -n @ c


def test_camera_bias_equals_numpy(spark):
    rng = np.random.default_rng(13)
    cams = {"a": (0.0, 0.0, 0.0), "b": (0.5, 0.1, 0.05), "c": (-0.4, 0.2, 0.0), "d": (0.1, 0.1, 0.1)}
    rows = []
    for c in "abc":
        for s, z in (("near", 1.6), ("far", 2.1)):
            u, v = rng.uniform(-0.5, 0.5, 200), rng.uniform(-0.5, 0.5, 200)
            k, o = {"a": (1.0, 0.0), "b": (1.03, 0.002), "c": (1.0, 0.02)}[c]
            h = (z + 0.01 * u - cams[c][2]) * k + o + cams[c][2] + (0.02 * v if c == "a" else 0) + rng.normal(0, 0.001, 200)
            rows += [(1, c, s, *map(float, p)) for p in np.column_stack([u, v, h])]
    rows += [(1, "d", "near", 0.0, 0.0, float(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "run int, camera string, surface string, x double, y double, z double")
    at = spark.createDataFrame([(c, *p) for c, p in cams.items()], "camera string, x double, y double, z double")
    got = {r["camera"]: r for r in camera_bias.camera_bias(df.repartition(3), at, ["run"]).collect()}
    for c in "abc":
        m, r, tilt = {}, {}, {}
        for s in ("near", "far"):
            own = np.array([x[3:] for x in rows if x[1] == c and x[2] == s])
            rest = np.array([x[3:] for x in rows if x[1] != c and x[2] == s])
            (n, d), (rn, rd) = tls(own), tls(rest)
            m[s], r[s] = abs(n @ cams[c] + d), abs(rn @ cams[c] + rd)
            tilt[s] = math.degrees(math.acos(min(1, abs(n @ rn))))
        scale = (m["far"] - m["near"]) / (r["far"] - r["near"])
        assert abs(got[c]["scale"] - scale) < 1e-9 and abs(got[c]["offset"] - (m["far"] - scale * r["far"])) < 1e-9
        assert abs(got[c]["near_tilt_deg"] - tilt["near"]) < 1e-5 and abs(got[c]["far_tilt_deg"] - tilt["far"]) < 1e-5
    assert got["d"]["scale"] is None and got["d"]["verdict"] is None and got["a"]["near_tilt_deg"] > 0.5


def test_folds_are_reweighted(spark):
    rng = np.random.default_rng(14)
    rows = [(1, h, h / 1000, 0.9 * h / 1000 + 0.002 + float(rng.normal(0, 0.0005)) + (0.05 if k % 9 == 0 else 0)) for h in (50, 120, 200, 310) for k in range(40)] + [(2, 50, 0.05, 0.05)] * 3
    df = spark.createDataFrame(rows, "g int, h int, x double, y double")
    got = {(r["g"], r["h"]): r for r in camera_bias.leave_one_out_reweighted(df.repartition(3), ["g"], "h", "x", "y").collect()}
    assert set(got) == {(1, h) for h in (50, 120, 200, 310)}
    plain = {r["h"]: r for r in __import__("voxelloom.operators.robust", fromlist=["x"]).leave_one_height_out(df, ["g"], "h", "x", "y").collect()}
    for h in (50, 120, 200, 310):
        x, y = (np.array([r[i] for r in rows if r[0] == 1 and r[1] != h]) for i in (2, 3))
        w = np.ones(len(x))
        for _ in range(6):
            a = np.column_stack([x, np.ones(len(x))])
            p, q = np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0]
            res = np.abs(p * x + q - y)
            s = max(1.4826 * np.median(res), 1e-9)
            w = np.where(res <= 2 * s, 1.0, 2 * s / np.maximum(res, 1e-12))
        r = got[1, h]
        own = np.array([v[3] - p * v[2] - q for v in rows if v[0] == 1 and v[1] == h])
        assert abs(r["p"] - p) < 1e-9 and abs(r["q"] - q) < 1e-9 and r["n"] == 40
        assert abs(r["median_after"] - np.median(own)) < 1e-9 and abs(r["rms_after"] - np.sqrt((own**2).mean())) < 1e-9
        assert abs(r["median_after"]) < abs(plain[h]["held_out_median"])


def test_relative_rotation_error(spark):
    rng = np.random.default_rng(15)
    rows, want = [], {}
    for run in range(3):
        est, cal = [], []
        for k in range(run + 1):
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            q *= np.sign(np.linalg.det(q))
            th = 0.02 * k * (run + 1)
            e = np.array([[math.cos(th), -math.sin(th), 0], [math.sin(th), math.cos(th), 0], [0, 0, 1]]) @ q
            est.append(e), cal.append(q)
            rows.append((run, f"c{k}", [float(x) for x in e.ravel()], [float(x) for x in q.ravel()]))
        want[run] = max(math.degrees(math.acos(np.clip((np.trace((e @ est[0].T) @ (c @ cal[0].T).T) - 1) / 2, -1, 1))) for e, c in zip(est, cal))
    df = spark.createDataFrame(rows, "run int, camera string, R_est array<double>, R_cal array<double>")
    got = {r["run"]: (r["cameras"], r["rotation_error_deg"]) for r in camera_bias.relative_rotation_error(df, ["run"]).collect()}
    assert all(got[k][0] == k + 1 and abs(got[k][1] - want[k]) < 1e-5 for k in want)


def test_scale_search_estimates_normals_and_marks_the_best(spark):
    """A curved sheet seen by two cameras, depth too short by a tenth: normals from 30 neighbours, the reference's own range, the best scale."""
    from voxelloom.operators import align

    rng = np.random.default_rng(5)
    u, v = rng.uniform(-0.5, 0.5, 600), rng.uniform(-0.5, 0.5, 600)
    p = np.column_stack([u, v, 2 + 0.3 * np.sin(3 * u) * np.cos(2 * v)])
    true, c = 1.1, np.array([0.6, -0.2, 0.0])
    ref, side = p / true, c + (p[::2] - c) / true
    dst = spark.createDataFrame([(0, k, *map(float, a)) for k, a in enumerate(ref)], "g int, pid long, x double, y double, z double")
    src = spark.createDataFrame([(0, "s", k, *map(float, a), *map(float, c)) for k, a in enumerate(side)], "g int, camera string, pid long, x double, y double, z double, cx double, cy double, cz double")
    got = {r["k"]: r for r in align.depth_scale_search(src, dst, ["g"], [1.0, 1.1, 1.2], 0.2, normal_radius=0.12, min_points=50).collect()}
    normal = []
    for a in ref:
        d = np.linalg.norm(ref - a, axis=1)
        near = [i for i in np.argsort(d, kind="stable")[:30] if d[i] <= 0.12]
        normal.append(np.linalg.eigh(np.cov(ref[near].T))[1][:, 0] if len(near) > 2 else [0, 0, 1])
    scores = {}
    for k in (1.0, 1.1, 1.2):
        moved = (c + (side - c) * k) / k
        d = np.linalg.norm(moved[:, None] - ref[None], axis=2)
        at, ok = d.argmin(1), d.min(1) <= 0.2
        gap = np.abs(((moved - ref[at]) * np.asarray(normal)[at]).sum(1))[ok]
        scores[k] = np.median(gap) / np.median(np.linalg.norm(ref, axis=1))
        assert got[k]["n"] == ok.sum() and abs(got[k]["relative"] - scores[k]) < 1e-9 and abs(got[k]["range_median"] - k * np.median(np.linalg.norm(ref, axis=1))) < 1e-9
    assert [k for k, r in got.items() if r["best"]] == [min(scores, key=scores.get)] == [1.1]
