"""Boxes stacked on one place: the same results, worked out once for boxes alike."""

import math

import pytest
from pyspark.sql import functions as F

from voxelloom.operators import boxes


@pytest.fixture
def stacked(spark):
    """Three places, 20 boxes on each in two footprints and tops of four heights; one id twice."""
    rows = [("a", 60 * p + k, p * 0.4, 0.0, 0.5 if k % 2 else 0.3, 0.2, 0.0, 0.1 * (k // 5), float(k % 7)) for p in range(3) for k in range(20)]
    rows.append(("a", 7, 5.0, 0.0, 0.3, 0.2, 0.0, 0.1, 1.0))
    return rows, spark.createDataFrame(rows, "g string, id long, cu double, cv double, length double, width double, yaw double, top double, s double")


def _gap(a, b):
    def dist(x, y, r):
        qx, qy = abs(x - r[2]) - r[4] / 2, abs(y - r[3]) - r[5] / 2
        return math.hypot(max(qx, 0), max(qy, 0)) + min(max(qx, qy), 0)

    return min(dist(p[2] + i * p[4] / 2, p[3] + j * p[5] / 2, q) for p, q in ((a, b), (b, a)) for i in (-1, 1) for j in (-1, 1))


def _iou(a, b):
    side = lambda k, n: max(0.0, min(a[k] + a[n] / 2, b[k] + b[n] / 2) - max(a[k] - a[n] / 2, b[k] - b[n] / 2))
    inter = side(2, 4) * side(3, 5)
    return inter / (a[4] * a[5] + b[4] * b[5] - inter)


@pytest.fixture
def met(monkeypatch):
    """Rows given to ``near_pairs``."""
    seen, plain = [], boxes.near_pairs
    monkeypatch.setattr(boxes, "near_pairs", lambda b, *a, **k: (seen.append(b.count()), plain(b, *a, **k))[1])
    return seen


def test_gaps_of_stacked_boxes(stacked, met):
    rows, df = stacked
    got = {r["id"]: (r["nearest_id"], r["gap"]) for r in boxes.nearest_gap(df, ["g"], 0.05, 0.5).collect()}
    for i in {r[1] for r in rows}:
        gap, nearest = min((round(_gap(a, b), 9), b[1]) for a in rows if a[1] == i for b in rows if b[1] != i)
        assert got[i][0] == nearest and abs(got[i][1] - gap) < 1e-9, i
    assert met[0] <= 8  # six footprints, and two rows of the id that comes twice


def test_relations_of_stacked_boxes(stacked, met):
    rows, df = stacked
    df, rows = df.filter("id <> 7"), [r for r in rows if r[1] != 7]
    got = {r["id"]: r for r in boxes.box_relations(df, ["g"], 0.5).collect()}
    for a in rows:
        block = sorted(b[1] for b in rows if b[7] - a[7] > 0.02 and _gap(a, b) < 0.005)
        under = [(b[7], b[1]) for b in rows if b[7] - a[7] < -0.02 and abs(a[2] - b[2]) <= b[4] / 2]
        r = got[a[1]]
        assert r["blocked_by"] == block and r["blockers"] == len(block) and r["supported_by"] == (max(under)[1] if under else None)
    short = boxes.box_relations(df, ["g"], 0.5, lists=False)
    assert "blocked_by" not in short.columns and {r["id"]: r["blockers"] for r in short.collect()} == {i: r["blockers"] for i, r in got.items()}
    assert max(met) <= 24


def test_suppression_of_stacked_boxes(stacked, met):
    rows, df = stacked
    df, rows = df.filter("id <> 7"), [r for r in rows if r[1] != 7]
    got = {r["id"]: (r["kept"], r["lost_to"]) for r in boxes.suppress_overlaps(df, ["g"], 0.5, 0.05, 0.15, F.col("s")).collect()}
    kept = []
    for a in sorted(rows, key=lambda r: (-r[8], r[1])):
        over = [b for b in kept if abs(a[7] - b[7]) < 0.15 and _iou(a, b) > 0.05]
        assert got[a[1]] == (not over, over[0][1] if over else None), a[1]
        kept += [] if over else [a]
    assert max(met) <= 24


def test_two_passes_over_stacked_boxes(stacked, met):
    rows, df = stacked
    df, rows = df.filter("id <> 7"), [r for r in rows if r[1] != 7]
    planar, soft = [r for r in rows if r[1] % 3], [r for r in rows if r[1] % 3 == 0]
    got = sorted((r["origin"], r["id"]) for r in boxes.resolve_two_passes(df.filter("id % 3 <> 0"), df.filter("id % 3 = 0"), ["g"], 0.5, 0.05, 0.05, 1.1).collect())
    want, gone = [], set()
    for a in soft:
        over = [(-_iou(a, b), b[1], b) for b in planar if abs(a[7] - b[7]) < 0.05 and _iou(a, b) > 0.05]
        best = min(((round(i, 9), n, b) for i, n, b in over), default=None)
        if best is None or a[4] * a[5] / (best[2][4] * best[2][5]) >= 1.1:
            want.append(("recovery", a[1]))
            gone |= set() if best is None else {best[1]}
    assert got == sorted(want + [("planar", b[1]) for b in planar if b[1] not in gone])
    assert max(met) <= 24


def _hidden(a, cam, rows):
    """Samples of box ``a`` that another box hides, by stepping along each line of sight."""
    n = 0
    for i, j in ((0, 0), (-0.4, -0.4), (0.4, -0.4), (0.4, 0.4), (-0.4, 0.4)):
        x, k = (a[2] + a[4] * i, a[3] + a[5] * j, a[7]), cam
        at = [[k[c] + (x[c] - k[c]) * (0.02 + 0.96 * t / 4000) for c in range(3)] for t in range(4001)]
        n += any(abs(u - b[2]) < b[4] / 2 and abs(v - b[3]) < b[5] / 2 and 0.005 < h < b[7] - 0.005 for b in rows if b[1] != a[1] for u, v, h in at)
    return n / 5


def test_occlusion_by_stacked_boxes(spark, monkeypatch):
    rows = [("a", 20 * p + k, 0.7 * p, 0.31 * (p % 3), 0.45, 0.27, 0.0, 0.13 + 0.09 * (p % 4)) for p in range(9) for k in range(10)]
    df = spark.createDataFrame(rows, "g string, id long, cu double, cv double, length double, width double, yaw double, top double")
    views = {"far": (-2.3, 0.77, 1.1), "low": (7.03, -0.4, 0.21), "along": (1.4, 5.0, 0.9)}
    cams = spark.createDataFrame([("a", n, *k) for n, k in views.items()], "g string, camera string, ku double, kv double, kh double")
    seen, plain = [], boxes._on_cells
    monkeypatch.setattr(boxes, "_on_cells", lambda b, *a, **k: (seen.append(b.count()), plain(b, *a, **k))[1])
    got = {(r["id"], r["camera"]): r["hidden"] for r in boxes.occluded_views(df, cams, ["g"]).collect()}
    assert len(got) == len(rows) * len(views) and len(set(got.values())) > 2
    for p in range(9):
        # of the ten on one place two are enough: they hide the others alike
        few = [r for r in rows if r[1] % 20 < 2]
        for n, k in views.items():
            assert {got[20 * p + i, n] for i in range(10)} == {_hidden(rows[10 * p], k, few)}, (p, n)
    assert seen == [9]


def test_plane_screen_among_copies(spark, monkeypatch):
    np = pytest.importorskip("numpy")
    from voxelloom.operators import planes

    rng = np.random.default_rng(5)
    tilt = [(0.0, 0.0, 1.0), (0.02, 0.0, 0.9998), (0.3, 0.0, 0.954)]
    # ten planes on each of few places, some with a like number of points, one without any
    rows = [("a" if i % 3 else None, i, *tilt[i // 10 % 3], round(0.1 + 0.0004 * (i // 10 % 9), 4), int(rng.integers(5, 9)) if i % 11 else None) for i in range(240)]
    rows.append(("a", 500, *tilt[0], float("nan"), 3))
    df = spark.createDataFrame(rows, "g string, plane_id long, nx double, ny double, nz double, d double, n long")

    def weaker(p, q):
        turn = np.degrees(np.arccos(min(1.0, abs(sum(p[i] * q[i] for i in (2, 3, 4))))))
        return p[0] and p[0] == q[0] and p[6] and q[6] and p[1] != q[1] and turn <= 2.0 and abs(p[5] - q[5]) < 0.0005 and (q[6] > p[6] or q[6] == p[6] and q[1] < p[1])

    met, plain = [], planes.materialise
    monkeypatch.setattr(planes, "materialise", lambda d, tag="table": (met.append(d.count()), plain(d, tag))[1])
    got = sorted(r["plane_id"] for r in planes.plane_screen(df, ["g"], 0.05, None, 2.0, 0.0005).collect())
    assert got == [p[1] for p in rows if not any(weaker(p, q) for q in rows)] and 0 < len(got) < len(rows)
    assert met == [len({(p[0], *p[2:6]) for p in rows if p[6] is not None and p[5] == p[5]})] and met[0] <= 60


def test_query_peels_every_level(spark, monkeypatch):
    from voxelloom.operators import recovery
    from voxelloom.plans import catalog, load_catalog

    asked = {}
    whole = recovery.peel_unclaimed

    def spy(points, claimed, by, *args, **kw):
        asked.update(kw)
        return whole(points.limit(0), None, by, *args, **kw)

    monkeypatch.setattr(recovery, "peel_unclaimed", spy)
    load_catalog().QUERIES["peel_unclaimed"](catalog.Tables(spark, "/root/testdata/sf0.001"))
    assert asked.get("max_levels") is None and asked["min_points"] == 20


def test_boxes_that_differ_meet_as_blocks(spark, monkeypatch):
    """200 differing boxes on one place: pairs of blocks are rows, pairs of boxes (40,000) are not; turned boxes, too."""
    rows = [("a", k, 0.001 * (k % 9), 0.0, 0.3 + k / 1000, 0.2 + k % 11 / 100, 0.1 * (k % 4) if k > 100 else 0.0, 0.1 + k % 5 / 10) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, id long, cu double, cv double, length double, width double, yaw double, top double")
    other = df.select("g", *[F.col(c).alias("o_" + c) for c in df.columns[1:]])
    want = {r["id"]: r for r in df.join(other, "g").filter("id <> o_id").withColumn("_gap", boxes.rect_gap()).withColumn("_in", boxes.rect_distance(F.col("cu"), F.col("cv"), "o_") <= 0).groupBy("id").agg(
        F.min("_gap").alias("gap"), F.array_sort(F.collect_list(F.when((F.col("_gap") < 0.005) & (F.col("o_top") - F.col("top") > 0.02), F.col("o_id")))).alias("by"),
        F.max(F.when(F.col("_in") & (F.col("o_top") - F.col("top") < -0.02), F.struct("o_top", "o_id"))).alias("s")).collect()}
    met, plain = [], boxes.near_pairs
    monkeypatch.setattr(boxes, "near_pairs", lambda *a, **k: (lambda out: (met.append(out.count()), out)[1])(plain(*a, **k)))
    near = {r["id"]: r for r in boxes.nearest_gap(df, ["g"], 0.05, 0.5).collect()}
    got = {r["id"]: r for r in boxes.box_relations(df, ["g"], 0.5).collect()}
    for i, w in want.items():
        assert abs(near[i]["gap"] - w["gap"]) < 1e-12 and abs(got[i]["gap"] - w["gap"]) < 1e-12
        assert got[i]["blocked_by"] == w["by"] and got[i]["blockers"] == len(w["by"]) and got[i]["supported_by"] == (w["s"]["o_id"] if w["s"] else None)
    assert max(met) <= 40


def test_query_lists_what_blocks(spark):
    from voxelloom.plans import catalog, load_catalog

    got = load_catalog().QUERIES["box_relations"](catalog.Tables(spark, "/root/testdata/sf0.01")).collect()
    assert all(len(r["blocked_by"].split()) == r["blockers"] for r in got) and any(r["blockers"] for r in got)
    assert all((r["supported_by"] is not None) == r["height_inferred"] for r in got) and all(r["gap"] is not None for r in got)


def test_overlaps_of_boxes_that_differ_are_not_rows(spark, monkeypatch):
    """150 differing boxes on one place: the greedy walk and the most overlapped planar box, without rows of pairs."""
    rows = [("a", k, 0.001 * (k % 9), 0.0, 0.3 + k / 500, 0.2 + k % 11 / 100, 0.0, 0.1 + k % 5 / 10, float(k * 37 % 151)) for k in range(150)]
    df = spark.createDataFrame(rows, "g string, id long, cu double, cv double, length double, width double, yaw double, top double, s double")
    met, plain = [], boxes.near_pairs
    monkeypatch.setattr(boxes, "near_pairs", lambda *a, **k: (lambda out: (met.append(out.count()), out)[1])(plain(*a, **k)))
    got = {r["id"]: (r["kept"], r["lost_to"]) for r in boxes.suppress_overlaps(df, ["g"], 0.5, 0.6, 0.15, F.col("s")).collect()}
    kept = []
    for a in sorted(rows, key=lambda r: (-r[8], r[1])):
        over = [b for b in kept if abs(a[7] - b[7]) < 0.15 and _iou(a, b) > 0.6]
        assert got[a[1]] == (not over, over[0][1] if over else None), a[1]
        kept += [] if over else [a]
    both = {(r["id"], r["origin"]) for r in boxes.resolve_two_passes(df.filter("id % 3 > 0"), df.filter("id % 3 = 0"), ["g"], 0.5, 0.6, 0.15, 1.2).collect()}
    soft, planar, want = [r for r in rows if r[1] % 3 == 0], [r for r in rows if r[1] % 3], set()
    gone = set()
    for a in soft:
        near = [(_iou(a, b), -b[1], b) for b in planar if abs(a[7] - b[7]) < 0.15 and _iou(a, b) > 0.6]
        top = max(near)[2] if near else None
        wins = top is not None and a[4] * a[5] / (top[4] * top[5]) >= 1.2
        want |= {(a[1], "recovery")} if wins or top is None else set()
        gone |= {top[1]} if wins else set()
    assert both == want | {(b[1], "planar") for b in planar if b[1] not in gone} and max(met) <= 60
