"""The grade row against numpy on a small scene."""

import math

import numpy as np
import pandas as pd

from voxelloom.operators import grades
from voxelloom.sources import records


def scene(rng, n, bias=0.0):
    """Deck at 0 and two parcels, in metres, as seen by one camera."""
    u, v = rng.uniform(-1, 1, n), rng.uniform(-0.4, 0.4, n)
    h = np.where((np.abs(u + 0.4) < 0.25) & (np.abs(v) < 0.2), 0.20, np.where((np.abs(u - 0.5) < 0.2) & (np.abs(v) < 0.3), 0.12, 0.0))
    return np.column_stack([u, v, h * (1 - 0.05 * (h > 0)) + bias + rng.normal(0, 0.001, n)])


def test_grade_row_equals_numpy(spark):
    rng = np.random.default_rng(1)
    offsets = {"a": 0.0, "b": 0.004, "c": -0.006}
    views = {c: scene(rng, 1500, o) for c, o in offsets.items()}
    fused = np.concatenate(list(views.values()))
    ref = np.column_stack([rng.uniform(-1, 1, 3000), rng.uniform(-0.4, 0.4, 3000), np.zeros(3000)])
    ref[:, 2] = np.where((np.abs(ref[:, 0] + 0.4) < 0.25) & (np.abs(ref[:, 1]) < 0.2), 0.20, np.where((np.abs(ref[:, 0] - 0.5) < 0.2) & (np.abs(ref[:, 1]) < 0.3), 0.12, 0.0)) + rng.normal(0, 0.0005, 3000)
    cams = {"a": (0.0, 0.0, 2.0), "b": (1.0, 0.2, 2.0), "c": (-0.8, 0.5, 2.1)}
    frame = lambda rows, names: spark.createDataFrame(pd.DataFrame(rows, columns=names))
    f = frame([("r1", k, *map(float, p)) for k, p in enumerate(fused)] + [("r2", k, *map(float, p)) for k, p in enumerate(fused[:30])], ["run", "pid", "u", "v", "h"])
    w = frame([("r1", c, 10000 * i + k, *map(float, p)) for i, (c, v) in enumerate(views.items()) for k, p in enumerate(v)] + [("r2", "a", k, *map(float, p)) for k, p in enumerate(fused[:30])], ["run", "camera", "pid", "u", "v", "h"])
    r = frame([("s", k, *map(float, p)) for k, p in enumerate(ref)], ["scene", "pid", "u", "v", "h"])
    centres = frame([(c, *x) for c, x in cams.items()], ["camera", "x", "y", "z"])
    runs = frame([("r1", "s", "abc", 504, "4x4"), ("r2", "s", "a", 504, "4x4"), ("r3", "none", "b", 504, "4x4")], ["run", "scene", "subset", "res", "depth_grid"])
    cell, hu, hv = 0.05, 1.0, 0.4
    got = grades.grade_table(runs, f, w, r, centres, ["run"], cell, hu, hv, 0.05, 0.03, 0.06, (0.05, 0.6), 0.010, 0.1, min_view=100)
    assert got.columns == ["run", *records.GRADE_FIELDS]
    rows = {x["run"]: x for x in got.collect()}

    def raster(p):
        i = np.clip(np.floor((p[:, 0] + hu + 0.05) / cell), 0, math.floor(2 * (hu + 0.05) / cell)).astype(int)
        j = np.clip(np.floor((p[:, 1] + hv + 0.05) / cell), 0, math.floor(2 * (hv + 0.05) / cell)).astype(int)
        return {k: float(np.median(x)) for k, x in pd.DataFrame({"k": list(zip(i, j)), "h": p[:, 2]}).groupby("k")["h"]}

    a, b = raster(fused), raster(ref)
    cells = sorted(set(a) & set(b))
    hr, hg = np.array([a[k] for k in cells]), np.array([b[k] for k in cells])
    e = (hr - hg) * 1000
    x = rows["r1"]
    close = lambda name, value: abs(x[name] - value) < 1e-6 or print(name, x[name], value)
    assert (x["n_cams"], x["n_points"], x["cells_recon"]) == (3, 4500, len(a)) and close("coverage_frac", len(cells) / len(b)) and close("coverage_m2", len(a) * cell**2)
    assert close("err_median_mm", np.median(e)) and close("err_rms_mm", np.sqrt((e**2).mean())) and close("err_p95_mm", np.percentile(np.abs(e), 95))
    top = hg > 0.06
    assert x["n_cells_tops"] == top.sum() and close("top_err_median_mm", np.median(e[top])) and close("top_err_p95_mm", np.percentile(np.abs(e[top]), 95)) and close("top_err_rms_mm", np.sqrt((e[top] ** 2).mean()))
    assert abs(x["p_relief"] - 0.95) < 0.02 and close("line_resid_rms_mm", np.sqrt(((hr - (x["p_relief"] * hg + x["q_mm"] / 1000)) ** 2).mean()) * 1000)
    deck = fused[np.abs(fused[:, 2]) <= 0.03]
    n = np.linalg.svd(deck - deck.mean(0))[2][-1]
    assert close("deck_offset_mm", np.median(deck[:, 2]) * 1000) and close("deck_rms_mm", np.sqrt((deck[:, 2] ** 2).mean()) * 1000) and close("deck_tilt_deg", math.degrees(math.acos(abs(n[2]))))
    d = np.sqrt(((fused[:, None] - ref[None]) ** 2).sum(2))
    assert close("accuracy_mm", np.median(d.min(1)) * 1000) and close("completeness_mm", np.median(d.min(0)) * 1000) and close("complete_at_10mm", (d.min(0) < 0.010).mean())
    domain = {(i - 1, j - 1) for (i, j), h in b.items() if h > 0.05 and 0 <= i - 1 < int(2 * hu / cell) + 1 and 0 <= j - 1 < int(2 * hv / cell) + 1}
    seen = [{(int((u + hu) / cell), int((v + hv) / cell)) for u, v, h in p if 0.05 < h < 0.6} for p in views.values()]
    for k in (1, 2, 3):
        assert close(f"mv{k}_m2", sum(sum(c in s for s in seen) >= k for c in domain) * cell**2)
    assert close("mv2_frac", sum(sum(c in s for s in seen) >= 2 for c in domain) / len(domain))
    off = np.array([np.median(p[(p[:, 2] > 0.05) & (p[:, 2] < 0.6), 2]) for p in views.values()]) * 1000
    assert close("layer_belt_frame_sd_mm", off.std(ddof=1)) and close("layer_belt_frame_range_mm", np.ptp(off)) and (x["layer_n_views_used"], x["layer_thin_views"]) == (3, 0)
    assert abs(x["layer_belt_spread_mm"] - 10) < 1 and abs(x["layer_belt_sd_mm"] - np.std([0, 4, -6], ddof=1)) < 0.6 and x["layer_above_n_views"] == 3
    p = np.array(list(cams.values()))
    s = np.linalg.svd(p - p.mean(0))[1]
    assert close("cond", s[1] / s[0])
    thin, none = rows["r2"], rows["r3"]
    assert thin["n_points"] == 30 and thin["err_median_mm"] is None and thin["accuracy_mm"] is None and none["n_points"] is None and none["subset"] == "b"


def test_every_point_has_its_own_neighbour(spark):
    """Line items share their ids here: chamfer medians of the query against all pairs, for the last run."""
    import duckdb
    import numpy as np

    from voxelloom.plans import catalog, load_catalog

    folder = "/root/testdata/sf0.01"
    got = {r["run"]: r for r in load_catalog().QUERIES["grade_table"](catalog.Tables(spark, folder)).collect()}
    run = max(r for r in got if got[r]["accuracy_mm"] is not None)
    c = duckdb.connect().execute(f"""SELECT l_linenumber < 5 AS own, l_quantity - 25.5 AS u, round(l_discount * 100) - 5 AS v, l_extendedprice / 1000 AS h FROM '{folder}/lineitem.parquet'
        WHERE year(l_shipdate) = {run} AND abs(l_quantity - 25.5) <= 22.05 AND abs(round(l_discount * 100) - 5) <= 4.05""").fetchnumpy()
    p = np.column_stack([c["u"], c["v"], c["h"]])
    a, b = p[c["own"]], p[~c["own"]]
    near = lambda x, y: np.concatenate([np.sqrt(((q[:, None] - y[None]) ** 2).sum(2).min(1)) for q in np.array_split(x, 20)])
    there, back = near(a, b), near(b, a)
    assert abs(got[run]["accuracy_mm"] - np.median(there)) < 1e-6 and abs(got[run]["completeness_mm"] - np.median(back)) < 1e-6
    assert abs(got[run]["complete_at_10mm"] - (back < 1.0).mean()) < 2e-6
