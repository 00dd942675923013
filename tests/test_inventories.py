"""Whole inventories, the relief field and the bleed of sight edges against plain code."""

import csv
import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelloom.operators import boxes, effects, runs


def test_inventory_is_whole_unless_limits_are_given(spark):
    deep = {"end": 1}
    for _ in range(30):
        deep = {"a": [deep]}
    docs = {"deep": deep, "numbers": {"n": list(range(40))}, "list": {"l": [str(i) for i in range(70)]}, "long": {"s": "y" * 500}, "bad": None, "empty": {"o": {}, "l": []}}
    df = spark.createDataFrame([(k, "{oops" if v is None else json.dumps(v)) for k, v in docs.items()] + [("null", None)], "path string, value string")
    whole = {(r["path"], r["keypath"]): r["value"] for r in runs.metadata_inventory(df).collect()}
    assert whole["deep", ".".join(["a[0]"] * 30) + ".end"] == "1" and whole["numbers", "n[39]"] == "39" and whole["list", "l[69]"] == "69" and len(whole["long", "s"]) == 500
    assert len(whole) == 1 + 40 + 70 + 1 and runs.metadata_inventory(df.filter("false")).count() == 0
    short = {(r["path"], r["keypath"]): r["value"] for r in runs.metadata_inventory(df, **runs.FOR_READING).collect()}
    assert short["numbers", "n[len]"] == "40" and short["list", "l[truncated]"] == "70" and ("list", "l[64]") not in short and short["long", "s"] == "y" * 300 + "..."
    assert short["deep", ".".join(["a[0]"] * 6)] == "<max depth>"


def test_csv_headers(spark):
    texts = {
        "plain.csv": "a,b\n1,2\n3,4\n5,6\n7,8\n", "marks.csv": 'x;"p;q";"say ""hi"""\r\n1;"two\nlines";3\r\n', "tabs.tsv": "u\tv,w\n1\t2", "short.csv": "a,b,c\n1\n\n2,,", "head.csv": "only",
        "lead.csv": ",b\n,2\n", "none.csv": "", "quote.csv": '"' + "q" * 30000 + '",z\n1,2\n', "open.csv": 'a,b\n"1,2\n3', "twice.csv": "a,a\n1,2\n",
    }
    df = spark.createDataFrame([*texts.items(), ("null.csv", None)], "path string, value string")
    got: dict = {}
    for r in runs.csv_inventory(df).collect():
        got.setdefault(r["path"], []).append((r["keypath"], r["value"]))
    for name, text in texts.items():
        if not text:
            assert name not in got
            continue
        mark = {"marks.csv": ";", "tabs.tsv": "\t"}.get(name, ",")
        head, *rows = csv.reader(io.StringIO(text.replace("\r\n", "\n"), newline=""), delimiter=mark)
        want = [("[columns]", ", ".join(head)), ("[n_columns]", str(len(head)))]
        for j, h in enumerate(head):
            had = [r[j] for r in rows[:3] if j < len(r)]
            want += [("col." + h, " | ".join(had))] if had else []
        assert got[name] == want, name
    assert "null.csv" not in got and runs.csv_inventory(df.filter("false")).count() == 0


def test_rolling_rate_keeps_null_keys(spark):
    rows = [(k, i) for k in ("a", None) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, i long").withColumn("ts", F.timestamp_seconds(F.col("i") * 2))
    got = {(r["g"], r["i"]): r["rate"] for r in runs.rolling_rate(df, ["g"], "ts", [("i", "asc")], 3).collect()}
    assert got == {(k, i): 0.5 if i else None for k, i in rows}


def test_relief_field(spark):
    rng = np.random.default_rng(3)
    parts = []
    for g, n in ((0, 40), (1, 7), (2, 2), (3, 12)):
        h, x, y = rng.uniform(0, 0.4, n), rng.uniform(-1, 1, n), rng.uniform(-1, 1, n)
        parts.append(pd.DataFrame({"g": g, "x": x, "y": y, "h_true": h, "h_meas": h - (0.002 + h * (0.08 + 0.03 * x - 0.05 * y)) + rng.normal(0, 1e-4, n), "w": rng.uniform(0, 1, n)}))
    p = pd.concat(parts)
    rows = spark.createDataFrame(p).union(spark.createDataFrame([(0, None, 0.0, 1.0, 9.0, 1.0)], "g long, x double, y double, h_true double, h_meas double, w double"))
    got = {r["g"]: r for r in effects.relief_field(rows, ["g"], "x", "y", "h_true", "h_meas", "w").collect()}
    assert set(got) == {0, 1, 3} and got[1]["field_rms"] is None and got[1]["field_kx"] is None
    for g in (0, 3):
        q, r = p[p.g == g], got[g]
        m, h = (q.h_true - q.h_meas).to_numpy(), q.h_true.to_numpy()
        k, c = np.polyfit(h, m, 1)
        a = np.column_stack([np.ones_like(h), h, h * q.x, h * q.y])
        coef = np.linalg.lstsq(a, m, rcond=None)[0]
        want = [k, c, np.sqrt(np.mean((m - k * h - c) ** 2)), np.median(q.w), np.sqrt(np.mean((m - a @ coef) ** 2)), *coef]
        assert np.allclose([r[n] for n in ("compression", "offset", "between_rms", "within_rms", "field_rms", "field_c0", "field_k0", "field_kx", "field_ky")], want, atol=1e-9)
        assert r["field_rms"] < 0.1 * r["between_rms"]
    assert effects.relief_field(rows.filter("false"), ["g"], "x", "y", "h_true", "h_meas", "w").count() == 0


def test_sight_edge_bleed(spark):
    rng = np.random.default_rng(5)
    e = [(b, *rng.uniform(-1, 1, 6).tolist(), *rng.uniform(2, 4, 3).tolist(), float(rng.uniform(0.1, 0.6))) for b in range(4) for _ in range(6)]
    e.append((0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 3.0, 3.0, 3.0, 0.6))  # an edge of no length
    edges = spark.createDataFrame([(0, b, "c", *v) for b, *v in e], "g int, id int, camera string, ax double, ay double, az double, bx double, by_ double, bz double, kx double, ky double, kz double, top double")
    pts = [(b, i, *rng.uniform(-1.5, 1.5, 3).tolist(), float(rng.uniform(0, 0.5)), 0.1) for b in range(6) for i in range(60 if b else 5)]
    points = spark.createDataFrame([(0, b, "c", *v) for b, *v in pts], "g int, id int, camera string, pid int, x double, y double, z double, h double, h_self double")

    def bled(b, q, h, h_self):
        for eb, ax, ay, az, bx, by, bz, kx, ky, kz, top in e:
            a, c, k = np.array([ax, ay, az]), np.array([bx, by, bz]), np.array([kx, ky, kz])
            m = np.cross(c - a, k - a)
            if eb != b or np.linalg.norm(m) < 1e-9 or top - h_self < 0.05 or h >= top - 0.005 or abs((q - a) @ m) / np.linalg.norm(m) >= 0.1:
                continue
            s, t = np.linalg.lstsq(np.column_stack([a - k, c - k]), q - k, rcond=None)[0]
            if s > -0.08 and t > -0.08 and s + t > 0.85:
                return True
        return False

    got = {r["id"]: (r["n"], r["bled"]) for r in boxes.sight_edge_bleed(points, edges, ["g"], 0.1).collect()}
    want = {b: (60, sum(bled(b, np.array(v[1:4]), v[4], v[5]) for k, *v in pts if k == b)) for b in range(1, 6)}
    assert got == want and sum(n for _, n in want.values()) > 3
    assert boxes.sight_edge_bleed(points.filter(F.lit(False)), edges, ["g"], 0.1).count() == 0


def test_edges_out_of_a_boxs_reach_are_left_and_the_rest_met_in_the_join(spark):
    rng = np.random.default_rng(8)
    cols = "g int, id int, camera string, ax double, ay double, az double, bx double, by_ double, bz double, kx double, ky double, kz double, top double"
    near = [(0, b, "c", *rng.uniform(-0.5, 0.5, 6).tolist(), 3.0, 3.0, 2.0, 0.5) for b in range(3) for _ in range(4)]
    far = [(0, b, "c", *(rng.uniform(-0.5, 0.5, 6) + 40).tolist(), 3.0, 3.0, 2.0, 0.5) for b in range(3) for _ in range(200)]
    points = spark.createDataFrame([(0, b, "c", i, *rng.uniform(-0.6, 0.6, 2).tolist(), float("nan") if i == 0 else float(rng.uniform(0, 0.3)), 0.1, 0.1) for b in range(3) for i in range(80)],
                                   "g int, id int, camera string, pid int, x double, y double, z double, h double, h_self double")
    got = [boxes.sight_edge_bleed(points, spark.createDataFrame(e, cols), ["g"], 0.1) for e in (near, near + far + near)]
    assert "LeftSemi" in got[1]._jdf.queryExecution().toString() and "collect_list" not in got[1]._jdf.queryExecution().toString()
    a, b = (sorted((r["id"], r["n"], r["bled"]) for r in g.collect()) for g in got)
    assert a == b and all(n == 80 for _, n, _ in a) and 0 < sum(k for *_, k in a) < 240
