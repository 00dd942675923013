"""Operators no registered query covers alone."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelloom.operators import align, boxes, filters, planes
from voxelloom.sources import records


def test_face_grows_to_its_connected_patch(spark):
    rng = np.random.default_rng(0)
    face = np.column_stack([rng.uniform(0, 0.4, (1500, 2)), rng.normal(0.2, 0.001, 1500)])
    far = np.column_stack([rng.uniform(1.0, 1.4, (300, 2)), rng.normal(0.2, 0.001, 300)])
    p = np.vstack([face, far])
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    seed = spark.createDataFrame([(0, 0.0, 0.0, 1.0, -0.2)], "g int, nx double, ny double, nz double, d double")
    r = boxes.grow_face(df, seed, ["g"], 0.01, 0.05, 0.003, refits=1).first()
    assert r["n"] == 1500 and abs(r["d"] + 0.2 * r["nz"]) < 0.002


def test_parallel_planes(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, -2.0), (0, 1, 0.0, 0.01, 0.99995, -2.2), (0, 2, 1.0, 0.0, 0.0, -1.0)], "g int, rank long, nx double, ny double, nz double, d double")
    rows = planes.parallel_separation(p, ["g"]).collect()
    assert len(rows) == 1 and abs(rows[0]["separation"] - 0.2) < 1e-9


def test_gauge_of_two_cameras(spark):
    rng = np.random.default_rng(1)
    h0 = np.where(np.arange(2000) % 2 == 0, 3.0, 3.4)
    true = 1.37
    h1 = (rng.normal(0, 0.05, 2000) - h0) / true
    df = spark.createDataFrame(pd.DataFrame({"rig": 0, "h0": h0, "h1": h1}))
    s = align.gauge_multi_camera(df, ["rig"]).first()["scale"]
    assert abs(np.median(h0 + s * h1)) < 1e-8 and abs(s - true) < 0.01
    none = align.gauge_multi_camera(df.withColumn("h1", F.lit(1.0)), ["rig"]).first()
    assert none["scale"] is None


def test_frames_and_wide_perf_rows(spark, scratch):
    with open(f"{scratch}/frames.jsonl", "w") as f:
        for k in range(3):
            f.write(json.dumps({"rig": "a", "capture_id": k, "seq": k, "ts": "2026-01-01T00:00:00Z", "n_boxes": k}) + "\n")
    assert records.read_frames(spark, f"{scratch}/frames.jsonl").agg(F.sum("n_boxes")).first()[0] == 3
    assert records.stream_frames(spark, scratch).isStreaming
    long = spark.createDataFrame([(1, c, m, v) for c in ("left", "top") for m, v in (("fps", 3.0), ("drop", 0.1))], "frame int, camera string, metric string, value double")
    records.write_perf(long, f"{scratch}/perf", ["frame"], ["left", "top"])
    assert set(spark.read.parquet(f"{scratch}/perf").columns) == {"frame", "fps_left", "fps_top", "drop_left", "drop_top"}
    box = spark.createDataFrame([(1, 2)], "capture int, id int")
    records.append_box_log(box, f"{scratch}/log")
    records.append_box_log(box, f"{scratch}/log")
    assert spark.read.option("header", True).csv(f"{scratch}/log").count() == 2


def test_belt_and_band_predicates(spark):
    df = spark.createDataFrame([(1.05, 0.0, 0.04), (1.06, 0.0, 0.03), (0.0, 0.0, 0.0401)], "u double, v double, h double").withColumn("length_m", F.lit(2.0)).withColumn("width_m", F.lit(1.0))
    assert [r[0] for r in df.select(filters.in_belt(0.05)).collect()] == [True, False, True]
    band = filters.height_band(F.col("h"), 0.03, 0.04, closed_hi=True)
    assert [r[0] for r in df.select(band).collect()] == [True, False, False]
    assert [r[0] for r in df.select(filters.guarded(F.col("h"), F.lit(10), 50)).collect()] == [None] * 3


def test_box_centres_are_the_exact_decimals_of_the_sql(spark, tmp_path):
    """points lie on the edges of footprints, so the last bit of a centre decides."""
    from decimal import Decimal

    from voxelloom.plans.catalog import Tables

    spark.range(140).selectExpr("'Brand#11' AS p_brand", "id AS p_partkey", "1 AS p_size", "1000.0D AS p_retailprice", "'T' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    for r in Tables(spark, str(tmp_path)).boxes().select("id", "cu").collect():
        assert r["cu"] == float(r["id"] % 20 * Decimal("0.45") + r["id"] % 7 * Decimal("0.0013"))


def test_hot_ranks_use_one_set_of_buckets(spark):
    """the sketch behind the buckets depends on arrival order, so no later step may compute it again."""
    from voxelloom.operators import groups

    rows = spark.range(4000).selectExpr("id % 2 AS g", "id * 7919 % 4001 AS t", "id")
    ranked = groups.rank_in_group(rows, ["g"], [("t", "asc"), ("id", "asc")], "r", hot_rows=50)
    lagged = groups.lag_in_group(rows, ["g"], [("t", "asc"), ("id", "asc")], "t", hot_rows=50)
    for df in (ranked, lagged):
        assert "percentile_approx" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert lagged.filter("prev > t").isEmpty() and lagged.filter("prev is null").count() == 2
    assert ranked.groupBy("g").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count_distinct("r").alias("n")).filter("lo != 0 or hi != 1999 or n != 2000").isEmpty()


def test_no_table_is_broadcast_for_the_size_of_its_file(spark):
    """a small file may hold many rows; only measured rows may be broadcast."""
    import __spark_entry__ as entry
    from voxelloom.session import JOINS

    before = {k: spark.conf.get(k, None) for k in JOINS}
    try:
        df = entry.queries()["match_nearest"](spark, "/root/testdata/sf0.001")
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
        entry.queries()["op9_url_filter"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_key_is_folded_in_pieces(spark):
    """Rows arrive in any order, are held as plain arrays and folded a piece at a time."""
    from voxelloom.streaming.stateful import _plain, in_order

    n = 25
    t0 = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"ts": [t0 + pd.Timedelta(seconds=(k * 7) % n // 2) for k in range(n)], "seq": [(k * 7) % n for k in range(n)],
                         "grey": [np.array([float((k * 7) % n), 1.0]) for k in range(n)], "camera": [f"c{(k * 7) % n % 3}" for k in range(n)], "other": "x"})
    got = list(in_order(iter([rows[:9], rows[9:10], rows[10:]]), ["ts", "seq", "grey", "camera"], piece=10))
    assert [len(g) for g in got] == [10, 10, 5] and list(got[0].columns) == ["ts", "seq", "grey", "camera"]
    flat = pd.concat(got, ignore_index=True)
    assert flat["seq"].tolist() == list(range(n)) and [g[0] for g in flat["grey"]] == list(range(n))
    assert [str(c) for c in flat["camera"]] == [f"c{k % 3}" for k in range(n)]
    ragged = rows.assign(grey=[np.zeros(k % 3) if k % 4 else None for k in range(n)])
    flat = pd.concat(in_order(iter([ragged[:9], ragged[9:]]), ["ts", "seq", "grey"], piece=10), ignore_index=True)
    assert sum(g is None for g in flat["grey"]) == 7
    assert _plain(rows["grey"]).shape == (n, 2)


def test_hot_quantiles_place_values_not_rows(spark, monkeypatch):
    """a hot group of few values is placed in buckets value by value, with counts."""
    from voxelloom.operators import groups

    written = {}
    plain = groups.materialise

    def seen(df, tag="table"):
        out = plain(df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(groups, "materialise", seen)
    rows = spark.range(6000).selectExpr("id % 2 AS g", "cast(id * 7919 % 9 as double) AS v")
    got = {r["g"]: r for r in groups.quantiles(rows, ["g"], "v", {"a": 0.4, "b": 0.99}, hot_rows=50).collect()}
    for g in (0, 1):
        want = np.quantile([k * 7919 % 9 for k in range(6000) if k % 2 == g], [0.4, 0.99])
        assert got[g]["n"] == 3000 and np.allclose([got[g]["a"], got[g]["b"]], want)
    assert written["hot-values"] == 18
