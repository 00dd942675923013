import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.sources import grids, records


def write_ply(path, xyz, rgb, fmt):
    with open(path, "wb") as f:
        f.write(f"ply\nformat {fmt} 1.0\ncomment made here\nelement vertex {len(xyz)}\n".encode())
        f.write(b"property double x\nproperty double y\nproperty double z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n")
        if fmt == "ascii":
            for p, c in zip(xyz, rgb):
                f.write((" ".join(map(repr, map(float, p))) + " " + " ".join(map(str, c)) + "\n").encode())
        else:
            a = np.zeros(len(xyz), dtype=[("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
            for i, k in enumerate("xyz"):
                a[k] = xyz[:, i]
            for i, k in enumerate("rgb"):
                a[k] = rgb[:, i]
            f.write(a.tobytes())


@pytest.mark.parametrize("fmt", ["ascii", "binary_little_endian"])
def test_ply_is_read_whole_by_many_tasks(spark, scratch, fmt):
    rng = np.random.default_rng(0)
    xyz, rgb = rng.normal(size=(5000, 3)), rng.integers(0, 256, (5000, 3)).astype("uint8")
    write_ply(f"{scratch}/a.ply", xyz, rgb, fmt)
    df = grids.read_points(spark, f"{scratch}/*.ply", rowsPerPartition=300)
    assert df.rdd.getNumPartitions() > 3
    rows = df.orderBy("pid").select("x", "y", "z", "r", "g", "b").toPandas().to_numpy()
    assert rows.shape == (5000, 6)
    np.testing.assert_allclose(rows[:, :3], xyz)
    np.testing.assert_array_equal(rows[:, 3:], rgb)
    assert df.select("pid").distinct().count() == 5000


def test_ascii_faces_are_not_vertices(spark, scratch):
    with open(f"{scratch}/m.ply", "w") as f:
        f.write("ply\nformat ascii 1.0\nelement vertex 3\nproperty double x\nproperty double y\nproperty double z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n")
        f.write("0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n3 2 1 0\n")
    got = grids.read_points(spark, f"{scratch}/m.ply", rowsPerPartition=1).select("x", "y", "z").collect()
    assert sorted(map(tuple, got)) == [(0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)]


def test_depth_grids(spark, scratch):
    grid = np.arange(60.0).reshape(6, 10).astype("float32")
    np.save(f"{scratch}/depth_left.npy", grid)
    np.savez(f"{scratch}/depth_top.npz", flag=np.int32(1), depth=grid[None] * 2)
    df = grids.read_depth(spark, f"{scratch}/depth_*", rowsPerPartition=4)
    assert df.count() == 120
    left = df.filter("camera = 'left'").orderBy("v", "u").toPandas()["z"].to_numpy()
    np.testing.assert_allclose(left, grid.ravel())
    assert df.filter("camera = 'top' and u = 9 and v = 5").first()["z"] == 118.0


def test_cameras_need_a_pose(spark, scratch):
    for name in ("left", "top"):
        with open(f"{scratch}/intrinsics_{name}.json", "w") as f:
            json.dump({"camera": name, "lens_id": "L1", "camera_matrix": [[500, 0, 320], [0, 510, 240], [0, 0, 1]], "dist_coeffs": [0.1, 0, 0, 0, 0], "image_size": [640, 480]}, f)
    pose = {"R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "t": [0.1, 0.2, 0.3]}
    with open(f"{scratch}/extrinsics.json", "w") as f:
        json.dump({"cameras": {"left": pose, "top": pose}}, f)
    cams = records.read_cameras(spark, f"{scratch}/intrinsics_*.json", f"{scratch}/extrinsics.json").orderBy("camera").collect()
    assert [c["camera"] for c in cams] == ["left", "top"] and cams[0]["fy"] == 510 and cams[0]["R"][4] == 1.0
    with open(f"{scratch}/short.json", "w") as f:
        json.dump({"cameras": {"left": pose}}, f)
    with pytest.raises(Exception, match="no extrinsics for camera top"):
        records.read_cameras(spark, f"{scratch}/intrinsics_*.json", f"{scratch}/short.json").collect()


def test_box_logs_with_drifting_columns(spark, scratch):
    with open(f"{scratch}/boxes_log.csv", "w") as f:
        f.write('capture,id,x_m,cautions\n1,0,0.5,"close, tall"\n1,1,,\n')
    with open(f"{scratch}/boxes_log_2.csv", "w") as f:
        f.write("capture,id,x_m,n_views\n7,3,1.5,2\n")
    logs = records.box_log_columns(records.read_box_logs(spark, scratch), {"capture": "bigint", "id": "bigint", "x_m": "double", "cautions": "string", "n_views": "int"})
    rows = {(r["capture"], r["id"]): r for r in logs.collect()}
    assert rows[(1, 0)]["cautions"] == "close, tall" and rows[(1, 1)]["x_m"] is None
    assert rows[(7, 3)]["n_views"] == 2 and rows[(1, 0)]["n_views"] is None


def test_correction_gates(spark, scratch):
    doc = {"model": "m1", "lens_id": "L1", "shared": {"p": 0.8, "q": 0.01, "alpha": 1.25, "beta": -0.0125},
           "views": {"left": {"alpha": 1.2, "beta": -0.01, "d_cam": 2.0, "n_cam": [0, 0, 1]}, "top": {"alpha": -1.0, "beta": 0, "d_cam": 2.0, "n_cam": [0, 0, 1]}}}
    with open(f"{scratch}/c.json", "w") as f:
        json.dump(doc, f)
    row = records.load_correction(spark, f"{scratch}/c.json", "m1", ["left"], "L1").first()
    assert row["alpha"] == 1.2 and row["beta"] == -0.01
    shared = records.load_correction(spark, f"{scratch}/c.json", "m1", ["left"], "L1", view_terms=False).first()
    assert abs(shared["alpha"] - 1.25) < 1e-12 and abs(shared["beta"] + 0.0125) < 1e-12
    for model, cams, lens, text in (("m2", ["left"], "L1", "another model"), ("m1", ["left"], "L2", "another lens"), ("m1", ["top"], "L1", "alpha must be positive"), ("m1", ["right"], "L1", "lacks a camera")):
        with pytest.raises(Exception, match=text):
            records.load_correction(spark, f"{scratch}/c.json", model, cams, lens).collect()


def test_capture_meta_skew(spark, scratch):
    from voxelloom.operators.calib import skew_report

    cams = {n: {"serial": n, "t_call_ns": 1_000_000 * i, "t_device_ns": 5_000_000_000 + d, "file": n, "shape": [2, 2, 3]} for i, (n, d) in enumerate((("left", 0), ("top", 313_080_368), ("right", 7_000_000)))}
    with open(f"{scratch}/meta.json", "w") as f:
        json.dump({"capture_local_time": "2026-08-04T09:26:15", "cameras": cams, "skew_ms": 313.080368}, f)
    r = skew_report(records.read_capture_meta(spark, f"{scratch}/meta.json"), ["file"]).first()
    assert abs(r["skew_ms"] - 313.080368) < 1e-9 and r["worst_camera"] == "top" and r["clock"] == "device"


def test_capture_rewrite_replaces_only_its_partitions(spark, scratch):
    df = spark.range(6).select(F.lit("r").alias("run_id"), (F.col("id") % 2).alias("capture_id"), F.lit("left").alias("camera"), F.col("id").alias("z"))
    records.write_capture(df, f"{scratch}/cap")
    records.write_capture(df.filter("capture_id = 1").withColumn("z", F.lit(-1)), f"{scratch}/cap")
    back = spark.read.parquet(f"{scratch}/cap").groupBy("capture_id").agg(F.sum("z").alias("s")).orderBy("capture_id").collect()
    assert [tuple(r) for r in back] == [(0, 6), (1, -3)]


def test_scene_boxes_grades(spark, scratch):
    with open(f"{scratch}/scene.json", "w") as f:
        json.dump({"source": "scan", "deck_plane": {"n": [0, 0, 1], "d": -3.07}, "floor_plane": {"n": [0, 0, 1], "d": -3.8}, "parcels": [{"id": "P1", "x": 0.1, "y": 0.2, "L_mm": 300, "W_mm": 200, "H_mm": 150}]}, f)
    planes, parcels = records.read_scene(spark, f"{scratch}/scene.json")
    assert planes.count() == 2 and parcels.first()["H_mm"] == 150
    with open(f"{scratch}/boxes.json", "w") as f:
        json.dump({"capture": 3, "boxes": [{"id": 0, "n_points": 10, "top_face": {"height_above_conveyor_m": 0.2}, "pickable": True, "reasons": []}, {"id": 1, "n_points": 20, "reasons": ["a"]}]}, f)
    assert records.read_boxes(spark, f"{scratch}/boxes.json").count() == 2
    records.write_grades(spark.createDataFrame([("left+top", 2, 9.0)], "subset string, n_cams int, extra double"), f"{scratch}/grades")
    back = spark.read.option("header", True).csv(f"{scratch}/grades")
    assert back.columns == records.GRADE_FIELDS and back.first()["subset"] == "left+top"
