"""A quick slice of the catalogue against DuckDB; check.py runs all of it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
QUICK = ["height_raster", "cell_compare", "layer_report", "suppressed_peaks", "project_brown", "unproject", "voxel_mean", "cross_camera_support", "edge_filter", "common_mode_split", "leave_one_height_out",
         "subset_visibility", "parse_run", "stage_stats_hot", "pick_order_hot", "metadata_inventory_nested", "assemble_frame_sets", "stage_perf"]


def test_contract():
    q, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 180 and len(sql) > 130


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    _, _, verdict = compare(spark, con, FOLDER, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict
