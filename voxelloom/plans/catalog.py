"""Registry of runnable queries, each with the SQL that defines the same result where SQL can.

The point, parcel, frame and record tables the operators expect are views over the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[["Tables"], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# The same views in SQL, to be placed after WITH.
CLOUD = """cloud AS (SELECT l_linestatus AS run_id, l_returnflag AS camera, l_quantity - 25.5 AS u,
  round(l_discount * 100) - 5 AS v, l_extendedprice / 1000 AS h, l_orderkey, l_linenumber, l_partkey, l_shipdate,
  date_trunc('month', l_shipdate) AS capture FROM lineitem)"""
POINTS3 = """pts AS (SELECT vec_id AS pid, label AS camera, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""
CAMS = """cams AS (SELECT DISTINCT label AS camera, 500.0 + 10 * label AS fx, 505.0 + 10 * label AS fy, 320.0 + label AS cx, 240.0 - label AS cy,
  640 AS width, 480 AS height, cos(0.1 * label) AS co, sin(0.1 * label) AS si, CAST(0.02 AS DOUBLE) * label AS t0, CAST(-0.01 AS DOUBLE) * label AS t1, CAST(0.5 AS DOUBLE) + CAST(0.03 AS DOUBLE) * label AS t2,
  -0.1 + 0.01 * label AS k1, 0.02 AS k2, 0.001 AS p1, -0.002 AS p2, 0.003 AS k3 FROM embeddings)"""
PLACEMENTS = """placements AS (SELECT o_orderpriority AS camera, n_name AS capture, o_orderstatus AS label,
  c_acctbal / 10000 AS h_true, o_totalprice / 100000 AS h_meas, o_orderkey FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
BOXES = """boxes AS (SELECT p_brand AS capture, p_partkey AS id, (p_partkey % 20) * 0.45 + (p_partkey % 7) * 0.0013 AS cu, CAST((p_partkey // 20) % 40 AS DOUBLE) * 0.45 AS cv,
  0.2 + p_size / 100 AS length, 0.15 + (p_size % 7) / 50 AS width, p_retailprice / 10000 + (p_partkey % 5) / 25 AS top, p_size * 10 AS n_points,
  0.4 + (p_partkey % 13) / 20 AS coverage, 0.5 + (p_partkey % 9) / 20 AS inlier_fraction, p_type FROM part)"""
FRAMES = """frames AS (SELECT user_id % 10 AS rig, event_type AS camera, ts, event_id AS seq, value AS metric, user_id FROM events)"""


class Tables:
    """The given tables of one folder, and the views the operators read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def cloud(self) -> DataFrame:
        """Points in the belt frame; return flag as camera, line status as run, ship month as capture."""
        return self.table("lineitem").select(
            F.col("l_linestatus").alias("run_id"), F.col("l_returnflag").alias("camera"), (F.col("l_quantity") - 25.5).alias("u"),
            (F.round(F.col("l_discount") * 100) - 5).alias("v"), (F.col("l_extendedprice") / 1000).alias("h"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.date_trunc("month", "l_shipdate").alias("capture"))

    def points3(self) -> DataFrame:
        e = F.col("embedding")
        return self.table("embeddings").select(
            F.col("vec_id").alias("pid"), F.col("label").alias("camera"), *[e[i].cast("double").alias("xyz"[i]) for i in range(3)])

    def cameras(self) -> DataFrame:
        k = F.col("camera")
        zero, one = F.lit(0.0), F.lit(1.0)
        co, si = F.cos(0.1 * k), F.sin(0.1 * k)
        return self.table("embeddings").select(F.col("label").alias("camera")).distinct().select(
            "camera", (500.0 + 10 * k).alias("fx"), (505.0 + 10 * k).alias("fy"), (320.0 + k).alias("cx"), (240.0 - k).alias("cy"),
            F.lit(640).alias("width"), F.lit(480).alias("height"),
            F.array(co, -si, zero, si, co, zero, zero, zero, one).alias("R"), F.array(0.02 * k, -0.01 * k, 0.5 + 0.03 * k).alias("t"),
            F.array(-0.1 + 0.01 * k, F.lit(0.02), F.lit(0.001), F.lit(-0.002), F.lit(0.003)).alias("dist"))

    def keypoints(self) -> DataFrame:
        return self.table("embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("kp_id"), F.col("embedding").alias("desc"))

    def placements(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("o_orderpriority").alias("camera"), F.col("n_name").alias("capture"), F.col("o_orderstatus").alias("label"),
            (F.col("c_acctbal") / 10000).alias("h_true"), (F.col("o_totalprice") / 100000).alias("h_meas"), "o_orderkey")

    def boxes(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            # in ten-thousandths first: the SQL's decimals are exact, and points lie on the edges of footprints
            F.col("p_brand").alias("capture"), k.alias("id"), ((k % 20 * 4500 + k % 7 * 13) / 10000).alias("cu"), (F.floor(k / 20) % 40 * 0.45).alias("cv"),
            (0.2 + F.col("p_size") / 100).alias("length"), (0.15 + F.col("p_size") % 7 / 50).alias("width"),
            (F.col("p_retailprice") / 10000 + k % 5 / 25).alias("top"), (F.col("p_size") * 10).alias("n_points"),
            (0.4 + k % 13 / 20).alias("coverage"), (0.5 + k % 9 / 20).alias("inlier_fraction"), F.col("p_size"), F.col("p_type"))

    def frames(self) -> DataFrame:
        return self.table("events").select(
            (F.col("user_id") % 10).alias("rig"), F.col("event_type").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("metric"), "user_id")


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Tables(spark, folder))
