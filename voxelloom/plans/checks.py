"""Queries that gate records, clusters and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.operators import checks, filters
from voxelloom.plans.aligning import BELT, belt
from voxelloom.plans.catalog import query, rounded


@query("serial_gate", """WITH r AS (SELECT user_id % 10 AS rig, event_type AS camera, CASE WHEN event_id % 5 > 0 THEN CAST(100 + user_id % 3 AS VARCHAR) END AS serial FROM events), k AS (SELECT event_type AS camera, CAST(100 + min(length(event_type)) % 3 AS VARCHAR) AS wanted FROM events GROUP BY event_type)
  SELECT rig, camera, serial, wanted, count(*) AS records FROM r JOIN k USING (camera) WHERE serial IS NOT NULL AND serial <> wanted GROUP BY ALL""")
def serial_gate(t):
    e = t.table("events")
    records = e.select((F.col("user_id") % 10).alias("rig"), F.col("event_type").alias("camera"), F.when(F.col("event_id") % 5 > 0, 100 + F.col("user_id") % 3).alias("serial"))
    known = e.groupBy(F.col("event_type").alias("camera")).agg((100 + F.min(F.length("event_type")) % 3).alias("serial"))
    return checks.serial_gate(records, known, ["rig"])


@query("curtain_reasons", f"""WITH {BELT}, c AS (SELECT capture, count(*) FILTER (h > 0.05 AND h < 0.15) AS mid, count(*) FILTER (h >= 0.17) AS face, max(v) - min(v) AS short FROM belt GROUP BY capture)
  SELECT capture, round(mid / greatest(face, 1), 8) AS skirt_ratio, round(short, 8) AS short, array_to_string(list_filter([CASE WHEN short < 3.75 THEN 'short side' END, CASE WHEN mid / greatest(face, 1) > 0.9 THEN 'skirt' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def curtain_reasons(t):
    p = belt(t).withColumn("top", F.lit(0.2))
    c = filters.curtain_filter(p, ["capture"], "h", "top", 0.03, 0.9).join(p.groupBy("capture").agg((F.max("v") - F.min("v")).alias("short")), "capture")
    c = checks.curtain_reasons(c, F.col("short"), F.col("skirt_ratio"), 3.75, 0.9)
    return rounded(c.select("capture", "skirt_ratio", "short", F.array_join("curtain_reasons", ",").alias("reasons")), 8, "skirt_ratio", "short")


@query("channel_clipping", """WITH p AS (SELECT l_returnflag AS camera, CAST(l_quantity * 5 AS DOUBLE) AS r, CAST(l_discount * 2540 AS DOUBLE) AS g, CASE WHEN l_linenumber < 6 THEN CAST(l_tax * 3000 AS DOUBLE) END AS b FROM lineitem)
  SELECT camera, round(avg(CAST(greatest(r, g, b) >= 254 AS INT)), 8) AS clipped_high, round(avg(CAST(greatest(r, g, b) <= 20 AS INT)), 8) AS clipped_low, round((sum(r) + sum(g) + coalesce(sum(b), 0)) / (count(r) + count(g) + count(b)), 6) AS level FROM p GROUP BY camera""")
def channel_clipping(t):
    p = t.table("lineitem").select(F.col("l_returnflag").alias("camera"), (F.col("l_quantity") * 5).cast("double").alias("r"), (F.col("l_discount") * 2540).cast("double").alias("g"), F.when(F.col("l_linenumber") < 6, (F.col("l_tax") * 3000).cast("double")).alias("b"))
    return rounded(rounded(checks.channel_clipping(p, ["camera"], ["r", "g", "b"], low=20), 8, "clipped_high", "clipped_low"), 6, "level")
