"""Queries that replay the frame table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.plans.catalog import CAMS, FRAMES, Tables, query, rounded
from voxelloom.streaming import stateful, timers, windows


def frame_stream(t: Tables):
    return windows.read_table_stream(t.spark, t.folder, "events").select(
        (F.col("user_id") % 10).alias("rig"), F.col("event_type").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("metric"), "user_id")


def cameras(t: Tables) -> list[str]:
    """The camera names of the frame table; a rig has a handful."""
    return [r[0] for r in t.table("events").select("event_type").distinct().orderBy("event_type").collect()]


SETS = f"""{FRAMES}, cams AS (SELECT list_sort(list(DISTINCT camera)) AS l FROM frames), x AS (SELECT f.rig, f.ts, f.seq, c.cam, max(CASE WHEN f.camera = c.cam THEN epoch_us(f.ts) END) OVER (PARTITION BY f.rig, c.cam ORDER BY f.ts, f.seq) AS last FROM frames f, (SELECT unnest(l) AS cam FROM cams) c),
  s AS (SELECT rig, ts, seq, (max(last) - min(last)) / 1000 AS spread_ms FROM x GROUP BY ALL HAVING count(last) = count(*))"""


def frame_sets(t: Tables):
    f = frame_stream(t).withColumn("host_ns", F.unix_micros("ts") * 1000).withColumn("dev_ns", F.lit(None).cast("long"))
    return windows.replay(stateful.assemble_frame_sets(f, cameras(t), 3_600_000.0 * 4))


@query("assemble_frame_sets", f"WITH {SETS} SELECT rig, seq, round(spread_ms, 6) AS spread_ms, spread_ms <= 14400000 AS accepted FROM s")
def assemble_frame_sets(t):
    return rounded(frame_sets(t).select("rig", "seq", "spread_ms", "accepted"), 6, "spread_ms")


@query("acquisition_window", f"WITH {SETS} SELECT rig, time_bucket(INTERVAL '1 day', ts) AS start, count(*) FILTER (spread_ms <= 14400000) AS complete, count(*) FILTER (spread_ms > 14400000) AS incomplete FROM s GROUP BY ALL")
def acquisition_window(t):
    return windows.acquisition_window(frame_sets(t), ["rig"], "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


SETTLE = f"""WITH RECURSIVE {FRAMES}, f AS (SELECT rig, seq, metric, row_number() OVER (PARTITION BY rig ORDER BY ts, seq) AS k FROM frames),
  st AS (SELECT rig, 1::BIGINT AS k, metric AS prev, 0 AS cnt, true AS armed, false AS fired, seq FROM f WHERE k = 1
  UNION ALL SELECT rig, k, metric, CASE WHEN arm AND c >= 2 THEN 0 ELSE c END, arm AND NOT (arm AND c >= 2), arm AND c >= 2, seq FROM (SELECT n.rig, n.k, n.metric, n.seq, st.armed OR abs(n.metric - st.prev) > 40 AS arm,
    CASE WHEN abs(n.metric - st.prev) <= 10 THEN (CASE WHEN abs(n.metric - st.prev) > 40 THEN 0 ELSE st.cnt END) + 1 ELSE greatest(0, (CASE WHEN abs(n.metric - st.prev) > 40 THEN 0 ELSE st.cnt END) - 1) END AS c FROM st JOIN f n ON n.rig = st.rig AND n.k = st.k + 1))"""


@query("settle_trigger", f"{SETTLE} SELECT rig, seq, fired FROM st")
def settle_trigger(t):
    f = frame_stream(t).withColumn("grey", F.array("metric"))
    return windows.replay(stateful.settle_trigger(f, 10.0, 2, 40.0)).select("rig", "seq", "fired")


@query("trigger_policy", f"WITH {FRAMES}, f AS (SELECT rig, seq, row_number() OVER (PARTITION BY rig ORDER BY ts, seq) AS k FROM frames) SELECT rig, seq, k % 5 = 0 AS fired FROM f")
def trigger_policy(t):
    f = frame_stream(t).withColumn("grey", F.array("metric"))
    return windows.replay(stateful.settle_trigger(f, 10.0, 2, 40.0, mode="continuous", every=5)).select("rig", "seq", "fired")


TIMEOUT = f"""WITH RECURSIVE {FRAMES}, f AS (SELECT rig, seq, ts, metric, row_number() OVER (PARTITION BY rig ORDER BY ts, seq) AS k FROM frames),
  st AS (SELECT rig, 1::BIGINT AS k, metric AS prev, 0 AS cnt, true AS armed, false AS fired, false AS forced, epoch_us(ts) AS since, seq FROM f WHERE k = 1
  UNION ALL SELECT rig, k, metric, CASE WHEN fire OR late THEN 0 ELSE c END, arm AND NOT fire AND NOT late, fire OR late, late, CASE WHEN fire OR late THEN now ELSE since END, seq FROM (SELECT *, NOT fire AND now - since >= 7200000000 AS late FROM (SELECT *, arm AND c >= 2 AS fire FROM (
    SELECT n.rig, n.k, n.metric, n.seq, epoch_us(n.ts) AS now, st.since, st.armed OR abs(n.metric - st.prev) > 40 AS arm,
    CASE WHEN abs(n.metric - st.prev) <= 10 THEN (CASE WHEN abs(n.metric - st.prev) > 40 THEN 0 ELSE st.cnt END) + 1 ELSE greatest(0, (CASE WHEN abs(n.metric - st.prev) > 40 THEN 0 ELSE st.cnt END) - 1) END AS c FROM st JOIN f n ON n.rig = st.rig AND n.k = st.k + 1))))"""


@query("settle_timeout", f"{TIMEOUT} SELECT rig, seq, fired, forced FROM st")
def settle_timeout(t):
    f = frame_stream(t).withColumn("grey", F.array("metric"))
    return windows.replay(stateful.settle_trigger(f, 10.0, 2, 40.0, timeout_s=7200.0)).select("rig", "seq", "fired", "forced")


@query("online_align", f"""WITH RECURSIVE {FRAMES}, f AS (SELECT rig || '/' || camera AS rig_camera, camera, seq, 1 + (metric - 50) / 1000 AS a, metric / 100 AS b, row_number() OVER (PARTITION BY rig, camera ORDER BY ts, seq) AS k FROM frames),
  st AS (SELECT DISTINCT rig_camera, 0::BIGINT AS k, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, -1::BIGINT AS seq FROM f
  UNION ALL SELECT f.rig_camera, f.k, CASE WHEN f.camera = 'view' OR f.a NOT BETWEEN 0.9 AND 1.1 THEN st.a ELSE st.a + greatest(-0.01, least(0.01, (CASE WHEN st.k = 0 THEN 1.0 ELSE 0.3 END)::DOUBLE * (f.a - st.a))) END,
    CASE WHEN f.camera = 'view' THEN st.b ELSE st.b + greatest(-0.15, least(0.15, (CASE WHEN st.k = 0 THEN 1.0 ELSE 0.3 END)::DOUBLE * (f.b - st.b))) END, f.seq FROM st JOIN f ON f.rig_camera = st.rig_camera AND f.k = st.k + 1)
  SELECT rig_camera, seq, round(a, 8) AS a, round(b, 8) AS b FROM st WHERE k > 0""")
def online_align(t):
    f = frame_stream(t).select(F.concat_ws("/", "rig", "camera").alias("rig_camera"), "camera", "ts", "seq", (1 + (F.col("metric") - 50) / 1000).alias("a"), (F.col("metric") / 100).alias("b"))
    return rounded(windows.replay(stateful.online_align(f, "view")).select("rig_camera", "seq", "a", "b"), 8, "a", "b")


NOVEL = f"""WITH RECURSIVE {FRAMES}, f AS (SELECT rig, seq, metric / 20 AS a, metric / 100 AS t, row_number() OVER (PARTITION BY rig ORDER BY ts, seq) AS k FROM frames),
  st AS (SELECT rig, 1::BIGINT AS k, seq, true AS accepted, [{{'a': a, 't': t}}] AS seen FROM f WHERE k = 1
  UNION ALL SELECT rig, k, seq, ok, CASE WHEN ok THEN list_append(seen, {{'a': a, 't': t}}) ELSE seen END FROM (SELECT n.*, st.seen, len(list_filter(st.seen, lambda q: degrees(acos(greatest(-1, least(1, cos(q.a - n.a))))) < 25 AND abs(q.t - n.t) < LIMIT)) = 0 AS ok
    FROM st JOIN f n ON n.rig = st.rig AND n.k = st.k + 1)) SELECT rig, seq, accepted FROM st"""


def posed_views(t: Tables):
    z, o = F.lit(0.0), F.lit(1.0)
    ang = F.col("metric") / 20
    return frame_stream(t).select("rig", "ts", "seq", F.array(F.cos(ang), -F.sin(ang), z, F.sin(ang), F.cos(ang), z, z, z, o).alias("R"), F.array(F.col("metric") / 100, z, z).alias("t"))


@query("novelty_filter", NOVEL.replace("LIMIT", "1.0"))
def novelty_filter(t):
    return windows.replay(stateful.novelty_filter(posed_views(t), 25.0, 1.0)).select("rig", "seq", "accepted")


@query("novel_views", NOVEL.replace("LIMIT", "0.1"))
def novel_views(t):
    return windows.replay(timers.novel_views(posed_views(t), 25.0, 0.1)).select("rig", "seq", "accepted")


@query("run_bounds", f"WITH {FRAMES}, f AS (SELECT rig, seq, ts, row_number() OVER (PARTITION BY rig ORDER BY ts, seq) AS k, min(ts) OVER (PARTITION BY rig) AS t0 FROM frames) SELECT rig, seq FROM f WHERE k <= 60 AND epoch_us(ts) - epoch_us(t0) <= 864000000000")
def run_bounds(t):
    return windows.replay(stateful.run_bounds(frame_stream(t), 60, 864_000.0)).select("rig", "seq")


# append mode emits a window once the watermark (latest event less the delay, in ms) has passed its end
MARK = "(SELECT date_trunc('milliseconds', max(ts)) FROM frames)"


@query("stage_perf", f"""WITH {FRAMES} SELECT camera, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(avg(metric), 6) AS mean, min(metric) AS min, max(metric) AS max FROM frames GROUP BY ALL
  HAVING time_bucket(INTERVAL '1 hour', any_value(ts)) + INTERVAL '1 hour' <= {MARK} - INTERVAL '10 minutes'""")
def stage_perf(t):
    s = windows.replay(windows.window_stats(frame_stream(t), ["camera"], "metric", "1 hour"))
    return rounded(s.withColumn("start", F.col("start").cast("timestamp_ntz")).drop("end"), 6, "mean")


@query("window_summaries", f"""WITH {FRAMES}, w AS (SELECT rig, metric, time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS start FROM frames, (SELECT unnest([0, 1]) AS k)) SELECT rig, start, count(*) AS n, round(avg(metric), 6) AS mean, min(metric) AS min, max(metric) AS max FROM w GROUP BY ALL
  HAVING start + INTERVAL '12 hours' <= {MARK} - INTERVAL '10 minutes'""")
def window_summaries(t):
    s = windows.replay(windows.window_stats(frame_stream(t), ["rig"], "metric", "12 hours", slide="6 hours"))
    return rounded(s.withColumn("start", F.col("start").cast("timestamp_ntz")).drop("end"), 6, "mean")


@query("session_summaries", f"""WITH {FRAMES}, g AS (SELECT rig, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY rig ORDER BY ts) >= INTERVAL '2 hours' THEN 1 ELSE 0 END AS brk FROM frames), s AS (SELECT rig, ts, sum(coalesce(brk, 0)) OVER (PARTITION BY rig ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT rig, min(ts) AS start, count(*) AS n FROM s GROUP BY rig, k HAVING max(ts) + INTERVAL '2 hours' <= {MARK} - INTERVAL '10 minutes'""")
def session_summaries(t):
    s = windows.replay(windows.session_summaries(frame_stream(t), ["rig"], "2 hours"))
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).drop("end")


@query("camera_health", f"WITH {FRAMES} SELECT rig, camera, count(*) AS frames, count(*) FILTER (metric >= 90) AS failures, round(CASE WHEN max(ts) > min(ts) THEN (count(*) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END, 9) AS mean_fps, count(*) FILTER (metric >= 90) > 50 AS given_up FROM frames GROUP BY ALL")
def camera_health(t):
    f = frame_stream(t).withColumn("ok", F.col("metric") < 90).withColumn("err", F.concat(F.lit("value "), F.floor("metric").cast("string")))
    return rounded(windows.replay(windows.camera_health(f, ["rig", "camera"], "ok", "err"), "complete").drop("errors"), 9, "mean_fps")


@query("stream_deduplicated", f"WITH {FRAMES} SELECT DISTINCT rig, camera, seq FROM frames")
def stream_deduplicated(t):
    f = frame_stream(t).select("rig", "camera", "seq", "ts")
    return windows.replay(windows.deduplicated(f.unionByName(f), ["rig", "camera", "seq"])).select("rig", "camera", "seq")


@query("stream_static_correct", f"WITH {FRAMES} SELECT seq, rig, round(metric * (1 + n_nationkey / 1000.0) + n_regionkey / 100.0, 6)::DOUBLE AS corrected FROM frames JOIN nation ON n_nationkey = rig")
def stream_static_correct(t):
    corr = t.table("nation").select(F.col("n_nationkey").cast("long").alias("rig"), (1 + F.col("n_nationkey") / 1000).alias("alpha"), (F.col("n_regionkey") / 100).alias("beta"))
    f = windows.with_static(frame_stream(t), corr, ["rig"]).select("seq", "rig", (F.col("metric") * F.col("alpha") + F.col("beta")).alias("corrected"))
    return rounded(windows.replay(f), 6, "corrected")


@query("capture_log", f"WITH {FRAMES} SELECT rig, camera, count(*) AS logged FROM frames GROUP BY ALL")
def capture_log(t):
    return windows.replay(frame_stream(t).select("rig", "camera", "seq")).groupBy("rig", "camera").agg(F.count(F.lit(1)).alias("logged"))
