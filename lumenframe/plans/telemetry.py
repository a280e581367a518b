"""Queries over the frame stream that events stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import telemetry as t
from lumenframe.sources.tables import FRAMES_SQL, frames

TOLERANCE, ALLOWED = 0.6, 1_000_000


def plan(spark: SparkSession) -> DataFrame:
    """What is expected of each camera; the fifth sends nothing."""
    return spark.createDataFrame([(f"cam{i}", 0.0002 * (i + 1)) for i in range(5)], "camera string, expected_fps double")


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.verdicts(frames(spark, sf_dir), F.broadcast(plan(spark)), TOLERANCE, ALLOWED)


def frame_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each camera's totals, losses, latency and verdict."""
    f = frames(spark, sf_dir)
    met = verdict(spark, sf_dir).join(t.first_last(f), "camera", "left").join(t.mean_latency(f), "camera", "left")
    return met.fillna(-1, ["first_frame", "last_frame"]).fillna(0, ["latency_ms", "latency_frames"])


def short_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("camera").agg(F.count_if(t.is_short()).alias("short_frames"), F.count("*").alias("frames"))


def size_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("camera").agg(F.count_if(t.is_mismatched()).alias("size_bad"))


def sample_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sampled(frames(spark, sf_dir), 7).select("camera", "arrival", "sequence")


def dump_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sampled(frames(spark, sf_dir), 10, limit=5).select("camera", "arrival", "sequence", "frame_number")


def interval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.interval_rates(frames(spark, sf_dir), 3600)


QUERIES = {
    "frame_health": frame_health,
    "frame_totals": lambda s, d: t.totals(frames(s, d), t.span()),
    "gap_count": lambda s, d: t.gaps(frames(s, d)),
    "counter_delta": lambda s, d: t.counter_growth(frames(s, d)),
    "latency_mean": lambda s, d: t.mean_latency(frames(s, d)),
    "short_frames": short_frames,
    "size_mismatch": size_mismatch,
    "first_last_arrival": lambda s, d: t.first_last(frames(s, d)),
    "interval_rates": interval_rates,
    "warmup_window": lambda s, d: t.warm_window(frames(s, d), 86_400, 10 * 86_400),
    "verdict": verdict,
    "run_summary": lambda s, d: t.run_summary(verdict(s, d)),
    "sample_every_n": sample_every_n,
    "dump_limit": dump_limit,
    "rate_limit": lambda s, d: t.rate_limited(frames(s, d), 1800),
    "publish_sequence": lambda s, d: t.publish_sequence(frames(s, d)).select("camera", "arrival", "sequence"),
}

LOSS = """
, known AS (
  SELECT *, last_value(CASE WHEN frame_number >= 0 THEN frame_number END IGNORE NULLS) OVER w AS last_number,
         last_value(CASE WHEN dropped >= 0 THEN dropped END IGNORE NULLS) OVER w AS last_dropped
  FROM frames WINDOW w AS (PARTITION BY camera ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), loss AS (
  SELECT camera,
         CAST(sum(CASE WHEN frame_number >= 0 AND frame_number > last_number + 1 THEN frame_number - last_number - 1 ELSE 0 END) AS BIGINT) AS gaps,
         CAST(sum(CASE WHEN dropped > last_dropped THEN dropped - last_dropped ELSE 0 END) AS BIGINT) AS dropped_total
  FROM known GROUP BY camera
)
"""
TOTALS = """
, sums AS (
  SELECT camera, count(*) AS frames, CAST(sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) AS BIGINT) AS bytes,
         CAST({span} AS DOUBLE) AS elapsed_s
  FROM frames {where} GROUP BY camera
), totals AS (
  SELECT *, CASE WHEN elapsed_s > 0 THEN frames / elapsed_s ELSE 0.0::DOUBLE END AS fps,
         CASE WHEN elapsed_s > 0 THEN bytes * 8 / elapsed_s ELSE 0.0::DOUBLE END / 1e9 AS gbps
  FROM sums
)
"""
SPAN_SQL = "max(timestamp_s) - min(timestamp_s)"
LATENCY = """
, latency AS (
  SELECT camera, CASE WHEN timestamp_s > 0 AND received_s > 0 AND received_s - timestamp_s > -10 AND received_s - timestamp_s < 10
    THEN ((received_s - timestamp_s) * 1000000000 + received_ns - timestamp_ns) / 1e6 END AS ms
  FROM frames
), mean_latency AS (
  SELECT camera, coalesce(avg(ms), 0.0) AS latency_ms, count(ms) AS latency_frames FROM latency GROUP BY camera
)
"""
ENDS = """
, ends AS (
  SELECT camera, coalesce(arg_min(frame_number, arrival) FILTER (frame_number >= 0), -1)::BIGINT AS first_frame,
         coalesce(arg_max(frame_number, arrival) FILTER (frame_number >= 0), -1)::BIGINT AS last_frame
  FROM frames GROUP BY camera
)
"""
SHORT = "frame_size > 0 AND bytes_written > 0 AND bytes_written < frame_size"
VERDICT = LOSS + TOTALS.format(span=SPAN_SQL, where="") + f"""
, short AS (SELECT camera, count(*) FILTER ({SHORT}) AS short_frames FROM frames GROUP BY camera),
plan AS (SELECT 'cam' || i AS camera, 0.0002::DOUBLE * (i + 1) AS expected_fps FROM range(5) r(i)),
met AS (
  SELECT camera, expected_fps, coalesce(fps, 0.0) AS fps, coalesce(gbps, 0.0) AS gbps, coalesce(frames, 0) AS frames, coalesce(bytes, 0) AS bytes,
         coalesce(gaps, 0) AS gaps, coalesce(dropped_total, 0) AS dropped_total, coalesce(short_frames, 0) AS short_frames
  FROM plan LEFT JOIN totals USING (camera) LEFT JOIN loss USING (camera) LEFT JOIN short USING (camera)
), told AS (
  SELECT *, CASE WHEN frames = 0 THEN 'no frames' WHEN abs(fps - expected_fps) > {TOLERANCE} * expected_fps THEN 'rate'
                 WHEN gaps + dropped_total > {ALLOWED} THEN 'loss' WHEN short_frames > 0 THEN 'short frames' ELSE '' END AS reason
  FROM met
), verdict AS (SELECT *, reason = '' AS pass FROM told)
"""
NUMBERED = ", numbered AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY arrival) AS sequence FROM frames)\n"

ORACLES = {
    "frame_health": FRAMES_SQL + VERDICT + LATENCY + ENDS + """
SELECT * REPLACE (coalesce(first_frame, -1) AS first_frame, coalesce(last_frame, -1) AS last_frame,
                  coalesce(latency_ms, 0.0) AS latency_ms, coalesce(latency_frames, 0) AS latency_frames)
FROM verdict LEFT JOIN ends USING (camera) LEFT JOIN mean_latency USING (camera)""",
    "frame_totals": FRAMES_SQL + TOTALS.format(span=SPAN_SQL, where="") + "SELECT * FROM totals",
    "gap_count": FRAMES_SQL + LOSS + "SELECT camera, gaps FROM loss",
    "counter_delta": FRAMES_SQL + LOSS + "SELECT camera, dropped_total FROM loss",
    "latency_mean": FRAMES_SQL + LATENCY + "SELECT * FROM mean_latency",
    "short_frames": FRAMES_SQL + f"SELECT camera, count(*) FILTER ({SHORT}) AS short_frames, count(*) AS frames FROM frames GROUP BY camera",
    "size_mismatch": FRAMES_SQL + "SELECT camera, count(*) FILTER (frame_size > 0 AND bytes_written >= 0 AND bytes_written <> frame_size) AS size_bad FROM frames GROUP BY camera",
    "first_last_arrival": FRAMES_SQL + ENDS + "SELECT * FROM ends",
    "interval_rates": FRAMES_SQL + """
, each AS (
  SELECT camera, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS frames,
         CAST(sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) AS BIGINT) AS bytes
  FROM frames GROUP BY ALL
) SELECT *, frames / 3600.0::DOUBLE AS fps, bytes * 8 / 3600.0::DOUBLE / 1e9 AS gbps FROM each""",
    "warmup_window": FRAMES_SQL
    + ", firsts AS (SELECT camera, min(timestamp_s) AS first_s FROM frames GROUP BY camera)"
    + TOTALS.format(span="10 * 86400 - 86400", where="JOIN firsts USING (camera) WHERE timestamp_s - first_s > 86400 AND timestamp_s - first_s <= 864000")
    + "SELECT * FROM totals",
    "verdict": FRAMES_SQL + VERDICT + "SELECT * FROM verdict",
    "run_summary": FRAMES_SQL + VERDICT + "SELECT count(*) AS cameras, sum(gbps) AS aggregate_gbps, bool_and(pass) AS all_pass FROM verdict",
    "sample_every_n": FRAMES_SQL + NUMBERED + "SELECT camera, arrival, sequence FROM numbered WHERE sequence % 7 = 0",
    "dump_limit": FRAMES_SQL + NUMBERED + "SELECT camera, arrival, sequence, frame_number FROM numbered WHERE sequence % 10 = 0 AND sequence <= 50",
    "rate_limit": FRAMES_SQL.replace("WITH", "WITH RECURSIVE", 1) + """
, ordered AS (SELECT camera, arrival, timestamp_s AS t, row_number() OVER (PARTITION BY camera ORDER BY timestamp_s, arrival) AS k FROM frames)
, walk AS (
  SELECT camera, k, arrival, t AS last, true AS kept FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.camera, o.k, o.arrival, CASE WHEN o.t - w.last >= 1800 THEN o.t ELSE w.last END, o.t - w.last >= 1800
  FROM walk w JOIN ordered o ON o.camera = w.camera AND o.k = w.k + 1
) SELECT camera, arrival FROM walk WHERE kept""",
    "publish_sequence": FRAMES_SQL + NUMBERED + "SELECT camera, arrival, sequence FROM numbered",
}
