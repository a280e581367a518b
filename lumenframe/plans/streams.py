"""Queries on data sources of frames, keyed state, report intervals and limiters below a second."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import telemetry
from lumenframe.plans.blobs import ORACLES as STREAM_SQL
from lumenframe.plans.telemetry import ALLOWED, TOLERANCE, plan
from lumenframe.plans.telemetry import ORACLES as TELEMETRY_SQL
from lumenframe.plans.telemetry import verdict
from lumenframe.sources import blobs, captures, ivf_files, paced, reports
from lumenframe.sources.tables import FRAMES_SQL, frames, table
from lumenframe.storage import reserved
from lumenframe.streaming import frame_stats, keyed_state

#: A second of the events' time is so many nanoseconds of a fast camera's.
FAST = 50_000
#: When the emulated cameras' first frames were due, in microseconds, and their pictures.
START_US, WIDTH, HEIGHT, BITS = 1_000_000, 64, 16, 12
WARM, END = 86_400, 10 * 86_400


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, keyed_state.PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (stream, pts, data) from conversations: four streams."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") % 4).alias("stream"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pts"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def ivf_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = reserved(spark, "ivf")
    ivf_files.write_ivf(turns(spark, sf_dir), folder, fourcc="HEVC", width="1920", height="1080")
    return folder


def ivf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as IVF files and read back by their folder."""
    rows = ivf_files.read_ivf(spark, ivf_folder(spark, sf_dir))
    stream, segment = (F.split_part("file", F.lit("/"), F.lit(i)).cast("long") for i in (1, 2))
    return rows.select(stream.alias("stream"), (segment * blobs.SEGMENT + F.col("frame")).alias("frame"), "pts", "size", F.sha2("data", 256).alias("sha"))


def ivf_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf_files.read_ivf(spark, ivf_folder(spark, sf_dir), "headers")


def paced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emulated cameras, as many frames each as it has events, streamed to the end; frames with the sum of their samples."""
    counts = frames(spark, sf_dir).groupBy("camera").count().collect()  # four cameras
    cameras = [{"camera": r.camera, "fps": 30.0 + int(r.camera[3:]), "limit": r["count"]} for r in counts]
    stream = paced.paced(spark, cameras, START_US, WIDTH, HEIGHT, BITS)
    sums = blobs.sample_sums(stream, "data", BITS, WIDTH).withColumnRenamed("data", "total")
    return frame_stats.run_to_end(sums, reserved(spark, "paced"), "append").select("camera", "frame", "phase", "due_us", "total")


def keyed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of a stream, with a state for each range of a camera's frames in a state store."""
    with rocks(spark):
        rows = frame_stats.run_to_end(keyed_state.range_states(frames(spark, sf_dir, stream=True), 1_000), reserved(spark, "keyed"), "update")
    return keyed_state.folded(keyed_state.newest_ranges(rows))


def fast_ns() -> Column:
    return F.col("timestamp_s") * FAST + F.col("received_ns") % FAST


def rate_limit_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.rate_limited(frames(spark, sf_dir), 0.1, fast_ns())


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir, stream=True).select("camera", "arrival", fast_ns().alias("time_ns"))
    with rocks(spark):
        rows = frame_stats.run_to_end(keyed_state.limited_stream(f, 100_000_000), reserved(spark, "limited"), "append")
    return rows.select("camera", "arrival")


def report_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.reports(frames(spark, sf_dir), 2.0, fast_ns())


def verdict_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.verdicts(frames(spark, sf_dir), F.broadcast(plan(spark)), TOLERANCE, ALLOWED, window=(WARM, END))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames' log, written as files and read back."""
    folder = reserved(spark, "log")
    reports.write_log(frames(spark, sf_dir).withColumn("crc", F.col("arrival") * 7919 % 4294967296), folder)
    return reports.read_log(spark, folder)


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, told = reserved(spark, "summary"), verdict(spark, sf_dir)
    reports.write_summary(told, folder, receiver="linux")
    return reports.read_summary(spark, folder, told)


def rig_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of rigs that have some of the keys, from suppliers."""
    k = F.col("s_suppkey")
    some = lambda n, text: F.when(k % n == 0, F.format_string(text, k))
    keys = [some(2, '"board_ip": "10.0.0.%d"'), some(3, '"ibv_port": %d'), some(5, '"cuda_device": %d'), some(4, '"leading_lines": %d, "reset_board": false'), some(6, '"ibv_name": "roce%d", "require_board": false')]
    keys += [F.when(k % 7 == 0, F.lit('"p22": {}')).when(k % 7 == 1, F.format_string('"p22": {"enabled": false, "expander_address": %d}', k))]
    camera = F.format_string('"cameras": [{"port": "J1", "test_pattern_select": %d}, {"port": "J2"}]', k % 9)
    json = F.concat(F.lit("{"), F.concat_ws(", ", *keys, camera), F.lit("}"))
    found = captures.rig_cameras(table(spark, sf_dir, "supplier").select(k.alias("config"), json.alias("json")))
    return found.select("config", "camera", "board_ip", "ibv_name", "ibv_port", "cuda_device", "leading_lines", "board_required", "reset_board", "p22_enabled", "p22_expander_address", "test_pattern_select")


QUERIES = {
    "ivf_source": ivf_source,
    "ivf_headers": ivf_headers,
    "paced_frames": paced_frames,
    "keyed_stats": keyed_stats,
    "rate_limit_fast": rate_limit_fast,
    "rate_limit_stream": rate_limit_stream,
    "report_intervals": report_intervals,
    "verdict_window": verdict_window,
    "log_files": log_files,
    "summary_file": summary_file,
    "rig_settings": rig_settings,
}

TURNS_SQL = """
WITH r AS (SELECT conv_id % 4 AS stream, conv_id * 1000 + turn AS pts, coalesce(text, '') AS text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY pts) - 1 AS frame FROM r)
"""
FAST_SQL = FRAMES_SQL.replace("WITH", "WITH RECURSIVE", 1) + f"""
, timed AS (SELECT *, timestamp_s * {FAST} + received_ns % {FAST} AS t FROM frames),
ordered AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY t, arrival) AS k FROM timed)
"""
#: The greedy walk from frame to frame; last is when the last one passed.
PASSED_SQL = """
, walk AS (
  SELECT camera, k, arrival, t, t AS last, true AS kept FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.camera, o.k, o.arrival, o.t, CASE WHEN o.t - w.last >= {least} THEN o.t ELSE w.last END, o.t - w.last >= {least}
  FROM walk w JOIN ordered o ON o.camera = w.camera AND o.k = w.k + 1
)
"""


def _verdict_window_sql() -> str:
    from lumenframe.plans import telemetry as t

    inside = f"JOIN firsts USING (camera) WHERE timestamp_s - first_s > {WARM} AND timestamp_s - first_s <= {END}"
    window = f""", firsts AS (SELECT camera, min(timestamp_s) AS first_s FROM frames GROUP BY camera), inside AS (
  SELECT camera, count(*) / {END - WARM}::DOUBLE AS w_fps, sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) * 8 / {END - WARM}::DOUBLE / 1e9 AS w_gbps
  FROM frames {inside} GROUP BY camera
)
"""
    head, tail = t.VERDICT.split("LEFT JOIN totals USING (camera)")
    rates = "LEFT JOIN (SELECT * REPLACE (coalesce(w_fps, fps) AS fps, coalesce(w_gbps, gbps) AS gbps) FROM totals LEFT JOIN inside USING (camera)) totals USING (camera)"
    return FRAMES_SQL + window + head + rates + tail + "SELECT * FROM verdict"


LIMITED_SQL = FAST_SQL + PASSED_SQL.format(least=100_000_000) + "SELECT camera, arrival FROM walk WHERE kept"

ORACLES = {
    "ivf_source": TURNS_SQL + "SELECT stream, frame, pts, octet_length(encode(text)) AS size, sha256(text) AS sha FROM numbered",
    "ivf_headers": TURNS_SQL + f"""
SELECT printf('%d/%08d', stream, frame // {blobs.SEGMENT}) AS file, 'HEVC' AS fourcc, 1920 AS width, 1080 AS height, 30 AS rate, 1 AS scale,
       count(*) AS frames, 32 + 12 * count(*) + sum(octet_length(encode(text)))::BIGINT AS bytes
FROM numbered GROUP BY stream, frame // {blobs.SEGMENT}""",
    "paced_frames": FRAMES_SQL + f"""
, cameras AS (SELECT camera, count(*) AS n, CAST(floor(1e6 / (30 + substr(camera, 4)::INT)) AS BIGINT) AS period FROM frames GROUP BY camera),
made AS (SELECT camera, i AS frame, i // 8 AS phase, {START_US} + i * period AS due_us FROM cameras, unnest(range(n)) r(i)),
bars AS (SELECT DISTINCT phase * 16 % {WIDTH} AS bar FROM made),
sums AS (
  SELECT bar, sum(CASE WHEN x BETWEEN bar AND bar + 31 THEN 4095 WHEN x % 2 = 0 AND y % 2 = 0 THEN x * 4095 // {WIDTH}
                       WHEN x % 2 = 1 AND y % 2 = 1 THEN y * 4095 // {HEIGHT} ELSE 1365 END)::BIGINT AS total
  FROM bars, range({WIDTH}) a(x), range({HEIGHT}) b(y) GROUP BY bar
)
SELECT camera, frame, phase, due_us, total FROM made JOIN sums ON bar = phase * 16 % {WIDTH}""",
    "keyed_stats": STREAM_SQL["stream_frame_stats"],
    "rate_limit_fast": LIMITED_SQL,
    "rate_limit_stream": LIMITED_SQL,
    "report_intervals": FAST_SQL + PASSED_SQL.format(least=2_000_000_000) + """
, ends AS (SELECT camera, max(k) AS k FROM ordered GROUP BY camera),
marks AS (SELECT camera, k FROM walk WHERE kept AND k > 1 UNION SELECT camera, k FROM ends),
spans AS (SELECT camera, k, lag(k, 1, 0) OVER (PARTITION BY camera ORDER BY k) AS before FROM marks),
sums AS (
  SELECT camera, s.k, max_by(o.t, o.k) AS report_ns, max_by(arrival, o.k) AS arrival, count(*) AS frames,
         CAST(sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) AS BIGINT) AS bytes
  FROM spans s JOIN ordered o USING (camera) WHERE o.k > s.before AND o.k <= s.k GROUP BY camera, s.k
), begun AS (SELECT camera, t AS begin FROM ordered WHERE k = 1),
told AS (
  SELECT *, (report_ns - coalesce(lag(report_ns) OVER w, begin)) / 1e9::DOUBLE AS interval_s, (report_ns - begin) / 1e9::DOUBLE AS whole_s,
         sum(frames) OVER w AS total_frames, sum(bytes) OVER w AS total_bytes
  FROM sums JOIN begun USING (camera) WINDOW w AS (PARTITION BY camera ORDER BY k)
)
SELECT camera, report_ns, arrival, frames, bytes, interval_s, CASE WHEN interval_s > 0 THEN frames / interval_s ELSE 0.0 END AS fps,
       CASE WHEN interval_s > 0 THEN bytes * 8 / interval_s ELSE 0.0 END / 1e9 AS gbps, total_frames::BIGINT AS total_frames, total_bytes::BIGINT AS total_bytes,
       CASE WHEN whole_s > 0 THEN total_frames / whole_s ELSE 0.0 END AS mean_fps
FROM told""",
    "verdict_window": _verdict_window_sql(),
    "log_files": FRAMES_SQL + """
SELECT camera, (timestamp_s - min(timestamp_s) OVER (PARTITION BY camera))::DOUBLE AS host_time_s, frame_number, -1 AS received_frame_number, -1 AS psn, bytes_written, frame_size,
       printf('0x%08x', arrival * 7919 % 4294967296) AS crc, timestamp_s, timestamp_ns, received_s, received_ns, 0 AS metadata_s, 0 AS metadata_ns, dropped, -1 AS frame_packets_received,
       CASE WHEN timestamp_s > 0 AND received_s > 0 AND received_s - timestamp_s > -10 AND received_s - timestamp_s < 10
            THEN printf('%.3f', ((received_s - timestamp_s) * 1000000000 + received_ns - timestamp_ns) / 1e6)::DOUBLE ELSE 0.0::DOUBLE END AS latency_ms
FROM frames""",
    "summary_file": TELEMETRY_SQL["verdict"].rpartition("SELECT * FROM verdict")[0] + "SELECT 'linux' AS receiver, sum(gbps) OVER () AS aggregate_gbps, bool_and(pass) OVER () AS all_pass, * FROM verdict",
    "rig_settings": """
SELECT s_suppkey AS config, c AS camera, CASE WHEN k % 2 = 0 THEN '10.0.0.' || k ELSE '192.168.0.2' END AS board_ip, CASE WHEN k % 6 = 0 THEN 'roce' || k ELSE '' END AS ibv_name,
       CASE WHEN k % 3 = 0 THEN k ELSE 1 END AS ibv_port, CASE WHEN k % 5 = 0 THEN k ELSE 0 END AS cuda_device, CASE WHEN k % 4 = 0 THEN k ELSE 0 END AS leading_lines,
       k % 6 <> 0 AS board_required, k % 4 <> 0 AS reset_board, k % 7 <> 1 AS p22_enabled,
       CASE WHEN k % 7 = 1 THEN k ELSE 32 END AS p22_expander_address, CASE WHEN c = 0 THEN k % 9 ELSE 0 END AS test_pattern_select
FROM (SELECT *, s_suppkey AS k FROM supplier), range(2) r(c)""",
}
