"""Queries on byte payloads and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources import blobs
from lumenframe.sources.tables import FRAMES_SQL, PLANE_SQL, frames, plane, table
from lumenframe.storage import shared_dir
from lumenframe.streaming import frame_stats


def jamcrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", blobs.jamcrc(F.col("p_name").cast("binary")).alias("crc"), F.format_string("0x%08x", blobs.jamcrc(F.col("p_name").cast("binary"))).alias("text"))


def flat_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.flat_flags(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("flat")), "flat")


def unpack(bits: int):
    """Lines of the plane, packed and unpacked again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = plane(spark, sf_dir).withColumn("v", F.col("v") % (1 << bits))
        lines = cells.groupBy("plane", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"].cast("int")).alias("px"))
        back = blobs.unpack_lines(blobs.pack_lines(lines, "px", bits), "px", bits)
        return back.select("plane", "y", F.posexplode("px").alias("x", "v")).select("plane", "y", F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))

    return run


def ivf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") % 4).alias("stream"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pts"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return blobs.from_ivf(blobs.to_ivf(rows)).select("stream", (F.col("segment") * blobs.SEGMENT + F.col("frame")).alias("frame"), "pts", "size", F.sha2("data", 256).alias("sha"))


def pgm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = plane(spark, sf_dir).groupBy("plane", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"]).alias("px"))
    return blobs.from_pgm(blobs.to_pgm(lines, 4095)).select("plane", "y", F.posexplode("px").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


def json_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that a text of several has, and the second one."""
    text = F.concat(F.col("props"), F.lit("\n "), F.lit('{"a":{"b":'), F.col("event_id").cast("string"), F.lit("}}x"), F.col("props"))
    found = table(spark, sf_dir, "events").select("event_id", blobs.json_objects(text).alias("o"))
    return found.select("event_id", F.size("o").cast("long").alias("objects"), F.element_at("o", 2).alias("second"))


def jpeg_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a stream of marked payloads, the last one cut short."""
    one = F.concat(F.unhex(F.lit("FFD8")), F.encode("p_name", "UTF-8"), F.unhex(F.lit("FFD9")))
    content = F.concat(F.encode(F.lit("junk"), "UTF-8"), one, F.unhex(F.lit("00")), one, F.unhex(F.lit("FFD800")))
    return blobs.split_jpegs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stream"), content.alias("content"))).select("stream", "part", "size")


def stream_frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame_stats.running_stats(frames(spark, sf_dir, stream=True), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    last = rows.groupBy("camera").agg(F.max_by(F.struct(*rows.columns), "frames").alias("r"))
    return last.select("camera", "r.frames", "r.bytes", "r.gaps", "r.dropped_total", "r.first_frame", "r.last_frame")


def stream_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir, stream=True).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = frame_stats.run_to_end(frame_stats.interval_stream(f, 3600), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", "update")
    last = rows.groupBy("camera", "start").agg(F.max_by(F.struct("frames", "bytes"), "batch").alias("r"))
    return last.select("camera", F.col("start").cast("timestamp_ntz").alias("start"), "r.frames", "r.bytes")


QUERIES = {
    "jamcrc": jamcrc,
    "flat_frames": flat_frames,
    "raw10_unpack": unpack(10),
    "raw12_unpack": unpack(12),
    "ivf_roundtrip": ivf_roundtrip,
    "pgm_roundtrip": pgm_roundtrip,
    "json_split": json_split,
    "jpeg_split": jpeg_split,
    "stream_frame_stats": stream_frame_stats,
    "stream_interval": stream_interval,
}

ORACLES = {
    "jamcrc": """
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8), d AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part),
s AS (
  SELECT p_partkey, list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT) AS crc FROM d, tab
) SELECT p_partkey, crc, printf('0x%08x', crc) AS text FROM s""",
    "flat_frames": """
WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), w AS (SELECT doc_id, h, length(h) // 8 AS n, greatest(length(h) // 8 // 4096, 1) AS stride FROM d)
SELECT doc_id, length(h) >= 128 AND len(list_distinct(list_transform(range(0, greatest(n, 1), stride), lambda i: substr(h, 8 * i + 1, 8)))) <= 4 AS flat FROM w""",
    "raw10_unpack": PLANE_SQL + "SELECT plane, y, x, v % 1024 AS v FROM plane",
    "raw12_unpack": PLANE_SQL + "SELECT plane, y, x, v % 4096 AS v FROM plane",
    "ivf_roundtrip": """
WITH r AS (SELECT conv_id % 4 AS stream, conv_id * 1000 + turn AS pts, coalesce(text, '') AS text FROM conversations)
SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY pts) - 1 AS frame, pts, octet_length(encode(text)) AS size, sha256(text) AS sha FROM r""",
    "pgm_roundtrip": PLANE_SQL + "SELECT * FROM plane",
    "json_split": """SELECT event_id, 3 AS objects, '{"a":{"b":' || event_id || '}}' AS second FROM events""",
    "jpeg_split": "SELECT p_partkey AS stream, i AS part, octet_length(encode(p_name)) + 4 AS size FROM part, range(2) r(i)",
    "stream_frame_stats": FRAMES_SQL + """
, known AS (
  SELECT *, last_value(CASE WHEN frame_number >= 0 THEN frame_number END IGNORE NULLS) OVER w AS last_number, lag(dropped) OVER (PARTITION BY camera ORDER BY arrival) AS last_dropped
  FROM frames WINDOW w AS (PARTITION BY camera ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT camera, count(*) AS frames, CAST(sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) AS BIGINT) AS bytes,
       CAST(sum(CASE WHEN frame_number >= 0 AND frame_number > last_number + 1 THEN frame_number - last_number - 1 ELSE 0 END) AS BIGINT) AS gaps,
       CAST(sum(CASE WHEN dropped > last_dropped THEN dropped - last_dropped ELSE 0 END) AS BIGINT) AS dropped_total,
       arg_min(frame_number, arrival) FILTER (frame_number >= 0) AS first_frame, arg_max(frame_number, arrival) FILTER (frame_number >= 0) AS last_frame
FROM known GROUP BY camera""",
    "stream_interval": FRAMES_SQL + """
SELECT camera, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS frames, CAST(sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) AS BIGINT) AS bytes
FROM frames GROUP BY ALL""",
}
