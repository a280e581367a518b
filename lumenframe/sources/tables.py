"""The given tables, and the stand-ins for frames and sample planes that the queries read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources.blobs import jamcrc

#: Bytes that a frame of the stand-in should have.
EXPECTED_BYTES = 25_000
#: Samples of an embedding are scaled and moved to twelve bits.
SCALE, MIDDLE, TOP = 400, 2048, 4095
LINES = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """One row for each frame of four cameras, from events.

    arrival is the event's id. Some frame numbers are unknown (-1) or jump back. The dropped counter is the event's k,
    which falls as well as rises. The capture time is the event's, in whole seconds; reception is up to 13 s later.
    With ``stream``, the frames come as a stream.
    """
    e = table(spark, sf_dir, "events")
    if stream:
        one = [f.rstrip("/").rpartition("/")[2] for f in e.inputFiles()] == ["events.parquet"]
        source = spark.readStream.schema(e.schema)  # a stream's path is a folder
        e = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one else source.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    number = F.when(F.col("event_id") % 97 == 0, F.lit(-1)).when(F.col("event_id") % 53 == 0, F.col("event_id") - 10).otherwise(F.col("event_id"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select(
        F.concat(F.lit("cam"), (F.col("user_id") % 4).cast("string")).alias("camera"),
        F.col("event_id").alias("arrival"),
        number.cast("long").alias("frame_number"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes_written"),
        F.lit(EXPECTED_BYTES).cast("long").alias("frame_size"),
        k.alias("dropped"),
        "event_type",
        "ts",
        seconds.cast("long").alias("timestamp_s"),
        F.lit(0).cast("long").alias("timestamp_ns"),
        (seconds + k % 14 - 1).cast("long").alias("received_s"),
        (k * 1_000_003 % 1_000_000_000).cast("long").alias("received_ns"),
    )


def payload_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with data and crc, from documents: of four cameras, the first has some short frames, the second some wrong checksums.

    Every seventh frame has no checksum.
    """
    k, data = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select("doc_id", data.alias("data")).withColumn("own", jamcrc(F.col("data")))
    crc = F.when(k % 7 == 0, 0).when(k % 44 == 1, F.col("own").bitwiseXOR(F.lit(1))).otherwise(F.col("own"))
    size = F.octet_length("data").cast("long")
    return rows.select(
        F.concat(F.lit("cam"), (k % 4).cast("string")).alias("camera"),
        k.cast("long").alias("arrival"),
        k.cast("long").alias("frame_number"),
        F.lit(0).cast("long").alias("dropped"),
        size.alias("bytes_written"),
        (size + (k % 52 == 0).cast("long")).alias("frame_size"),
        k.cast("long").alias("timestamp_s"),
        "data",
        crc.alias("crc"),
    )


PAYLOAD_SQL = """
WITH RECURSIVE bits_ AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits_ WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits_ WHERE k = 8), hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
frames AS (
  SELECT 'cam' || (doc_id % 4) AS camera, doc_id AS arrival, doc_id AS frame_number, 0 AS dropped, length(h) // 2 AS bytes_written,
         length(h) // 2 + CASE WHEN doc_id % 52 = 0 THEN 1 ELSE 0 END AS frame_size, doc_id AS timestamp_s, h
  FROM hexed
)
"""
FRAMES_SQL = """
WITH frames AS (
  SELECT 'cam' || (user_id % 4) AS camera, event_id AS arrival,
         CASE WHEN event_id % 97 = 0 THEN -1 WHEN event_id % 53 = 0 THEN event_id - 10 ELSE event_id END AS frame_number,
         CAST(floor(value * 100) AS BIGINT) AS bytes_written, 25000::BIGINT AS frame_size,
         CAST(props->>'$.k' AS BIGINT) AS dropped, event_type, ts,
         CAST(floor(epoch(ts)) AS BIGINT) AS timestamp_s, 0::BIGINT AS timestamp_ns,
         CAST(floor(epoch(ts)) AS BIGINT) + CAST(props->>'$.k' AS BIGINT) % 14 - 1 AS received_s,
         CAST(props->>'$.k' AS BIGINT) * 1000003 % 1000000000 AS received_ns
  FROM events
)
"""


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plane, y, x, v): embeddings as planes of 12-bit samples, a line for each vector, LINES to a plane."""
    e = table(spark, sf_dir, "embeddings")
    cells = e.select(F.col("vec_id").cast("long").alias("y"), F.posexplode("embedding").alias("x", "f"))
    v = F.least(F.greatest(F.floor(F.col("f").cast("double") * SCALE).cast("long") + MIDDLE, F.lit(0)), F.lit(TOP))
    return cells.select(F.floor(F.col("y") / LINES).alias("plane"), (F.col("y") % LINES).alias("y"), F.col("x").cast("long").alias("x"), v.cast("long").alias("v"))


PLANE_SQL = """
WITH plane AS (
  SELECT vec_id::BIGINT // 250 AS plane, vec_id::BIGINT % 250 AS y, (i - 1)::BIGINT AS x,
         least(greatest(CAST(floor(embedding[i]::DOUBLE * 400) AS BIGINT) + 2048, 0), 4095) AS v
  FROM embeddings, range(1, 65) r(i)
)
"""
