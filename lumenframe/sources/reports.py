"""Files of a run: the log of its frames, a CSV for each camera, and its summary as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import telemetry

# The columns of the log in their order, and what is written for what isn't known.
LOG = "host_time_s frame_number received_frame_number psn bytes_written frame_size crc timestamp_s timestamp_ns received_s received_ns metadata_s metadata_ns dropped frame_packets_received latency_ms".split()
UNKNOWN = {c: -1 for c in ("frame_number", "received_frame_number", "psn", "dropped", "frame_packets_received")}


def log_lines(frames: DataFrame) -> DataFrame:
    """camera, arrival and the columns of the log as text; host time counts from the camera's first frame."""
    begin = frames.groupBy("camera").agg(F.min(telemetry.time_ns()).alias("__begin"))
    there = frames.columns
    known = {c: F.coalesce(F.col(c) if c in there else F.lit(None).cast("long"), F.lit(UNKNOWN.get(c, 0))) for c in LOG if c not in ("host_time_s", "crc", "latency_ms")}
    text: dict[str, Column] = {c: v.cast("string") for c, v in known.items()}
    text["host_time_s"] = F.format_string("%.6f", (telemetry.time_ns() - F.col("__begin")) / float(telemetry.SECOND))
    text["crc"] = F.format_string("0x%08x", F.coalesce(F.col("crc") if "crc" in there else F.lit(None).cast("long"), F.lit(0)).cast("long"))
    text["latency_ms"] = F.format_string("%.3f", F.coalesce(telemetry.latency_ms(), F.lit(0.0)))
    return frames.join(begin, "camera").select("camera", "arrival", *[text[c].alias(c) for c in LOG])


def write_log(frames: DataFrame, folder: str) -> None:
    """Writes each camera's log as CSV files with a header, in order of arrival; what was there before goes.

    Ranges of cameras and arrivals make the files, so a camera's frames never meet in one task; the files of a camera
    are in its folder ``camera=NAME``, and their names are in order.
    """
    lines = log_lines(frames).repartitionByRange("camera", "arrival").sortWithinPartitions("camera", "arrival")
    lines.drop("arrival").write.mode("overwrite").partitionBy("camera").option("header", True).csv(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"host_time_s": "double", "crc": "string", "latency_ms": "double"}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in LOG)
    return spark.read.schema(f"{schema}, camera string").option("header", True).option("enforceSchema", False).csv(folder)


def write_summary(verdicts: DataFrame, folder: str, **run: str) -> None:
    """Writes one JSON object: settings of the run, the payload of all cameras, whether all pass, and the cameras by name.

    There are few cameras, a row each.
    """
    each = F.array_sort(F.collect_list(F.struct("camera", *[c for c in verdicts.columns if c != "camera"])))
    told = verdicts.agg(*[F.lit(v).alias(k) for k, v in run.items()], F.coalesce(F.sum("gbps"), F.lit(0.0)).alias("aggregate_gbps"), F.coalesce(F.bool_and("pass"), F.lit(True)).alias("pass"), each.alias("cameras"))
    told.coalesce(1).write.mode("overwrite").json(folder)


def read_summary(spark: SparkSession, folder: str, verdicts: DataFrame) -> DataFrame:
    """A row for each camera of the summaries of a folder, with the columns that verdicts have."""
    inner = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in verdicts.schema)
    rows = spark.read.schema(f"receiver string, aggregate_gbps double, pass boolean, cameras array<struct<{inner}>>").json(folder)
    return rows.select("receiver", "aggregate_gbps", F.col("pass").alias("all_pass"), F.explode("cameras").alias("c")).select("receiver", "aggregate_gbps", "all_pass", "c.*")
