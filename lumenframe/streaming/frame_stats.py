"""Running frame statistics and interval rates as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import telemetry

STATE = "frames long, bytes long, gaps long, dropped long, first long, last long, counter long"


def folded(state: tuple, frames: pd.DataFrame) -> tuple:
    """The state after more frames of a camera, one by one in order of arrival: what running_stats() is tested against. -1 stands for unknown numbers."""
    n, size, gaps, dropped, first, last, counter = state
    for number, written, expected, now in frames.sort_values("arrival")[["frame_number", "bytes_written", "frame_size", "dropped"]].itertuples(index=False):
        n, size = n + 1, size + (written if written > 0 else expected)
        if number >= 0:
            gaps += max(0, number - last - 1) if last >= 0 else 0
            first, last = (number if first < 0 else first), number
        if now >= 0:
            dropped += max(0, now - counter) if counter >= 0 else 0
            counter = now
    return tuple(int(x) for x in (n, size, gaps, dropped, first, last, counter))


def batch_stats(frames: DataFrame) -> DataFrame:
    """What a batch adds to each camera's state, with the first counter; ranges of arrival are put in order one by one."""
    number, counter = (F.when(F.col(c) >= 0, F.col(c)) for c in ("frame_number", "dropped"))
    known, counted = F.when(number.isNotNull(), F.col("arrival")), F.when(counter.isNotNull(), F.col("arrival"))
    ends = [F.min_by(number, known).alias("first"), F.max_by(number, known).alias("last"), F.min_by(counter, counted).alias("counter_first"), F.max_by(counter, counted).alias("counter")]
    sums = frames.groupBy("camera").agg(F.count("*").alias("frames"), F.sum(telemetry.frame_bytes()).alias("bytes"), *ends)
    return sums.join(telemetry.gaps(frames), "camera").join(telemetry.counter_growth(frames), "camera")


def advanced(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The states (STATE and whether the batch had frames, by camera) after a batch; null stands for unknown numbers."""
    if state is None:
        return batch.select("camera", "frames", "bytes", "gaps", F.col("dropped_total").alias("dropped"), "first", "last", "counter", F.lit(True).alias("changed"))
    old, new = state.alias("o"), batch.alias("n")
    met = old.join(new, "camera", "full")
    total = lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    jump = F.greatest(F.lit(0), F.coalesce(F.col("n.first") - F.col("o.last") - 1, F.lit(0)))
    growth = F.greatest(F.lit(0), F.coalesce(F.col("n.counter_first") - F.col("o.counter"), F.lit(0)))
    return met.select(
        "camera",
        total(F.col("o.frames"), F.col("n.frames")).alias("frames"),
        total(F.col("o.bytes"), F.col("n.bytes")).alias("bytes"),
        (total(F.col("o.gaps"), F.col("n.gaps")) + jump).alias("gaps"),
        (total(F.col("o.dropped"), F.col("n.dropped_total")) + growth).alias("dropped"),
        F.coalesce("o.first", "n.first").alias("first"),
        F.coalesce("n.last", "o.last").alias("last"),
        F.coalesce("n.counter", "o.counter").alias("counter"),
        F.col("n.frames").isNotNull().alias("changed"),
    )


def running_stats(frames: DataFrame, path: str, tap: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream of frames over what its source has now; each camera's totals after every batch that had frames of it.

    Without a watermark: frames count in the order in which they came, as the batch operators have it. A batch is
    aggregated by DataFrame functions, so none of a camera's frames are gathered; between batches seven numbers a camera
    go on, in a folder for each batch, from which a batch that is run again starts anew. The frames pass on unchanged to
    ``tap``, if there is one, and what it makes of each batch is written to the folder ``tapped``.
    """
    schema = "camera string, " + STATE + ", changed boolean"

    def write(batch: DataFrame, number: int) -> None:
        if tap:
            tap(batch).write.mode("overwrite").parquet(f"{path}/tapped/batch={number:09d}")
        state = batch.sparkSession.read.schema(schema).parquet(f"{path}/states/batch={number - 1:09d}") if number else None
        advanced(state, batch_stats(batch)).coalesce(1).write.mode("overwrite").parquet(f"{path}/states/batch={number:09d}")

    query = frames.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    held = frames.sparkSession.read.schema(schema).parquet(f"{path}/states/*").where("changed")
    ends = [F.coalesce(c, F.lit(-1)).cast("long").alias(f"{c}_frame") for c in ("first", "last")]
    return held.select("camera", "frames", "bytes", "gaps", F.col("dropped").alias("dropped_total"), *ends)


def interval_stream(frames: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """A stream of each camera's frames and bytes by interval, with a watermark for late frames."""
    size = F.when(F.col("bytes_written") > 0, F.col("bytes_written")).otherwise(F.col("frame_size"))
    held = frames.withWatermark("ts", late).groupBy("camera", F.window("ts", f"{seconds} seconds").alias("w"))
    return held.agg(F.count("*").alias("frames"), F.sum(size).alias("bytes")).select("camera", F.col("w.start").alias("start"), "frames", "bytes")


def run_to_end(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over what its source has now and returns all rows that it gave, with their batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows/*")
