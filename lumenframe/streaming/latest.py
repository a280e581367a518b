"""The latest value of each key of a stream, for readers who wait for newer ones.

Spark keeps the newest row of each key in the stream's state; each batch writes the keys that changed under its own
number. A batch that runs again writes the same rows in the same place, so it changes nothing, and a reader asks for what
is newer than what it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_stream(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A stream, for update mode, of the row of each key with the largest order; of equal ones the largest row stays."""
    rest = [c for c in rows.columns if c not in (key, order)]
    newest = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("row"))
    return newest.select(key, "row.*")


def upserted(batch: DataFrame, number: int, path: str) -> None:
    """Writes a batch's changed keys; to be called by foreachBatch."""
    batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number:09d}")


def publish(stream: DataFrame, path: str) -> None:
    """Runs a stream of latest rows over what its source has now."""
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query.foreachBatch(lambda batch, number: upserted(batch, number, path)).start().awaitTermination()


def current(spark: SparkSession, path: str, key: str, order: str, newer_than: int | None = None) -> DataFrame:
    """The latest row of each key; only those whose order is above ``newer_than``, if told."""
    changes = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/changes")
    if newer_than is not None:
        changes = changes.where(F.col(order) > newer_than)
    return latest_stream(changes, key, order)
