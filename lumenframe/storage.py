"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one in local mode where that is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='lumenframe-')}"
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class _Written(threading.local):
    """Tables that a thread's queries wrote, the newest last: queries of other threads neither see nor delete them."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    It cuts the lineage: a lost executor costs the tasks that were running, not what went before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    _written.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def reserved(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for streams and data sources; discard() deletes it too."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.paths.append(path)
    return path


def mark() -> int:
    """A place in the list of tables that this thread wrote, for discard()."""
    return len(_written.paths)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that this thread wrote since a mark but for the last ``keep`` ones: when nothing that is yet to run reads them."""
    end = max(since, len(_written.paths) - keep)
    for path in _written.paths[since:end]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    del _written.paths[since:end]
