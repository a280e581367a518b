"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least one row in HOT_SHARE is joined by broadcast; there are HOT_SHARE such keys at most.
HOT_SHARE = 2_000
#: Ids (of 24 bytes) to broadcast at most; more are met by a shuffle.
FEW_IDS = 500_000


def left_join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of rows with a table that has one row for each key; ``weight`` is how many rows have it.

    Hot keys are broadcast, at most HOT_SHARE of them, and their rows spread over all tasks. A null key meets nothing.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    least = max(100, total // HOT_SHARE + 1)
    rest = [c for c in table.columns if c != key]
    hot = table.where(F.col(weight) >= least).select(key, F.struct(*rest).alias("__hot"))
    cold = table.where(F.col(weight) < least).select(F.col(key).alias("__key"), F.struct(*rest).alias("__cold"))
    probe = rows.join(F.broadcast(hot), key, "left")
    spread = F.xxhash64(*[F.col(c) for c in rows.columns if c != key]).cast("string").cast("binary")
    kind = rows.schema[key].dataType.simpleString()
    spread = spread if kind == "binary" else F.xxhash64(*rows.columns)
    plain = F.col("__hot").isNull() & F.col(key).isNotNull()
    probe = probe.withColumn("__plain", plain).withColumn("__at", F.when(plain, F.col(key)).otherwise(spread))
    met = probe.join(cold.withColumn("__real", F.lit(True)), (F.col("__at") == F.col("__key")) & (F.col("__plain") == F.col("__real")), "left")
    found = F.coalesce("__hot", "__cold")
    return met.select(*rows.columns, *[found[c].alias(c) for c in rest])

