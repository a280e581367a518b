"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the largest score -weight / ln(u), where u in (0, 1) comes from an MD5 of the record's
key and the shard's number. Adding a shard moves only the records that the new shard wins; removing one moves only its
own. Rows with equal keys share a shard. A null key hashes as an empty one. The law is ``key``: doc_id and the shards
decide, so equal texts under different ids may part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbering task should get.
ROWS_IN_CELL = 100_000
#: Hex digits of the MD5 that make u: 52 bits, which a double holds exactly.
DIGITS = 13


def score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a key. Of equal scores the larger shard wins. Shards of no weight get nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard of positive weight is needed")
    ranked = [F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*ranked) if len(ranked) > 1 else ranked[0])["shard"]


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``slot`` numbers a shard's rows from 0 without gaps. Rows are numbered within small cells of a shard and moved by the
    rows in the cells before, so no task sees a whole shard; rows of equal doc_id are numbered in any order among
    themselves (by size, then checksum). ``grown_shard`` is the shard with one more shard of weight ``grown``.
    An empty table gives an empty result; a null text has size 1 and the checksum 0.
    """
    key, text = F.col("doc_id"), F.col("text").cast("string")
    rows = docs.select(
        key.cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown]).alias("grown_shard"),
    )
    cells = max(1, docs.select("doc_id").count() // ROWS_IN_CELL)
    placed = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "cell", before.alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")) - 1
    slot = (F.col("start") + F.col("number")).cast("long").alias("slot")
    numbered = placed.withColumn("number", number).join(starts, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", slot, "grown_shard")
