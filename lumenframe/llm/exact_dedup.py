"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only.

Every text gets a 64-bit key. The directory is made from the keys alone: it starts with one slot and doubles while a
bucket is overfull; a bucket that isn't keeps several slots. A bucket is thus a range of keys. Rows go through the
directory to the task that owns their bucket: the leading bits of the key name the slot, the slot the bucket. The owner
compares the bytes of texts whose keys meet, chains different texts with one key, and lays one entry for each text into
the bucket's folder of the shared files. Rows of a key that at least one row in HOT_SHARE has don't go to the owner one by
one: each task collapses its own, compared by bytes too, and sends what is left. In the end every row is answered from
the entry that bucket, key and the SHA-256 of its link name. drop_copies() has the owners answer with the row that stays,
so whole rows move once.

Defined cases: a null text counts as empty; without rows the result is empty; rows that repeat both doc_id and text are
copies of which one is kept; a null doc_id is smaller than any other; doc_id is a whole number, or a text of one; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.storage import stored

#: Keys that a bucket may hold before it splits. More, if there would be more than about MOST_BUCKETS of them, so that one
#: level of STEP bits holds the directory, 65,536 slots at most; deeper levels are for keys that begin alike.
CAPACITY, MOST_BUCKETS = 512, 32_768
#: Bits of the key by which one pass over the entries may double the directory; what is still overfull takes another.
STEP, BITS = 16, 64
#: A key or text with at least HOT_ROWS rows and one row in HOT_SHARE is hot; there are HOT_SHARE of them at most.
HOT_ROWS, HOT_SHARE = 100, 2_000


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def bits_of(key: Column, first: int, bits: int) -> Column:
    """The number that some bits of a key make, the first being bit ``first`` from the left."""
    return F.shiftrightunsigned(F.shiftleft(key, first), BITS - bits) if bits else F.lit(0).cast("long")


def keyed(docs: DataFrame, hasher: Callable[[Column], Column] = text_key) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), hasher(text).alias("key"), text.alias("text"))


@dataclass
class Level:
    """Slots of the directory that tell ``bits`` bits of a key from bit ``first`` on: (parent, slot, child)."""

    slots: DataFrame
    first: int
    bits: int


@dataclass
class Directory:
    """The way from a key to its bucket, and the hot keys."""

    levels: list[Level]
    hot: DataFrame


@dataclass
class Index:
    """bucket, key, link, links, sha, keep_id and group_size of each distinct text, the directory's levels, and doc_id, key and sha of each row."""

    entries: DataFrame
    levels: list[Level]
    rows: DataFrame


def directory(keys: DataFrame, capacity: int = CAPACITY) -> list[Level]:
    """The directory to buckets of ``capacity`` rows at most; only equal keys may be more.

    Doubling is counted, not played through: a bucket is a key prefix that is not overfull below one that is. All
    prefixes of up to STEP bits are counted in one pass. Prefixes still overfull then begin a level of their own.
    """
    levels, first, rest = [], 0, keys.select("key", F.lit("b").alias("parent"))
    while True:
        cells = stored(rest.groupBy("parent", bits_of(F.col("key"), first, STEP).alias("cell")).agg(F.count("*").alias("rows")), "cells")
        at = cells.select("parent", "cell", "rows", F.explode(F.sequence(F.lit(0), F.lit(STEP))).alias("depth"))
        at = at.withColumn("head", F.expr(f"shiftrightunsigned(cell, {STEP} - depth)"))
        sizes = at.groupBy("parent", "depth", "head").agg(F.sum("rows").alias("rows"))
        above = sizes.select("parent", (F.col("depth") + 1).alias("depth"), F.col("head").alias("over"), F.col("rows").alias("rows_above"))
        split = sizes.withColumn("over", F.shiftrightunsigned("head", 1)).join(above, ["parent", "depth", "over"], "left")
        ends = (F.col("rows") <= capacity) | (F.col("depth") == STEP)
        leaves = stored(split.where(ends & (F.col("rows_above").isNull() | (F.col("rows_above") > capacity))).select("parent", "depth", "head", (F.col("rows") > capacity).alias("full")), "leaves")
        bits = leaves.agg(F.max("depth")).first()[0] or 0
        wide = F.expr(f"shiftleft(1L, {bits} - depth)")
        child = F.concat_ws("-", "parent", F.concat_ws(".", "depth", "head")).alias("child")
        slots = leaves.select("parent", F.explode(F.sequence(F.col("head") * wide, (F.col("head") + 1) * wide - 1)).alias("slot"), child)
        levels.append(Level(slots, first, bits))
        full = leaves.where("full").select(child)
        if first + STEP >= BITS or full.isEmpty():
            return levels
        rest = located(rest.select("key"), levels).join(F.broadcast(full), F.col("bucket") == F.col("child"), "left_semi").withColumnRenamed("bucket", "parent")
        first += STEP


def located(rows: DataFrame, levels: list[Level]) -> DataFrame:
    """The rows with the bucket of their key. The slots of a level are a few for each bucket, so they are broadcast."""
    rows = rows.withColumn("bucket", F.lit("b"))
    for level in levels:
        found = rows.withColumn("slot", bits_of(F.col("key"), level.first, level.bits)).withColumnRenamed("bucket", "parent")
        rows = found.join(F.broadcast(level.slots), ["parent", "slot"], "left").withColumn("bucket", F.coalesce("child", "parent")).drop("parent", "slot", "child")
    return rows


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """The directory of the rows' keys. They are counted first, by partial aggregation; texts aren't moved."""
    counts = stored(keys.groupBy("key").agg(F.count("*").alias("rows")), "keys")
    kinds, rows = counts.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    hot = stored(counts.where(F.col("rows") >= least_hot(rows)).select("key"), "hot")
    return Directory(directory(counts, max(capacity, kinds // MOST_BUCKETS + 1)), hot)


def least_hot(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_SHARE + 1)


def answered(rows: DataFrame, place: Directory, *answers: Column) -> DataFrame:
    """bucket, key, text and the answers over all rows of each text, worked out by the tasks that own the buckets.

    A task gets whole buckets and groups their rows by key and bytes. Rows of hot keys are grouped where they are read,
    and one for each task and text is sent on.
    """
    rows, same = located(rows, place.levels), ["bucket", "key", "text"]
    hot = F.broadcast(place.hot)
    cold = rows.join(hot, "key", "left_anti").repartition("bucket").groupBy(*same).agg(*answers)
    return cold if place.hot.isEmpty() else cold.unionByName(rows.join(hot, "key", "left_semi").groupBy(*same).agg(*answers))


def build_index(docs: DataFrame, hasher: Callable[[Column], Column] = text_key, capacity: int = CAPACITY) -> Index:
    """The index of a table's texts, a folder of the shared files for each bucket.

    ``links`` is the length of a key's chain and ``link`` an entry's place in it, from 0. The keep_id of a text is the
    largest doc_id of its rows.
    """
    texts, sha = keyed(docs, hasher), F.unhex(F.sha2("text", 256)).alias("sha")
    rows = stored(texts.select("doc_id", "key", sha), "rows")
    place = build_directory(rows, capacity)
    entries = answered(texts, place, F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = entries.select("bucket", "key", sha, "keep_id", "group_size").repartition("bucket")
    chain = Window.partitionBy("bucket", "key")
    chained = owned.withColumn("links", F.count("*").over(chain)).withColumn("link", F.row_number().over(chain.orderBy("sha")) - 1)
    return Index(stored(chained, "index", ("bucket",)), place.levels, rows)


def probed(index: Index) -> DataFrame:
    """doc_id, keep_id, group_size and sha of every row, which finds its text's entry in the bucket of its key.

    The entries of the most frequent texts are broadcast, so that no task gets all rows of a text.
    """
    least = least_hot(index.entries.agg(F.sum("group_size")).first()[0] or 0)
    entry = F.struct("keep_id", "group_size")
    hot = index.entries.where(F.col("group_size") >= least).select("bucket", "key", "sha", entry.alias("hot"))
    cold = index.entries.where(F.col("group_size") < least).select("bucket", "key", "sha", entry.alias("cold"), F.lit(False).alias("found"))
    probe = located(index.rows, index.levels).join(F.broadcast(hot), ["bucket", "key", "sha"], "left").withColumn("found", F.col("hot").isNotNull())
    probe = probe.withColumn("key", F.when(F.col("found"), F.xxhash64("doc_id", "key")).otherwise(F.col("key")))
    met = probe.join(cold, ["bucket", "key", "sha", "found"], "left").withColumn("entry", F.coalesce("hot", "cold"))
    return met.select("doc_id", "entry.keep_id", "entry.group_size", "sha")


def exact_groups(docs: DataFrame, hasher: Callable[[Column], Column] = text_key, capacity: int = CAPACITY) -> DataFrame:
    """For every row its doc_id, keep_id, group_size, kept and text_sha256."""
    found = probed(build_index(docs, hasher, capacity))
    same = found.groupBy("doc_id", "keep_id", "group_size", "sha").agg(F.count("*").alias("times"))
    each = same.select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, hasher: Callable[[Column], Column] = text_key, capacity: int = CAPACITY) -> DataFrame:
    """The documents of which exact_groups() keeps the row, with all their columns.

    The owners of the buckets answer with the row that has the largest doc_id of its text; of rows that share both, the
    largest by its other columns.
    """
    text, there = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNotNull()
    rest = [c for c in docs.columns if c != "text"]
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest], there.alias("has_text")))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], there.alias("there"))
    rows = docs.select(hasher(text).alias("key"), text.alias("text"), row.alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), others.alias("others")).alias("order"))
    kept = answered(rows, build_directory(rows.select("key"), capacity), F.max_by("row", "order").alias("row"))
    back = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | {"text": F.when(F.col("row.there"), F.col("text")).cast(docs.schema["text"].dataType)}
    return kept.select(*[back[c].alias(c) for c in docs.columns])
