"""Numbering of rows in their order, in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Span of the order column that one task puts in order.
CHUNK = 100_000


def numbered(rows: DataFrame, by: list[str], order: str, name: str, width: int = CHUNK) -> DataFrame:
    """Adds the number, from 1, of each row within its group by a numeric order column.

    Rows are numbered within ranges of the order, and moved by the rows of the ranges before, a window over one row a
    range. So no task sorts a whole group.
    """
    chunked = rows.withColumn("__chunk", F.floor(F.col(order) / width))
    counts = chunked.groupBy(*by, "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, "__chunk").orderBy(order))
    placed = chunked.withColumn("__at", inside).join(starts, [*by, "__chunk"])
    return placed.withColumn(name, (F.col("__at") + F.col("__start")).cast("long")).drop("__chunk", "__at", "__start")


def running(rows: DataFrame, by: list[str], chunk: str, order: list[str], sums: dict[str, str], previous: dict[str, str]) -> DataFrame:
    """Adds sums up to and with each row of its group, and values of the row before it, in an order that the column
    ``chunk`` cuts into ranges; chunk is dropped.

    ``sums`` and ``previous`` map columns to the names of what is added. A range's rows are one task's, and what goes on
    from range to range is a window over one row a range. Groups and ranges aren't null.
    """
    inside = Window.partitionBy(*by, chunk).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct(*order, *[F.col(c).alias(f"__last_{c}") for c in previous])).alias("__end")
    ranges = rows.groupBy(*by, chunk).agg(*[F.sum(c).alias(f"__sum_{c}") for c in sums], last)
    carried = ranges.select(*by, chunk, *[F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__sum_{c}") for c in sums], F.last("__end").over(before).alias("__end"))
    met = rows.join(carried, [*by, chunk])
    out = [(F.sum(c).over(upto) + F.col(f"__sum_{c}")).alias(n) for c, n in sums.items()]
    out += [F.coalesce(F.lag(c).over(inside), F.col(f"__end.__last_{c}")).alias(n) for c, n in previous.items()]
    return met.select(*[c for c in rows.columns if c != chunk], *out)


def segmented(frames: DataFrame, most: int, width: int = CHUNK) -> DataFrame:
    """Adds the segment, from 0, of each frame (stream, pts, data) of its stream in order of pts, ``most`` frames to one.

    Only (stream, pts) are numbered. What goes back to the frames is one row for each range of pts, with the segments
    that begin in it, so no payload is moved here. Frames of equal pts share a segment.
    """
    keys = numbered(frames.select("stream", "pts"), ["stream"], "pts", "number", width)
    chunk = F.floor(F.col("pts") / width)
    begin = F.when((F.col("number") - 1) % most == 0, F.struct("pts", ((F.col("number") - 1) / most).cast("long").alias("segment")))
    ranges = keys.groupBy("stream", chunk.alias("__chunk")).agg(F.array_sort(F.collect_list(begin)).alias("__begins"), F.min("number").alias("__first"))
    ranges = ranges.select("stream", "__chunk", "__begins", F.floor((F.col("__first") - 1) / most).cast("long").alias("__before"))
    met = frames.withColumn("__chunk", chunk).join(ranges, ["stream", "__chunk"])
    inside = F.filter("__begins", lambda b: b["pts"] <= F.col("pts"))
    return met.withColumn("segment", F.coalesce(F.try_element_at(inside, F.lit(-1))["segment"], "__before")).drop("__chunk", "__begins", "__before")
