"""Joins on order, newest rows and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_forward(left: DataFrame, marks: DataFrame, by: str, on: str, at: str, value: str, width: float = 100_000.0) -> DataFrame:
    """Each left row with the value of the first mark at or after it; else of the last mark; else 0.

    Both sides go into one order within ``by`` and ranges of ``width``, so no pairs are compared and no task orders a
    whole group. Rows after a range's last mark take the first mark of the ranges behind it, a window over one row a
    range. ``at`` is the marks' order column, ``on`` the left's.
    """
    a = left.withColumn("__k", F.col(on).cast("double")).withColumn("__side", F.lit(0))
    b = marks.select(by, F.col(at).cast("double").alias("__k"), F.lit(1).alias("__side"), F.col(value).cast("double").alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__range", F.floor(F.col("__k") / width))
    # in falling order, as a frame that ends with its row is summed up once and one that begins with it again for each row
    ahead = Window.partitionBy(by, "__range").orderBy(F.desc("__k"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy(by).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy(by, "__range").agg(F.min_by("__v", F.when(F.col("__side") == 1, F.col("__k"))).alias("__first"))
    carried = firsts.select(by, "__range", F.last("__first", ignorenulls=True).over(behind).alias("__later"))
    last = marks.groupBy(by).agg(F.max_by(F.col(value).cast("double"), at).alias("__last"))
    met = both.withColumn("__next", F.last("__v", ignorenulls=True).over(ahead)).where("__side = 0")
    out = met.join(carried, [by, "__range"], "left").join(last, by, "left")
    return out.select(*left.columns, F.coalesce("__next", "__later", "__last", F.lit(0.0)).alias(value))


def newest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The row of each group that comes last; a map-side aggregation, not a sort."""
    packed = rows.groupBy(by).agg(F.max_by(F.struct(*rows.columns), order).alias("row"))
    return packed.select("row.*")


def overridden(defaults: DataFrame, config: DataFrame, command: DataFrame, key: str) -> DataFrame:
    """Settings by key: the command's over the config's over the default's."""
    met = defaults.withColumnRenamed("value", "d").join(config.withColumnRenamed("value", "c"), key, "full").join(command.withColumnRenamed("value", "x"), key, "full")
    return met.select(key, F.coalesce("x", "c", "d").alias("value"))


def fan_in(streams: list[DataFrame], key: str, order: str, value: str) -> DataFrame:
    """All rows of the streams; of clashing keys the last to come wins."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("rows"))
