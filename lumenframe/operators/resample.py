"""Resizing of planes (plane, y, x, v) by separable filters: columns first, then lines.

A filter's taps are a generated table: which source cells make an output cell, with fixed-point weights that add up to
about one. Cells meet their taps by equal position, so no pairs of cells are compared, and sums are whole numbers: the
result doesn't depend on the order of addition. The table has a few rows for each source column or line, at most
MOST_TAPS, and is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits behind the point of a weight, the reach of the Lanczos window, and the rows that a table of taps may have.
POINT, LOBES, MOST_TAPS = 22, 3, 2_000_000


def sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))


def lanczos_taps(spark: SparkSession, size: int, out: int) -> DataFrame:
    """(to, source, weight): the windowed sinc, widened by the scale when shrinking."""
    scale = size / out
    wide = max(scale, 1.0)
    reach, middle = LOBES * wide, (F.col("to") + 0.5) * scale
    first = F.greatest(F.lit(0), F.floor(middle - reach + 0.5)).cast("long")
    last = F.least(F.lit(size), F.floor(middle + reach + 0.5)).cast("long") - 1
    rows = spark.range(out).select(F.col("id").alias("to")).select("to", F.explode(F.sequence(first, last)).alias("source"))
    x = (F.col("source") - (F.col("to") + 0.5) * scale + 0.5) / wide
    return fixed(rows.select("to", "source", F.when(F.abs(x) < LOBES, sinc(x) * sinc(x / LOBES)).otherwise(0.0).alias("w")))


def linear_taps(spark: SparkSession, size: int, out: int) -> DataFrame:
    """(to, source, weight): the two cells beside the middle of an output cell, whatever the scale; the edge goes on."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), (F.col("to") + 0.5) * (size / out) - 0.5))
    rows = spark.range(out).select(F.col("id").alias("to"), F.floor(at).cast("long").alias("low"), (at - F.floor(at)).alias("part"))
    pair = F.array(F.struct(F.col("low").alias("source"), (1 - F.col("part")).alias("w")), F.struct((F.col("low") + 1).alias("source"), F.col("part").alias("w")))
    return fixed(rows.select("to", F.explode(pair).alias("t")).select("to", "t.*").where((F.col("w") > 0) & (F.col("source") < size)))


def fixed(taps: DataFrame) -> DataFrame:
    sums = taps.groupBy("to").agg(F.sum("w").alias("all"))
    return taps.join(sums, "to").select("to", "source", F.floor(F.col("w") / F.col("all") * (1 << POINT) + 0.5).cast("long").alias("weight"))


TAPS = {"lanczos": lanczos_taps, "linear": linear_taps}


def resized_along(cells: DataFrame, axis: str, size: int, out: int, kernel: str, top: int) -> DataFrame:
    """The planes with ``out`` columns or lines in place of ``size``; sums are rounded and held within 0 to top."""
    if (2 * LOBES + 2) * max(size, out) > MOST_TAPS:
        raise ValueError("planes of more columns or lines have to be cut first")
    other = "y" if axis == "x" else "x"
    taps = TAPS[kernel](cells.sparkSession, size, out)
    met = cells.join(F.broadcast(taps), F.col(axis) == F.col("source"))
    sums = met.groupBy("plane", other, "to").agg(F.sum(F.col("v") * F.col("weight")).alias("s"))
    held = F.greatest(F.lit(0), F.least(F.lit(top), F.shiftright(F.col("s") + (1 << (POINT - 1)), POINT)))
    return sums.select("plane", F.col("y" if axis == "x" else "to").alias("y"), F.col("to" if axis == "x" else "x").alias("x"), held.cast("long").alias("v"))


def resized(cells: DataFrame, size: tuple[int, int], out: tuple[int, int], kernel: str, top: int) -> DataFrame:
    """Planes of size (width, height) as planes of another size; cells that aren't there count as 0."""
    wide = resized_along(cells, "x", size[0], out[0], kernel, top)
    return resized_along(wide, "y", size[1], out[1], kernel, top)


def fitted(width: int, height: int, target: int) -> tuple[int, int]:
    """The size of a picture that is made ``target`` wide, in proportion."""
    return target, max(1, math.floor(height * target / width + 0.5))
