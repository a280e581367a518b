"""Precincts, lines and packets of wavelet-coded pictures as tables, and the way from precinct cells to band cells.

Pictures have picture, width and height. A precinct takes ``columns`` groups of eight columns of the coarsest band (all if
0) and the lines of one cell of the coarsest level. Everything is generated from the few bands of a setting, row by row, so
pictures spread over tasks and nothing is sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients in a code group, and code groups in a significance group.
GROUP, SIGNIFICANCE = 4, 8


def filters(nlx: int, nly: int) -> list[tuple[int, int, bool, bool]]:
    """(depth in x, depth in y, high in x, high in y) of each filter, coarsest first; the deepest levels split columns only."""
    flat = [(nlx, nly, False, False), *[(k, nly, True, False) for k in range(nlx, nly, -1)]]
    return flat + [(k, k, *high) for k in range(nly, 0, -1) for high in ((True, False), (False, True), (True, True))]


def low_size(n: Column, depth: Column) -> Column:
    return F.ceil(n / F.pow(F.lit(2.0), depth)).cast("long")


def high_size(n: Column, depth: Column) -> Column:
    return F.floor(F.ceil(n / F.pow(F.lit(2.0), depth - 1)) / 2).cast("long")


def tiled(pictures: DataFrame, columns: int, nlx: int, nly: int) -> DataFrame:
    """(picture, width, height, span, across, numbers): a precinct's full width, how many are in a row, and all their numbers.

    Pictures are dealt to all tasks first, as a few bytes of them make thousands of rows.
    """
    span = F.lit(8 * columns << nlx).cast("long") if columns else F.col("width").cast("long")
    tasks = int(pictures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pictures.select("picture", "width", "height").repartition(tasks, "picture")
    sized = dealt.withColumn("span", span).withColumn("across", F.ceil(F.col("width") / F.col("span")))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("across") * F.ceil(F.col("height") / float(1 << nly)) - 1)
    return sized.withColumn("numbers", numbers)


def placed(precinct: Column) -> tuple[Column, Column, Column]:
    """column, row and width of a precinct of a tiled() picture."""
    column, row = precinct % F.col("across"), F.floor(precinct / F.col("across"))
    return column, row, F.when(column == F.col("across") - 1, (F.col("width") - 1) % F.col("span") + 1).otherwise(F.col("span"))


def precincts(pictures: DataFrame, columns: int, nlx: int, nly: int) -> DataFrame:
    """(picture, width, height, precinct, column, row, precinct_width), row by row from the top left."""
    each = tiled(pictures, columns, nlx, nly).withColumn("precinct", F.explode("numbers"))
    column, row, wide = placed(F.col("precinct"))
    return each.select("picture", "width", "height", "precinct", column.alias("column"), row.alias("row"), wide.alias("precinct_width"), "span")


def band_precincts(pictures: DataFrame, columns: int, nlx: int, nly: int) -> DataFrame:
    """Each filter's part of each precinct: its width, code and significance groups, and its first line and the one after the last."""
    each = [F.struct(F.lit(i).alias("filter"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(hx).alias("hx"), F.lit(hy).alias("hy")) for i, (dx, dy, hx, hy) in enumerate(filters(nlx, nly))]
    rows = precincts(pictures, columns, nlx, nly).select("*", F.explode(F.array(*each)).alias("f")).select("*", "f.*").drop("f")
    size = lambda n, d, high: F.when(F.col(high), high_size(n, F.col(d))).otherwise(low_size(n, F.col(d)))
    lines = F.pow(F.lit(2.0), nly - F.col("dy")).cast("long")
    rows = rows.withColumn("band_width", size(F.col("precinct_width"), "dx", "hx")).withColumn("lines", lines)
    rows = rows.withColumn("first_line", F.when(F.col("hy"), F.col("lines")).otherwise(0))
    left = size(F.col("height"), "dy", "hy") - F.col("row") * F.col("lines")
    end = F.col("first_line") + F.greatest(F.lit(0), F.least(left, F.col("lines")))
    groups = [F.ceil(F.col("band_width") / n).cast("long").alias(name) for n, name in ((float(GROUP), "groups"), (float(GROUP * SIGNIFICANCE), "flags"))]
    return rows.select("picture", "precinct", "column", "row", "filter", "band_width", *groups, "first_line", end.alias("end_line"), "span", "dx", "dy", "hx", "lines")


def packet_entries(nlx: int, nly: int, components: int, apart: int, row: Column, entry: Callable[[int, int], Column]) -> Column:
    """An array of the packets (line, entries) of a precinct in this row, in order; ``entry`` makes one of a filter and a band.

    First comes a line of the filters that split columns only; then, level by level and line by line, one packet for each
    filter; each with all components. At last come the ``apart`` components that aren't decomposed, line by line. Their
    filter is the one after the last. The few packets that a setting can have are told here; which of them a precinct has
    follows from the lines that are left of its bands, so nothing is sorted.
    """
    every, parts = filters(nlx, nly), components - apart
    flat = nlx - nly + 1

    def packet(filters_: list[int], there: Column, line: int) -> Column:
        entries = [entry(f, parts * f + c) for f in filters_ for c in range(parts)]
        return F.when(there, F.struct(F.lit(line).cast("long").alias("line"), F.array(*entries).alias("entries")))

    told = [packet(list(range(flat)), low_size(F.col("height"), F.lit(nly)) > row, 0)]
    for level in range(nly):
        lines = 1 << level
        for i in range(lines):
            for f in range(flat + 3 * level, flat + 3 * level + 3):
                _, dy, _, high = every[f]
                size = (high_size if high else low_size)(F.col("height"), F.lit(dy))
                told.append(packet([f], size - row * lines > i, lines * high + i))
    for i in range(1 << nly):
        for c in range(apart):
            whole = F.struct(F.lit(i).cast("long").alias("line"), F.array(entry(len(every), parts * len(every) + c)).alias("entries"))
            told.append(F.when(F.col("height") - row * (1 << nly) > i, whole))
    return F.array_compact(F.array(*told))


def packets(pictures: DataFrame, columns: int, nlx: int, nly: int, components: int, apart: int = 0) -> DataFrame:
    """(picture, precinct, packet, entry, band, line): which line of which band each packet holds, in the order of packet_entries()."""
    told = packet_entries(nlx, nly, components, apart, F.col("row"), lambda _, band: F.lit(band).cast("long"))
    each = precincts(pictures, columns, nlx, nly).select("picture", "precinct", F.posexplode(told).alias("packet", "p"))
    return each.select("picture", "precinct", "packet", F.posexplode("p.entries").alias("entry", "band"), F.col("p.line").alias("line"))


def to_band_cells(cells: DataFrame, pictures: DataFrame, columns: int, nlx: int, nly: int) -> DataFrame:
    """Cells (picture, precinct, filter, line, x) with their place band_y, band_x in the whole band.

    A precinct's place follows from its number and its picture's size, so cells meet one row of their picture. Cells of
    precincts or filters that aren't there are left out.
    """
    span = F.lit(8 * columns << nlx).cast("long") if columns else F.col("width").cast("long")
    across = F.ceil(F.col("width") / span)
    there = across * F.ceil(F.col("height") / float(1 << nly))
    sizes = pictures.select("picture", span.alias("__span"), across.alias("__across"), there.alias("__there"))
    known = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(hx).alias("hx"), F.lit(hy).alias("hy")) for dx, dy, hx, hy in filters(nlx, nly)]
    met = cells.join(sizes, "picture").where((F.col("precinct") >= 0) & (F.col("precinct") < F.col("__there")) & (F.col("filter") >= 0) & (F.col("filter") < len(known)))
    f = F.get(F.array(*known), F.col("filter").cast("int"))
    full = F.when(f["hx"], high_size(F.col("__span"), f["dx"])).otherwise(low_size(F.col("__span"), f["dx"]))
    lines = F.pow(F.lit(2.0), nly - f["dy"]).cast("long")
    y = F.floor(F.col("precinct") / F.col("__across")) * lines + F.col("line") - F.when(f["hy"], lines).otherwise(0)
    x = F.col("precinct") % F.col("__across") * full + F.col("x")
    return met.select(*cells.columns, y.alias("band_y"), x.alias("band_x"))
