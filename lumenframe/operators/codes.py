"""Prefix codes of bit plane counts as text of bits, their decoding, and the two-step search of a precinct's quantiser.

A count's residual is n ones and a zero. Up to theta = max(bound - cut, 0) residuals of both signs take turns, beyond it
they are positive alone. A line's codes stand one behind the other and are filled up to a byte by zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.wavelet import predicted_in_slices, truncation


def ones(residual: Column, theta: Column) -> Column:
    """How many ones a residual's code has; below -theta is an error."""
    n = F.when(residual > theta, residual + theta).when(residual < 0, -2 * residual - 1).otherwise(2 * residual)
    return F.when(residual >= -theta, n).otherwise(F.raise_error(F.lit("residual below -theta")).cast("long"))


def coded_bits(items: Column) -> Column:
    """The bits of an array of (residual, theta), filled up to bytes."""
    codes = F.array_join(F.transform(items, lambda i: F.concat(F.repeat(F.lit("1"), ones(i["residual"], i["theta"]).cast("int")), F.lit("0"))), "")
    return F.rpad(codes, (F.ceil(F.length(codes) / 8) * 8).cast("int"), "0")


def bits_to_bytes(bits: Column) -> Column:
    """Whole bytes of bits (a column of its own, as each digit looks at it) as binary, the first bit highest."""
    digit = lambda i: F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16)
    some = F.length(bits) > 0
    return F.when(some, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(bits) / 4).cast("int") - 1), digit), ""))).otherwise(F.unhex(F.lit("")))


def bytes_to_bits(content: Column) -> Column:
    digits = F.filter(F.split(F.hex(content), ""), lambda d: d != "")
    return F.array_join(F.transform(digits, lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def runs_of(bits: Column) -> Column:
    """The lengths of the runs of ones before each zero of bits, and of what comes after the last zero."""
    return F.transform(F.split(bits, "0"), lambda x: F.length(x))


def decoded(runs: Column, thetas: Column, raw_bits: int = 4) -> Column:
    """The residuals that bits hold, told by runs_of(), one for each theta.

    Give runs as a column of its own, or each use works them out anew. Codes end at zeros, so where one begins follows from those before it. Too few codes, 2 ** (raw_bits + 1) ones in
    turn, and anything but less than a byte of zeros behind the last code are errors.
    """
    n, k = F.size(runs) - 1, F.size(thetas)
    first, rest = F.slice(runs, 1, k), F.slice(runs, k + 1, F.greatest(F.size(runs) - k, F.lit(0)))
    bad = (
        F.when(n < k, F.lit("codes are cut short"))
        .when(F.exists(first, lambda x: x >= 1 << (raw_bits + 1)), F.lit("a code is too long"))
        .when(F.exists(rest, lambda x: x > 0) | (n - k >= 8), F.lit("bits behind the last code"))
    )

    def residual(x: Column, i: Column) -> Column:
        theta = F.get(thetas, i)
        both = F.when(x % 2 == 1, -F.floor((x + 1) / 2)).otherwise(F.floor(x / 2))
        return F.when(x > 2 * theta, x - theta).otherwise(both).cast("long")

    return F.when(bad.isNull(), F.transform(first, residual)).otherwise(F.raise_error(bad).cast("array<long>"))


def quantiser(planes: DataFrame, by: list[str], weights: DataFrame, budget: int, most_q: int = 31, most_r: int | None = None) -> DataFrame:
    """(by, q, r, bytes, filler): the smallest q whose bytes at r = 0 fit the budget, then the largest r that still fits.

    ``planes`` has bit plane counts of bands of precincts (by, band, planes), ``weights`` a gain and a priority for each
    band (few rows; broadcast). A band's cut is what truncation() makes of q and r; a group takes four bits for each plane
    above it. One histogram has the bits of each band at every cut; all q are weighed from it, then all r at the q found.
    Bytes don't grow with q nor fall with r. filler is what is left of the budget. A precinct that doesn't fit at the
    largest q has nulls.
    """
    hist = planes.groupBy(*by, "band", "planes").agg(F.count("*").alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("cut")
    bits = hist.select(*by, "band", "planes", "n", at).groupBy(*by, "band", "cut").agg(F.sum(4 * F.col("n") * F.greatest(F.col("planes") - F.col("cut"), F.lit(0))).alias("bits"))
    tables = bits.groupBy(*by, "band").agg(F.map_from_entries(F.collect_list(F.struct("cut", "bits"))).alias("bits"))  # sixteen entries
    tables = tables.join(F.broadcast(weights.select("band", "gain", "priority")), "band")
    size = lambda q, r: F.element_at("bits", truncation(q, r, F.col("gain"), F.col("priority")).cast("int"))
    top = 2 * weights.select("band").distinct().count() - 1 if most_r is None else most_r

    qs = tables.select(*by, "band", F.explode(F.sequence(F.lit(0), F.lit(most_q))).alias("q"), "bits", "gain", "priority")
    fits = qs.groupBy(*by, "q").agg(F.ceil(F.sum(size(F.col("q"), F.lit(0))) / 8).alias("bytes")).where(F.col("bytes") <= budget)
    found = fits.groupBy(*by).agg(F.min("q").alias("q"))
    rs = tables.join(found, by).select(*by, "q", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("r"), "bits", "gain", "priority")
    each = rs.groupBy(*by, "q", "r").agg(F.ceil(F.sum(size(F.col("q"), F.col("r"))) / 8).cast("long").alias("bytes")).where(F.col("bytes") <= budget)
    best = each.groupBy(*by).agg(F.max_by(F.struct("q", "r", "bytes"), "r").alias("best"))
    every = planes.select(*by).distinct().join(best, by, "left")
    return every.select(*by, *[F.col(f"best.{c}").cast("long").alias(c) for c in ("q", "r", "bytes")], (budget - F.col("best.bytes")).alias("filler"))


def count_bits(planes: DataFrame, by: list[str], line: str, cut: str, slice_lines: int) -> DataFrame:
    """Adds ``flat`` and ``up``: bits of each group's count without prediction, and predicted from the line above."""
    told = predicted_in_slices(planes, by, line, cut, slice_lines)
    held, none = F.greatest("planes", F.col(cut)), F.lit(0).cast("long")
    base = held - F.col("residual")
    return told.select(*planes.columns, (ones(held - F.col(cut), none) + 1).alias("flat"), (ones(F.col("residual"), base - F.col(cut)) + 1).alias("up"))


def count_modes(groups: DataFrame, precinct: list[str], first: Column, raw_bits: int = 4, each_packet: bool = True) -> DataFrame:
    """(precinct, packet, raw, coded_bytes, raw_bytes, bytes, predicted) of the counts of precincts' packets.

    ``groups`` has, for each group, precinct, packet, set, band, flat and up (count_bits()). A set is the packets that
    share bands; bands that share one share all. Each band of a precinct is predicted from above if that takes fewer bits,
    but not where ``first`` says that the precinct is the first of its slice. Counts are raw, of ``raw_bits`` each,
    where they would take more bytes coded: packet by packet, or with ``each_packet`` off in all packets of a set that
    takes more in sum, as then a band's packets must agree. ``predicted`` is how many bands of the packet are.
    """
    bands = groups.groupBy(*precinct, "set", "band", "packet").agg(F.sum("flat").alias("flat"), F.sum("up").alias("up"), F.count("*").alias("n"), F.max(first).alias("first"))
    totals = bands.groupBy(*precinct, "band").agg(((F.sum("up") < F.sum("flat")) & ~F.max("first")).alias("above"))
    met = bands.join(totals, [*precinct, "band"])
    bits = F.when(F.col("above"), F.col("up")).otherwise(F.col("flat"))
    size = lambda x: F.ceil(F.sum(x) / 8).cast("long")
    packets = met.groupBy(*precinct, "set", "packet").agg(size(bits).alias("coded_bytes"), size(F.col("n") * raw_bits).alias("raw_bytes"), F.count_if("above").alias("predicted"))
    if each_packet:
        packets = packets.withColumn("raw", F.col("coded_bytes") > F.col("raw_bytes"))
    else:
        sums = packets.groupBy(*precinct, "set").agg((F.sum("coded_bytes") > F.sum("raw_bytes")).alias("raw"))
        packets = packets.join(sums, [*precinct, "set"])
    out = packets.withColumn("bytes", F.when(F.col("raw"), F.col("raw_bytes")).otherwise(F.col("coded_bytes")))
    return out.select(*precinct, "packet", "raw", "coded_bytes", "raw_bytes", "bytes", F.when(F.col("raw"), 0).otherwise(F.col("predicted")).cast("long").alias("predicted"))
