"""Integer wavelet and colour transforms, and sizes of coded coefficients, over planes in cell form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.storage import stored

#: CRG offsets of four components in halves, as (x of all, y of all), with the pattern type.
CFA_PATTERNS = [("RGGB", [0, 1, 0, 1], [0, 0, 1, 1], 0), ("BGGR", [1, 1, 0, 0], [1, 0, 1, 0], 0), ("GRBG", [1, 0, 1, 0], [0, 0, 1, 1], 1), ("GBRG", [0, 0, 1, 1], [1, 0, 1, 0], 1)]


def half(v: Column, bits: int) -> Column:
    """Division by a power of two, down."""
    return F.shiftright(v, bits)


def beside(column: str, along: Window, weight: int = 1) -> Column:
    """The sum of both neighbours, mirrored at the ends; 0 if there is none."""
    before, after = F.lag(column).over(along), F.lead(column).over(along)
    return F.coalesce(before, after, F.lit(0)) + F.coalesce(after, before, F.lit(0))


def lifted(plane: DataFrame, along: str, across: list[str], inverse: bool = False) -> DataFrame:
    """One level of the 5/3 transform along an axis, in place: even cells get the low band, odd ones the high band."""
    order = Window.partitionBy(*across).orderBy(along)
    odd = F.col(along) % 2 == 1
    lone = F.lag("v").over(order).isNull() & F.lead("v").over(order).isNull()
    plane = plane.withColumn("__lone", lone)
    high = F.when(odd, F.col("v") + half(beside("v", order), 1) * (1 if inverse else -1)).otherwise(F.col("v"))
    low = F.when(odd | F.col("__lone"), F.col("v")).otherwise(F.col("v") + half(beside("v", order) + 2, 2) * (-1 if inverse else 1))
    for step in (low, high) if inverse else (high, low):
        plane = plane.withColumn("v", step.cast("long"))
    return plane.drop("__lone")


def banded(plane: DataFrame) -> DataFrame:
    """(plane, band, y, x, v) of a plane lifted along both axes: bands LL, HL, LH and HH of half size."""
    band = F.concat(F.when(F.col("x") % 2 == 0, "L").otherwise("H"), F.when(F.col("y") % 2 == 0, "L").otherwise("H"))
    return plane.select("plane", band.alias("band"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")


def forward_2d(plane: DataFrame) -> DataFrame:
    return lifted(lifted(plane, "y", ["plane", "x"]), "x", ["plane", "y"])


def inverse_2d(plane: DataFrame) -> DataFrame:
    return lifted(lifted(plane, "x", ["plane", "y"], inverse=True), "y", ["plane", "x"], inverse=True)


def cascade(plane: DataFrame, nlx: int, nly: int) -> DataFrame:
    """(plane, band, y, x, v) of several levels: nly of both axes, then of columns only up to nlx. Bands are LL, HL1, LH1, ...

    Each level works on the low band of the one before, which is stored in between, so none is computed twice.
    """
    low, out = plane.select("plane", "y", "x", "v"), []
    for k in range(1, nlx + 1):
        both = k <= nly
        now = stored(forward_2d(low) if both else lifted(low, "x", ["plane", "y"]), "level")
        band = F.concat(F.when(F.col("x") % 2 == 0, "L").otherwise("H"), F.when(F.col("y") % 2 == 0, "L").otherwise("H")) if both else F.when(F.col("x") % 2 == 0, "LL").otherwise("HL")
        y = F.floor(F.col("y") / 2) if both else F.col("y")
        parts = now.select("plane", band.alias("band"), y.alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")
        out.append(parts.where("band <> 'LL'").withColumn("band", F.concat("band", F.lit(str(k)))))
        low = parts.where("band = 'LL'").drop("band")
    out.append(low.select("plane", F.lit("LL").alias("band"), "y", "x", "v"))
    return reduce(DataFrame.unionByName, out)


def cascade_back(bands: DataFrame, nlx: int, nly: int) -> DataFrame:
    """The plane whose cascade has these bands."""
    low = bands.where("band = 'LL'").drop("band")
    for k in range(nlx, 0, -1):
        both = k <= nly
        own = bands.where(F.col("band").isin(*[f"{b}{k}" for b in (("HL", "LH", "HH") if both else ("HL",))]))
        parts = low.withColumn("band", F.lit("LL")).unionByName(own)
        x = 2 * F.col("x") + F.col("band").startswith("H").cast("int")
        y = 2 * F.col("y") + (F.substring("band", 2, 1) == "H").cast("int") if both else F.col("y")
        whole = parts.select("plane", y.alias("y"), x.alias("x"), "v")
        low = stored(inverse_2d(whole) if both else lifted(whole, "x", ["plane", "y"], inverse=True), "level")
    return low


def rounded_shift(v: Column, bits: int) -> Column:
    """Division by a power of two to the nearest, halves away from zero."""
    r = (1 << bits) >> 1
    return F.when(v >= 0, half(v + r, bits)).otherwise(-half(-v + r, bits))


def rct(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return half(r + 2 * g + b, 2), b - g, r - g


def inverse_rct(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    g = y - half(cb + cr, 2)
    return g + cr, g, g + cb


def star_step(plane: DataFrame, target: Column, taps: list[tuple[int, int, int]], shift: int, sign: int, inline: bool = False) -> DataFrame:
    """Adds a weighted sum of neighbours, shifted down, to the target cells of a mosaic; planes are mirrored.

    Taps are (dx, dy, bits); neighbours come by windows along lines and columns. With ``inline``, pairs of lines are
    mirrored too, so no cell takes from another pair.
    """
    line, column = Window.partitionBy("plane", "y").orderBy("x"), Window.partitionBy("plane", "x").orderBy("y")

    def at(c: str, step: int, w) -> Column:
        if not step:
            return F.col(c)
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        if inline and w is column:
            return F.coalesce(F.when(F.col("y") % 2 == 0, after).otherwise(before), F.lit(0))
        return F.coalesce(before, after, F.lit(0)) if step < 0 else F.coalesce(after, before, F.lit(0))

    for dx in {dx for dx, _, _ in taps}:
        plane = plane.withColumn(f"__x{dx + 1}", at("v", dx, line))
    total = sum((F.shiftleft(at(f"__x{dx + 1}", dy, column), bits) for dx, dy, bits in taps), F.lit(0))
    plane = plane.withColumn("__sum", total)
    v = F.when(target, F.col("v") + sign * half(F.col("__sum"), shift)).otherwise(F.col("v"))
    return plane.withColumn("v", v.cast("long")).select("plane", "y", "x", "v")


DIAGONAL, CROSS = [(a, b, 0) for a in (-1, 1) for b in (-1, 1)], [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0)]


def star_tetrix(plane: DataFrame, e1: int, e2: int, inverse: bool = False, flipped: bool = False, inline: bool = False) -> DataFrame:
    """The four-component colour transform of a mosaic, in place on its sites, or its inverse.

    The pattern is RGGB or BGGR; if ``flipped``, GRBG or GBRG. ``inline`` keeps to pairs of lines.

    Forward: blue and red lose a quarter of their four greens; both greens gain an eighth of the differences beside
    them; the first loses a quarter of its four diagonal greens, the second gains an eighth of its own.
    """
    x, y = (F.col("x") + int(flipped)) % 2, F.col("y") % 2
    first, second = (x == 1) & (y == 0), (x == 0) & (y == 1)
    sides = lambda a, b: [(-1, 0, a), (1, 0, a), (0, -1, b), (0, 1, b)]
    steps = [
        (x == y, CROSS, 2, -1),
        (second, sides(e2, e1), 3, 1),
        (first, sides(e1, e2), 3, 1),
        (first, DIAGONAL, 2, -1),
        (second, DIAGONAL, 3, 1),
    ]
    for target, taps, shift, sign in reversed(steps) if inverse else steps:
        plane = star_step(plane, target, taps, shift, -sign if inverse else sign, inline)
    return plane


def truncation(q: Column, r: Column, gain: Column, priority: Column, raw_bits: int = 4) -> Column:
    """Bit planes of a band that are cut off for a quantisation and a refinement."""
    return F.least(F.greatest(q - gain - (priority < r).cast("int"), F.lit(0)), F.lit((1 << raw_bits) - 1))


def bit_planes(cells: DataFrame, by: list[str], along: str = "x", group: int = 4) -> DataFrame:
    """(by, g, planes): bits of the largest magnitude in each run of four cells."""
    most = cells.groupBy(*by, F.floor(F.col(along) / group).alias("g")).agg(F.max(F.abs("v")).alias("m"))
    return most.select(*by, "g", F.when(F.col("m") == 0, 0).otherwise(F.length(F.bin("m"))).cast("long").alias("planes"))


def quantised(magnitude: Column, planes: Column, cut: Column, uniform: bool) -> Column:
    """The index of a magnitude: its upper bits, or the nearest of uniform steps."""
    if not uniform:
        return F.call_function("shiftright", magnitude, cut.cast("int")).cast("long")
    zeta = (planes - cut + 1).cast("int")
    up = F.call_function("shiftleft", magnitude, F.greatest(zeta, F.lit(0))) - magnitude + F.call_function("shiftleft", F.lit(1).cast("long"), planes.cast("int"))
    return F.when(planes <= cut, 0).otherwise(F.call_function("shiftright", up, (planes + 1).cast("int"))).cast("long")


def dequantised(index: Column, planes: Column, cut: Column, uniform: bool) -> Column:
    """The magnitude that an index stands for: the middle of its range, or a Neumann series for uniform steps."""
    c = cut.cast("int")
    if not uniform:
        found = F.call_function("shiftleft", index, c) + F.shiftright(F.call_function("shiftleft", F.lit(1).cast("long"), c), 1)
    else:
        zeta = (planes - cut + 1).cast("int")
        terms = F.sequence(F.lit(0), F.lit(31))
        start = F.call_function("shiftleft", index, c)
        found = F.aggregate(terms, F.lit(0).cast("long"), lambda acc, k: acc + F.call_function("shiftright", start, F.least(k.cast("int") * F.greatest(zeta, F.lit(1)), F.lit(62))))
    return F.when((planes <= cut) | (index == 0), 0).otherwise(found).cast("long")


def code_length(residual: Column, bound: Column, cut: Column) -> Column:
    """Bits of a count's code: signed and unary up to theta, unary beyond; smaller than -theta is an error."""
    theta = F.greatest(bound - cut, F.lit(0))
    n = F.when(residual > theta, residual + theta).when(residual < 0, -2 * residual - 1).otherwise(2 * residual)
    return F.when(residual >= -theta, n + 1).otherwise(F.raise_error(F.lit("residual below -theta")).cast("long"))


def predicted_planes(planes: DataFrame, by: list[str], line: str, cut: int) -> DataFrame:
    """Adds ``residual``: bit planes less those of the line above, neither counted below the cut; the first line from it."""
    above = F.lag("planes").over(Window.partitionBy(*by).orderBy(line))
    floor = F.lit(cut)
    return planes.withColumn("residual", F.greatest("planes", floor) - F.greatest(F.coalesce(above, floor), floor))


def predicted_in_slices(planes: DataFrame, by: list[str], line: str, cut: str, slice_lines: int) -> DataFrame:
    """Adds ``residual`` of bit planes whose lines have cuts of their own.

    A line is predicted from the one above, not below either line's cut; a slice's first line from its own cut alone.
    """
    order = Window.partitionBy(*by, F.floor(F.col(line) / slice_lines)).orderBy(line)
    above, cut_above = F.lag("planes").over(order), F.lag(cut).over(order)
    base = F.when(above.isNull(), F.col(cut)).otherwise(F.greatest(above, F.col(cut), cut_above))
    return planes.withColumn("residual", F.greatest("planes", cut) - base)


def linear_out(v: Column, width: int, depth: int) -> Column:
    """Coefficients of ``width`` bits to samples of ``depth``."""
    zeta = width - depth
    return F.least(F.greatest(half(v + (1 << width >> 1) + (1 << zeta >> 1), zeta), F.lit(0)), F.lit((1 << depth) - 1))


def linear_in(v: Column, width: int, depth: int) -> Column:
    return F.shiftleft(v, width - depth) - (1 << width >> 1)


def quadratic_out(v: Column, width: int, depth: int, offset: int) -> Column:
    zeta = 2 * width - depth
    c = F.least(F.greatest(v + (1 << width >> 1), F.lit(0)), F.lit((1 << width) - 1))
    return F.least(F.greatest(half(c * c + (1 << zeta >> 1), zeta) + offset, F.lit(0)), F.lit((1 << depth) - 1))


def floor_root(n: Column) -> Column:
    """The integer square root, exact after a correction of the floating one."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return F.when(root * root > n, root - 1).when((root + 1) * (root + 1) <= n, root + 1).otherwise(root)


def extended_out(v: Column, width: int, depth: int, t1: int, t2: int, e: int) -> Column:
    """Coefficients to samples by the three-part curve: square below t1, straight up to t2, square above."""
    slope, step, zeta = width - e, 1 << (width - e - 1), 2 * width - depth
    top, low = F.lit((1 << width) - 1), F.lit(0)
    held = lambda x: F.least(F.greatest(x, low), top)
    c = v + (1 << width >> 1)
    dark, bright = held(t1 + step - c), held(c - (t2 - step))
    base = t1 * t1
    curve = (
        F.when(c < t1, base + (t1 << slope) + step * step - dark * dark)
        .when(c < t2, F.shiftleft(c, slope) + base)
        .otherwise(base + (t2 << slope) - step * step + bright * bright)
    )
    return F.least(F.greatest(half(curve + (1 << zeta >> 1), zeta), low), F.lit((1 << depth) - 1))


def extended_in(v: Column, width: int, depth: int, t1: int, t2: int, e: int) -> Column:
    """The inverse of the three-part curve, roots rounded down."""
    slope, step, base = width - e, 1 << (width - e - 1), t1 * t1
    n = F.shiftleft(v.cast("long"), 2 * width - depth)
    dark = t1 + step - floor_root(F.greatest(base + (t1 << slope) + step * step - n, F.lit(0)))
    bright = t2 - step + floor_root(F.greatest(n - (base + (t2 << slope) - step * step), F.lit(0)))
    return F.when(n < base + (t1 << slope), dark).when(n < base + (t2 << slope), half(n - base, slope)).otherwise(bright) - (1 << width >> 1)


def quadratic_in(v: Column, width: int, depth: int, offset: int) -> Column:
    """The inverse, by an integer root."""
    n = F.shiftleft(F.least(F.greatest(v - offset, F.lit(0)), F.lit((1 << depth) - 1)).cast("long"), 2 * width - depth)
    return floor_root(n) - (1 << width >> 1)


def coded_bits(planes: DataFrame, by: list[str], cut: int) -> DataFrame:
    """Bits that a group's magnitudes take at a cut: four for each plane above it."""
    return planes.groupBy(*by).agg(F.sum(4 * F.greatest(F.col("planes") - cut, F.lit(0))).alias("bits"))


def smallest_fitting(planes: DataFrame, by: list[str], budget_bits: int, most: int = 15) -> DataFrame:
    """The smallest cut whose bits fit a budget, for each group.

    A histogram of bit planes has the bits of every cut, so all cuts are weighed from one aggregation.
    """
    hist = planes.groupBy(*by, "planes").agg(F.count("*").alias("n"))
    cuts = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("cut")
    each = hist.select(*by, "planes", "n", cuts).groupBy(*by, "cut").agg(F.sum(4 * F.col("n") * F.greatest(F.col("planes") - F.col("cut"), F.lit(0))).alias("bits"))
    fits = each.where(F.col("bits") <= budget_bits)
    return fits.groupBy(*by).agg(F.min("cut").alias("cut"), F.min_by("bits", "cut").alias("bits"))


def band_layout(spark, nlx: int, nly: int, components: int, apart: int) -> DataFrame:
    """(band, component, filter, dy): the order of a codestream's bands; ``apart`` components aren't decomposed."""
    filters, parts = 2 * min(nlx, nly) + max(nlx, nly) + 1, components - apart
    flat = nlx - nly + 1
    b = spark.range(filters * parts + apart).select(F.col("id").alias("band"))
    whole = F.col("band") >= filters * parts
    kind = F.when(whole, -1).otherwise(F.floor(F.col("band") / parts))
    component = F.when(whole, parts + F.col("band") - filters * parts).otherwise(F.col("band") % parts)
    dy = F.when(whole, 0).when(kind >= flat, nly - F.floor((kind - flat) / 3)).otherwise(nly)
    return b.select("band", component.cast("long").alias("component"), kind.cast("long").alias("filter"), dy.cast("long").alias("dy"))
