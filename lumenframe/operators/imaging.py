"""Image operators over planes of samples in cell form.

A plane is rows (plane, y, x, v). Stencils are windows over a line or a column of one plane, so planes and their lines
spread over tasks; nothing gathers a plane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def red(x: str = "x", y: str = "y") -> Column:
    return (F.col(x) % 2 == 0) & (F.col(y) % 2 == 0)


def blue(x: str = "x", y: str = "y") -> Column:
    return (F.col(x) % 2 == 1) & (F.col(y) % 2 == 1)


def green(x: str = "x", y: str = "y") -> Column:
    return F.col(x) % 2 != F.col(y) % 2


def test_frame(spark, width: int, height: int, bits: int, phase: int) -> DataFrame:
    """(y, x, v): red grows to the right and blue downwards, green is a third, and a bright bar of 32 columns moves."""
    top, bar = (1 << bits) - 1, phase * 16 % width
    cells = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    base = F.when(red(), F.floor(F.col("x") * top / width)).when(blue(), F.floor(F.col("y") * top / height)).otherwise(top // 3)
    v = F.when(F.col("x").between(bar, bar + 31), top).otherwise(base)
    return cells.select("y", "x", v.cast("long").alias("v"))


def preview_frame(spark, width: int, height: int, frame: int) -> DataFrame:
    """(y, x, r, g, b): eight colour bars over a grey ramp, and a white box with a black border that moves."""
    # The bars' colours from the left.
    bars = [(255, 255, 255), (255, 255, 0), (0, 255, 255), (0, 255, 0), (255, 0, 255), (255, 0, 0), (0, 0, 255), (32, 32, 32)]
    box = height // 8
    left, top = frame * 7 % (width - box), height // 2 - box // 2
    cells = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    x, y = F.col("x"), F.col("y")
    inside = x.between(left, left + box - 1) & y.between(top, top + box - 1)
    border = inside & ~(x.between(left + 4, left + box - 5) & y.between(top + 4, top + box - 5))
    ramp, bar = F.floor(x * 255 / max(width - 1, 1)), F.floor(x * 8 / width).cast("int")
    out = []
    for i, name in enumerate("rgb"):
        colour = F.element_at(F.array(*[F.lit(c[i]) for c in bars]), bar + 1)
        out.append(F.when(border, 0).when(inside, 255).when(y < height * 2 // 3, colour).otherwise(ramp).cast("long").alias(name))
    return cells.select("y", "x", *out)


def bayer_stats(plane: DataFrame, bits: int) -> DataFrame:
    """Means by colour (green: of both sites' means), extremes, percentiles 1 and 99 and the saturated share of a plane."""
    site = lambda c: F.avg(F.when(c, F.col("v")))
    right, below = (F.col("x") % 2 == 1) & (F.col("y") % 2 == 0), (F.col("x") % 2 == 0) & (F.col("y") % 2 == 1)
    return plane.groupBy("plane").agg(
        site(red()).alias("mean_r"),
        ((site(right) + site(below)) / 2).alias("mean_g"),
        site(blue()).alias("mean_b"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.floor(F.expr("percentile(v, 0.01)")).cast("long").alias("p01"),
        F.floor(F.expr("percentile(v, 0.99)")).cast("long").alias("p99"),
        F.avg((F.col("v") >= (1 << bits) - 2).cast("double")).alias("saturated"),
    )


def superpixels(plane: DataFrame) -> DataFrame:
    """(plane, y, x, r, g, b) at half size: a colour from each site of a square, green the mean of two."""
    cell = [F.floor(F.col(c) / 2).alias(c) for c in ("y", "x")]
    marked = plane.select("plane", *cell, F.when(red(), F.col("v")).alias("r"), F.when(green(), F.col("v")).alias("g"), F.when(blue(), F.col("v")).alias("b"))
    return marked.groupBy("plane", "y", "x").agg(F.max("r").cast("double").alias("r"), F.avg("g").alias("g"), F.max("b").cast("double").alias("b"))


def demosaiced(plane: DataFrame) -> DataFrame:
    """(plane, y, x, r, g, b) at full size by means of the nearest sites; planes are mirrored at their edges."""
    line, column = Window.partitionBy("plane", "y").orderBy("x"), Window.partitionBy("plane", "x").orderBy("y")

    def sides(c: str, w) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce(before, after, F.col(c)) + F.coalesce(after, before, F.col(c))

    wide = plane.withColumn("h", sides("v", line))
    full = wide.withColumn("u", sides("v", column)).withColumn("d", sides("h", column))
    v, h, u, d = F.col("v").cast("double"), F.col("h") / 2, F.col("u") / 2, F.col("d") / 4
    even = F.col("y") % 2 == 0
    r = F.when(red(), v).when(blue(), d).when(even, h).otherwise(u)
    b = F.when(blue(), v).when(red(), d).when(even, u).otherwise(h)
    g = F.when(green(), v).otherwise((F.col("h") + F.col("u")) / 4)
    return full.select("plane", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


def to_srgb(rgb: DataFrame, bits: int, black: float) -> DataFrame:
    """(plane, y, x, r, g, b) in 0..255: black level, grey-world balance, gain from percentile 99.5, sRGB curve.

    The balance takes pixels neither clipped nor black; all of them if these are 1000 at most.
    """
    scale = max(float((1 << bits) - 1) - black, 1.0)
    lit = rgb.select("plane", "y", "x", *[(F.greatest(F.col(c) - black, F.lit(0.0)) / scale).alias(c) for c in "rgb"])
    good = (F.greatest("r", "g", "b") < 0.9) & (F.least("r", "g", "b") > 0.005)
    agg = [F.avg(F.when(good, F.col(c))).alias(f"good_{c}") for c in "rgb"] + [F.avg(c).alias(f"all_{c}") for c in "rgb"]
    means = lit.groupBy("plane").agg(F.count_if(good).alias("n"), *agg)
    mean = {c: F.greatest(F.when(F.col("n") > 1000, F.col(f"good_{c}")).otherwise(F.col(f"all_{c}")), F.lit(1e-6)) for c in "rgb"}
    gains = means.select("plane", *[(mean["g"] / mean[c]).alias(f"w_{c}") for c in "rgb"])
    balanced = lit.join(gains, "plane").select("plane", "y", "x", *[(F.col(c) * F.col(f"w_{c}")).alias(c) for c in "rgb"])
    seen = balanced.select("plane", F.explode(F.array("r", "g", "b")).alias("v")).groupBy("plane", "v").agg(F.count("*").alias("n"))
    levels = seen.groupBy("plane").agg(F.expr("percentile(v, 0.995, n)").alias("p"))  # few levels differ, however large the plane
    gain = F.lit(0.9) / F.greatest("p", F.lit(1e-6))
    out = balanced.join(levels, "plane")

    def curve(c: str) -> Column:
        z = F.least(F.greatest(F.col(c) * gain, F.lit(0.0)), F.lit(1.0))
        bent = F.when(z <= 0.0031308, z * 12.92).otherwise(F.pow(z, F.lit(1 / 2.4)) * 1.055 - 0.055)
        return F.floor(bent * 255 + 0.5).cast("long").alias(c)

    return out.select("plane", "y", "x", *[curve(c) for c in "rgb"])


def centre_crop(plane: DataFrame, width: int, height: int, crop_w: int, crop_h: int) -> DataFrame:
    """A middle part that begins at even places."""
    left, top = (width - crop_w) // 2 // 2 * 2, (height - crop_h) // 2 // 2 * 2
    inside = F.col("x").between(left, left + crop_w - 1) & F.col("y").between(top, top + crop_h - 1)
    return plane.where(inside).withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)


def compared(a: DataFrame, b: DataFrame, bits: int) -> DataFrame:
    """PSNR (infinite if equal), root mean square and largest error of two images, and how many cells only one has."""
    met = a.withColumnRenamed("v", "p").join(b.withColumnRenamed("v", "q"), ["plane", "y", "x"], "full")
    e = F.col("p") - F.col("q")
    out = met.groupBy("plane").agg(F.avg(e * e).alias("mse"), F.max(F.abs(e)).alias("max_error"), F.count_if(e.isNull()).alias("unmatched"))
    psnr = F.when(F.col("mse") > 0, 10 * F.log10(F.lit(float(((1 << bits) - 1) ** 2)) / F.col("mse"))).otherwise(F.lit(float("inf")))
    return out.select("plane", psnr.alias("psnr"), F.sqrt("mse").alias("rms"), "max_error", "unmatched")


def compared_sites(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root mean square and largest error at each site of a Bayer mosaic, and whether the images are the same there.

    Cells that only one image has are an error that nothing equals.
    """
    met = a.withColumnRenamed("v", "p").join(b.withColumnRenamed("v", "q"), ["plane", "y", "x"], "full")
    e = F.col("p") - F.col("q")
    site = F.when(red(), "R").when(blue(), "B").when(F.col("y") % 2 == 0, "G1").otherwise("G2")
    out = met.groupBy("plane", site.alias("site")).agg(F.avg(e * e).alias("mse"), F.max(F.abs(e)).alias("max_error"), F.count_if(e.isNull()).alias("unmatched"))
    return out.select("plane", "site", F.sqrt("mse").alias("rms"), "max_error", ((F.coalesce("max_error", F.lit(0)) == 0) & (F.col("unmatched") == 0)).alias("identical"))


def split_mosaic(plane: DataFrame, flipped: bool = False) -> DataFrame:
    """(plane, component, y, x, v): the four sites of a mosaic as components of half size.

    In patterns of the second type (``flipped``, GRBG and GBRG), the sites of a line change places.
    """
    component = (F.col("x") + int(flipped)) % 2 + 2 * (F.col("y") % 2)
    return plane.select("plane", component.alias("component"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")


def join_mosaic(parts: DataFrame) -> DataFrame:
    c = F.col("component")
    return parts.select("plane", (F.col("y") * 2 + F.floor(c / 2)).alias("y"), (F.col("x") * 2 + c % 2).alias("x"), "v")
