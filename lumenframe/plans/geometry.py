"""Queries on wavelet cascades, colour transforms, precincts and packets. Suppliers stand in for pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import geometry as g
from lumenframe.operators import imaging
from lumenframe.operators import wavelet as w
from lumenframe.plans.imaging import GROUPS, lift_sql, planes_of_bits
from lumenframe.sources.tables import PLANE_SQL, plane, table

#: Groups of columns in a precinct, and levels.
COLUMNS, NLX, NLY = 1, 5, 2


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.cast("long").alias("picture"), (k % 700 + 64).cast("long").alias("width"), (k % 37 + 9).cast("long").alias("height"))


def precinct_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.band_precincts(pictures(spark, sf_dir), COLUMNS, NLX, NLY).drop("span", "dx", "dy", "hx", "lines")


def packet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.packets(pictures(spark, sf_dir), COLUMNS, NLX, NLY, components=4, apart=1)


def precinct_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first and last cell of each precinct's lines are in their band."""
    p = pictures(spark, sf_dir)
    rows = g.band_precincts(p, COLUMNS, NLX, NLY).where("end_line > first_line AND band_width > 0")
    cells = rows.select("picture", "precinct", "filter", F.explode(F.sequence("first_line", F.col("end_line") - 1)).alias("line"), "band_width")
    cells = cells.select("picture", "precinct", "filter", "line", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("band_width") - 1))).alias("x"))
    return g.to_band_cells(cells, p, COLUMNS, NLX, NLY)


def cascade_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.cascade_back(w.cascade(plane(spark, sf_dir), 3, 2), 3, 2)


def slice_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with cuts of 1 to 3 in slices of 16."""
    cuts = planes_of_bits(spark, sf_dir).withColumn("cut", F.col("y") % 3 + 1)
    return w.predicted_in_slices(cuts, ["plane", "g"], "y", "cut", 16)


QUERIES = {
    "precinct_geometry": precinct_geometry,
    "packet_layout": packet_layout,
    "precinct_remap": precinct_remap,
    "dwt53_cascade": lambda s, d: w.cascade(plane(s, d), 3, 2),
    "dwt53_cascade_back": cascade_back,
    "star_tetrix_forward": lambda s, d: w.star_tetrix(plane(s, d), 1, 0),
    "star_tetrix_flipped": lambda s, d: w.star_tetrix(plane(s, d), 0, 2, flipped=True, inline=True),
    "split_mosaic_flipped": lambda s, d: imaging.split_mosaic(plane(s, d), flipped=True),
    "slice_predictor": slice_predictor,
}

#: Filters of five and two levels: number, depths, and whether they are high in x and in y.
BANDS_SQL = """
WITH f(filter, dx, dy, hx, hy) AS (
  VALUES (0, 5, 2, 0, 0), (1, 5, 2, 1, 0), (2, 4, 2, 1, 0), (3, 3, 2, 1, 0), (4, 2, 2, 1, 0), (5, 2, 2, 0, 1), (6, 2, 2, 1, 1), (7, 1, 1, 1, 0), (8, 1, 1, 0, 1), (9, 1, 1, 1, 1)
), pics AS (
  SELECT s_suppkey::BIGINT AS picture, s_suppkey::BIGINT % 700 + 64 AS width, s_suppkey::BIGINT % 37 + 9 AS height FROM supplier
), tiles AS (
  SELECT *, (width + 255) // 256 AS across, (height + 3) // 4 AS down FROM pics
), prec AS (
  SELECT picture, width, height, across, p AS precinct, p % across AS "column", p // across AS "row",
         CASE WHEN p % across = across - 1 THEN (width - 1) % 256 + 1 ELSE 256 END AS wide
  FROM tiles, range(500) r(p) WHERE p < across * down
), parts AS (
  SELECT picture, precinct, "column", "row", filter, dx, hx,
         CASE WHEN hx = 1 THEN ((wide + (1 << (dx - 1)) - 1) >> (dx - 1)) // 2 ELSE (wide + (1 << dx) - 1) >> dx END AS band_width,
         CASE WHEN hy = 1 THEN ((height + (1 << (dy - 1)) - 1) >> (dy - 1)) // 2 ELSE (height + (1 << dy) - 1) >> dy END AS band_height,
         1 << (2 - dy) AS lines, hy * (1 << (2 - dy)) AS first_line
  FROM prec, f
), geo AS (
  SELECT *, (band_width + 3) // 4 AS groups, (band_width + 31) // 32 AS flags, first_line + greatest(0, least(band_height - "row" * lines, lines)) AS end_line FROM parts
)
"""
STEP_SQL = """
, {out}_l AS (
  SELECT plane, y, x, v, coalesce(lag(v) OVER w, lead(v) OVER w, 0) AS l, coalesce(lead(v) OVER w, lag(v) OVER w, 0) AS r
  FROM {source} WINDOW w AS (PARTITION BY plane, y ORDER BY x)
), {out}_n AS (
  SELECT plane, y, x, v, l, r, {columns} FROM {out}_l WINDOW w AS (PARTITION BY plane, x ORDER BY y)
), {out} AS (SELECT plane, y, x, CASE WHEN {target} THEN v {sign} (({sum}) >> {shift}) ELSE v END AS v FROM {out}_n)
"""


def star_sql(e1: int, e2: int, odd: int, inline: bool) -> str:
    """The five steps; u and d are the cells above and below, lu, ru, ld and rd those beside them."""
    if inline:
        near = lambda c: f"coalesce(CASE WHEN y % 2 = 0 THEN lead({c}) OVER w ELSE lag({c}) OVER w END, 0)"
        up = down = near
    else:
        up, down = (lambda c: f"coalesce(lag({c}) OVER w, lead({c}) OVER w, 0)"), (lambda c: f"coalesce(lead({c}) OVER w, lag({c}) OVER w, 0)")
    columns = ", ".join(f"{fn(c)} AS {n}" for fn, c, n in ((up, "v", "u"), (down, "v", "d"), (up, "l", "lu"), (down, "l", "ld"), (up, "r", "ru"), (down, "r", "rd")))
    even, first, second = f"(x + {odd}) % 2 = y % 2", f"(x + {odd}) % 2 = 1 AND y % 2 = 0", f"(x + {odd}) % 2 = 0 AND y % 2 = 1"
    cross, diagonal = "l + r + u + d", "lu + ru + ld + rd"
    steps = [
        (even, cross, 2, "-"), (second, f"(l + r) * {1 << e2} + (u + d) * {1 << e1}", 3, "+"), (first, f"(l + r) * {1 << e1} + (u + d) * {1 << e2}", 3, "+"),
        (first, diagonal, 2, "-"), (second, diagonal, 3, "+"),
    ]
    sql, source = "", "plane"
    for i, (target, total, shift, sign) in enumerate(steps):
        sql += STEP_SQL.format(out=f"s{i}", source=source, columns=columns, target=target, sum=total, shift=shift, sign=sign)
        source = f"s{i}"
    return PLANE_SQL + sql + f"SELECT plane, y, x, v FROM {source}"


LEVELS = (
    lift_sql("plane", "y", "plane, x", "c1") + lift_sql("c1", "x", "plane, y", "b1") + ", l1 AS (SELECT plane, y // 2 AS y, x // 2 AS x, v FROM b1 WHERE x % 2 = 0 AND y % 2 = 0)\n"
    + lift_sql("l1", "y", "plane, x", "c2") + lift_sql("c2", "x", "plane, y", "b2") + ", l2 AS (SELECT plane, y // 2 AS y, x // 2 AS x, v FROM b2 WHERE x % 2 = 0 AND y % 2 = 0)\n"
    + lift_sql("l2", "x", "plane, y", "b3")
)
HIGH = "SELECT plane, CASE WHEN x % 2 = 0 THEN 'L' ELSE 'H' END || CASE WHEN y % 2 = 0 THEN 'L{k}' ELSE 'H{k}' END AS band, y // 2 AS y, x // 2 AS x, v FROM b{k} WHERE x % 2 = 1 OR y % 2 = 1"
ORACLES = {
    "precinct_geometry": BANDS_SQL + 'SELECT picture, precinct, "column", "row", filter, band_width, groups, flags, first_line, end_line FROM geo',
    "packet_layout": BANDS_SQL + """
, entries AS (
  SELECT picture, precinct, CASE WHEN filter < 4 THEN 0 ELSE 1 END AS a, CASE WHEN filter < 4 THEN 0 ELSE (filter - 4) // 3 END AS b, CASE WHEN filter < 4 THEN 0 ELSE i END AS c,
         CASE WHEN filter < 4 THEN 0 ELSE filter END AS d, 3 * filter + k AS band, first_line + i AS line
  FROM geo, range(4) r(i), range(3) q(k) WHERE first_line + i < end_line
  UNION ALL
  SELECT picture, precinct, 2, i, 0, 0, 30, i FROM prec, range(4) r(i) WHERE i < height - "row" * 4
)
SELECT picture, precinct, dense_rank() OVER (PARTITION BY picture, precinct ORDER BY a, b, c, d) - 1 AS packet,
       row_number() OVER (PARTITION BY picture, precinct, a, b, c, d ORDER BY band) - 1 AS entry, band, line FROM entries""",
    "precinct_remap": BANDS_SQL + """
, cells AS (
  SELECT DISTINCT picture, precinct, filter, first_line + i AS line, x, "column", "row", dx, hx, lines, first_line
  FROM geo, range(4) r(i), (VALUES (0), (1)) e(last), LATERAL (SELECT last * (band_width - 1) AS x) WHERE first_line + i < end_line AND band_width > 0
)
SELECT picture, precinct, filter, line, x, "row" * lines + line - first_line AS band_y, "column" * (CASE WHEN hx = 1 THEN (256 >> (dx - 1)) // 2 ELSE 256 >> dx END) + x AS band_x FROM cells""",
    "dwt53_cascade": PLANE_SQL + LEVELS + HIGH.format(k=1) + " UNION ALL " + HIGH.format(k=2)
    + " UNION ALL SELECT plane, CASE WHEN x % 2 = 0 THEN 'LL' ELSE 'HL3' END AS band, y, x // 2 AS x, v FROM b3",
    "dwt53_cascade_back": PLANE_SQL + "SELECT * FROM plane",
    "star_tetrix_forward": star_sql(1, 0, 0, inline=False),
    "star_tetrix_flipped": star_sql(0, 2, 1, inline=True),
    "split_mosaic_flipped": PLANE_SQL + "SELECT plane, (x + 1) % 2 + 2 * (y % 2) AS component, y // 2 AS y, x // 2 AS x, v FROM plane",
    "slice_predictor": PLANE_SQL + GROUPS + """
, cuts AS (SELECT *, y % 3 + 1 AS cut FROM bits),
near AS (SELECT *, lag(planes) OVER w AS above, lag(cut) OVER w AS cut_above FROM cuts WINDOW w AS (PARTITION BY plane, g, y // 16 ORDER BY y))
SELECT plane, y, g, planes, cut, greatest(planes, cut) - CASE WHEN above IS NULL THEN cut ELSE greatest(above, cut, cut_above) END AS residual FROM near""",
}
