"""Queries on planes of samples; embeddings stand in for raw frames, and an image is compared with a coarser copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import imaging as im
from lumenframe.operators import wavelet as w
from lumenframe.sources.tables import PLANE_SQL, plane, table

BITS = 12


def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plane(spark, sf_dir)
    coarse = p.select("plane", "y", "x", (F.floor(F.col("v") / 16) * 16 + 8).cast("long").alias("v"))
    return im.compared(p, coarse, BITS)


def saxpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.lit(2.5) * F.col("l_quantity") + F.col("l_tax")).alias("y"))


def rct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = w_sites(plane(spark, sf_dir))
    out = sites
    for name, c in zip(("cy", "cb", "cr"), w.rct(F.col("r"), F.col("g"), F.col("b"))):
        out = out.withColumn(name, c.cast("long"))
    back = w.inverse_rct(F.col("cy"), F.col("cb"), F.col("cr"))
    same = (back[0] == F.col("r")) & (back[1] == F.col("g")) & (back[2] == F.col("b"))
    return out.select("plane", "y", "x", "cy", "cb", "cr", same.alias("lossless"))


def w_sites(p: DataFrame) -> DataFrame:
    s = im.split_mosaic(p).groupBy("plane", "y", "x")
    at = lambda k: F.max(F.when(F.col("component") == k, F.col("v")))
    return s.agg(at(0).alias("r"), at(1).alias("g"), at(3).alias("b"))


def lossless(name: str):
    """Cells that a transform and its inverse change; none should."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = plane(spark, sf_dir)
        there = w.forward_2d(p) if name == "dwt" else w.star_tetrix(p, 1, 0)
        back = w.inverse_2d(there) if name == "dwt" else w.star_tetrix(there, 1, 0, inverse=True)
        met = p.join(back.withColumnRenamed("v", "back"), ["plane", "y", "x"], "full")
        return met.groupBy("plane").agg(F.count("*").alias("cells"), F.count_if(~F.col("v").eqNullSafe(F.col("back"))).alias("changed"))

    return run


def planes_of_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.bit_planes(w.lifted(plane(spark, sf_dir), "x", ["plane", "y"]), ["plane", "y"])


def quantise(uniform: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        high = w.lifted(plane(spark, sf_dir), "x", ["plane", "y"]).withColumn("g", F.floor(F.col("x") / 4))
        met = high.join(w.bit_planes(high, ["plane", "y"]), ["plane", "y", "g"])
        cut = F.lit(3).cast("long")
        q = met.withColumn("q", w.quantised(F.abs("v"), F.col("planes"), cut, uniform))
        return q.select("plane", "y", "x", "q", w.dequantised(F.col("q"), F.col("planes"), cut, uniform).alias("back"))

    return run


def vlc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 15).alias("bound"), (F.col("event_id") % 8).alias("cut"))
    theta = F.greatest(F.col("bound") - F.col("cut"), F.lit(0))
    e = e.withColumn("residual", F.col("event_id") % 12 - F.least(theta, F.lit(5)))
    return e.select("event_id", "residual", w.code_length(F.col("residual"), F.col("bound"), F.col("cut")).alias("bits"))


def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 20).alias("q"), (F.col("user_id") % 31).alias("r"), (F.col("event_id") % 5).alias("gain"), (F.col("event_id") % 31).alias("priority"))
    return e.select("event_id", w.truncation(F.col("q"), F.col("r"), F.col("gain"), F.col("priority")).cast("long").alias("cut"))


def nlt_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plane(spark, sf_dir)
    lin, quad = w.linear_in(F.col("v"), 20, 12), w.quadratic_in(F.col("v"), 18, 12, 0)
    return p.select("plane", "y", "x", lin.alias("lin"), quad.alias("quad"), w.linear_out(lin, 20, 12).alias("lin_back"), w.quadratic_out(quad, 18, 12, 0).alias("quad_back"))


def vertical_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.predicted_planes(planes_of_bits(spark, sf_dir), ["plane", "g"], "y", 2)


def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes_of_bits(spark, sf_dir).groupBy("plane", "planes").agg(F.count("*").alias("n"))


def rate_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.smallest_fitting(planes_of_bits(spark, sf_dir), ["plane", "y"], 300)


def bands_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.banded(w.forward_2d(plane(spark, sf_dir)))


def fq_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.lifted(plane(spark, sf_dir), "x", ["plane", "y"]).select("plane", "y", "x", w.rounded_shift(F.col("v") - 2048, 3).cast("long").alias("v"))


def band_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.band_layout(spark, 5, 2, 4, 1)


QUERIES = {
    "synthetic_frame": lambda s, d: im.test_frame(s, 320, 180, 10, 5),
    "preview_bars": lambda s, d: im.preview_frame(s, 320, 180, 11),
    "bayer_stats": lambda s, d: im.bayer_stats(plane(s, d), BITS),
    "superpixel": lambda s, d: im.superpixels(plane(s, d)),
    "bilinear_demosaic": lambda s, d: im.demosaiced(plane(s, d)),
    "srgb": lambda s, d: im.to_srgb(im.superpixels(plane(s, d)), BITS, 200.0),
    "centre_crop": lambda s, d: im.centre_crop(plane(s, d), 64, 250, 30, 100),
    "psnr": psnr,
    "split_mosaic": lambda s, d: im.split_mosaic(plane(s, d)),
    "saxpy": saxpy,
    "dwt53_row": lambda s, d: w.lifted(plane(s, d), "x", ["plane", "y"]),
    "idwt53_row": lambda s, d: w.lifted(plane(s, d), "x", ["plane", "y"], inverse=True),
    "dwt53_2d": bands_2d,
    "dwt53_lossless": lossless("dwt"),
    "star_tetrix_lossless": lossless("star"),
    "fq_round": fq_round,
    "rct": rct,
    "bitplane_count": planes_of_bits,
    "quant_deadzone": quantise(False),
    "quant_uniform": quantise(True),
    "truncation": truncation,
    "vlc_length": vlc_length,
    "vertical_predictor": vertical_predictor,
    "q_histogram": q_histogram,
    "nlt_scale": nlt_scale,
    "rate_pick": rate_pick,
    "band_layout": band_order,
}


def lift_sql(source: str, along: str, across: str, out: str, inverse: bool = False) -> str:
    """CTEs that lift a table of cells along an axis by two self-joins."""
    near = lambda t, c: f"(coalesce(a.v, b.v, 0) + coalesce(b.v, a.v, 0))"
    keys = [k.strip() for k in across.split(",")]
    on = lambda s: " AND ".join([f"{s}.{k} = c.{k}" for k in keys] + [f"{s}.{along} = c.{along} {'- 1' if s == 'a' else '+ 1'}"])
    rest = ", ".join(f"c.{k}" for k in keys)
    high = f"CASE WHEN c.{along} % 2 = 1 THEN c.v {'+' if inverse else '-'} ({near(0, 0)} >> 1) ELSE c.v END"
    low = f"CASE WHEN c.{along} % 2 = 1 OR (a.v IS NULL AND b.v IS NULL) THEN c.v ELSE c.v {'-' if inverse else '+'} (({near(0, 0)} + 2) >> 2) END"
    steps = (low, high) if inverse else (high, low)
    one = lambda src, e: f"SELECT {rest}, c.{along}, {e} AS v FROM {src} c LEFT JOIN {src} a ON {on('a')} LEFT JOIN {src} b ON {on('b')}"
    return f", {out}_1 AS ({one(source, steps[0])}), {out} AS ({one(out + '_1', steps[1])})\n"


ROW = lift_sql("plane", "x", "plane, y", "row_")
GROUPS = ROW + """
, groups AS (
  SELECT plane, y, x // 4 AS g, max(abs(v)) AS m FROM row_ GROUP BY ALL
), bits AS (SELECT plane, y, g, CASE WHEN m = 0 THEN 0 ELSE length(bin(m)) END AS planes FROM groups)
"""
SITES = "(x % 2 = 0 AND y % 2 = 0)", "(x % 2 <> y % 2)", "(x % 2 = 1 AND y % 2 = 1)"
SUPER = f"""
, super AS (
  SELECT plane, y // 2 AS y, x // 2 AS x, max(v) FILTER {SITES[0].replace('(', '(', 1)}::DOUBLE AS r, avg(v) FILTER {SITES[1]} AS g, max(v) FILTER {SITES[2]}::DOUBLE AS b
  FROM plane GROUP BY ALL
)
"""
QUANT = GROUPS + """
, q AS (
  SELECT r.plane, r.y, r.x, planes, {index} AS q FROM row_ r JOIN bits b ON b.plane = r.plane AND b.y = r.y AND b.g = r.x // 4
)
SELECT plane, y, x, q, CASE WHEN planes <= 3 OR q = 0 THEN 0 ELSE {back} END AS back FROM q
"""
SUM_SHIFTED = " + ".join(f"((q << 3) >> least({k} * greatest(planes - 2, 1), 62))" for k in range(32))
PER_PLANE = "SELECT plane, count(*) AS cells, 0 AS changed FROM plane GROUP BY plane"
ORACLES = {
    "synthetic_frame": """
WITH c AS (SELECT i % 320 AS x, i // 320 AS y FROM range(320 * 180) r(i))
SELECT y, x, CASE WHEN x >= 80 AND x < 112 THEN 1023 WHEN x % 2 = 0 AND y % 2 = 0 THEN x * 1023 // 320 WHEN x % 2 = 1 AND y % 2 = 1 THEN y * 1023 // 180 ELSE 341 END AS v FROM c""",
    "preview_bars": """
WITH c AS (SELECT i % 320 AS x, i // 320 AS y FROM range(320 * 180) r(i)),
d AS (SELECT *, x >= 77 AND x < 99 AND y >= 79 AND y < 101 AS box, x < 81 OR x >= 95 OR y < 83 OR y >= 97 AS edge, y < 120 AS top, x * 8 // 320 + 1 AS k, x * 255 // 319 AS ramp FROM c)
SELECT y, x, CASE WHEN box AND edge THEN 0 WHEN box THEN 255 WHEN top THEN [255,255,0,0,255,255,0,32][k] ELSE ramp END AS r,
       CASE WHEN box AND edge THEN 0 WHEN box THEN 255 WHEN top THEN [255,255,255,255,0,0,0,32][k] ELSE ramp END AS g,
       CASE WHEN box AND edge THEN 0 WHEN box THEN 255 WHEN top THEN [255,0,255,0,255,0,255,32][k] ELSE ramp END AS b FROM d""",
    "bayer_stats": PLANE_SQL + """
SELECT plane, avg(v) FILTER (x % 2 = 0 AND y % 2 = 0) AS mean_r, (avg(v) FILTER (x % 2 = 1 AND y % 2 = 0) + avg(v) FILTER (x % 2 = 0 AND y % 2 = 1)) / 2 AS mean_g,
       avg(v) FILTER (x % 2 = 1 AND y % 2 = 1) AS mean_b, min(v) AS low, max(v) AS high, floor(quantile_cont(v, 0.01))::BIGINT AS p01, floor(quantile_cont(v, 0.99))::BIGINT AS p99,
       avg(CASE WHEN v >= 4094 THEN 1.0 ELSE 0.0 END) AS saturated FROM plane GROUP BY plane""",
    "superpixel": PLANE_SQL + SUPER + "SELECT * FROM super",
    "bilinear_demosaic": PLANE_SQL + """
, n AS (
  SELECT c.*, coalesce(l.v, r.v) + coalesce(r.v, l.v) AS h, coalesce(u.v, d.v) + coalesce(d.v, u.v) AS u_
  FROM plane c LEFT JOIN plane l ON l.plane = c.plane AND l.y = c.y AND l.x = c.x - 1 LEFT JOIN plane r ON r.plane = c.plane AND r.y = c.y AND r.x = c.x + 1
  LEFT JOIN plane u ON u.plane = c.plane AND u.x = c.x AND u.y = c.y - 1 LEFT JOIN plane d ON d.plane = c.plane AND d.x = c.x AND d.y = c.y + 1
), m AS (
  SELECT c.plane, c.y, c.x, c.v::DOUBLE AS v, c.h / 2 AS h, c.u_ / 2 AS u, (coalesce(a.h, b.h) + coalesce(b.h, a.h)) / 4 AS d, (c.h + c.u_) / 4 AS cross_
  FROM n c LEFT JOIN n a ON a.plane = c.plane AND a.x = c.x AND a.y = c.y - 1 LEFT JOIN n b ON b.plane = c.plane AND b.x = c.x AND b.y = c.y + 1
)
SELECT plane, y, x, CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN v WHEN x % 2 = 1 AND y % 2 = 1 THEN d WHEN y % 2 = 0 THEN h ELSE u END AS r,
       CASE WHEN x % 2 <> y % 2 THEN v ELSE cross_ END AS g,
       CASE WHEN x % 2 = 1 AND y % 2 = 1 THEN v WHEN x % 2 = 0 AND y % 2 = 0 THEN d WHEN y % 2 = 0 THEN u ELSE h END AS b FROM m""",
    "srgb": PLANE_SQL + SUPER + """
, lit AS (SELECT plane, y, x, greatest(r - 200, 0) / 3895 AS r, greatest(g - 200, 0) / 3895 AS g, greatest(b - 200, 0) / 3895 AS b FROM super),
tested AS (SELECT *, greatest(r, g, b) < 0.9 AND least(r, g, b) > 0.005 AS good FROM lit),
means AS (
  SELECT plane, CASE WHEN count(*) FILTER (good) > 1000 THEN avg(r) FILTER (good) ELSE avg(r) END AS mr, CASE WHEN count(*) FILTER (good) > 1000 THEN avg(g) FILTER (good) ELSE avg(g) END AS mg,
         CASE WHEN count(*) FILTER (good) > 1000 THEN avg(b) FILTER (good) ELSE avg(b) END AS mb FROM tested GROUP BY plane
), balanced AS (
  SELECT plane, y, x, r * (greatest(mg, 1e-6) / greatest(mr, 1e-6)) AS r, g * (greatest(mg, 1e-6) / greatest(mg, 1e-6)) AS g, b * (greatest(mg, 1e-6) / greatest(mb, 1e-6)) AS b FROM lit JOIN means USING (plane)
), long_ AS (SELECT plane, unnest([r, g, b]) AS v FROM balanced), levels AS (SELECT plane, quantile_cont(v, 0.995) AS p FROM long_ GROUP BY plane),
z AS (SELECT b.plane, y, x, least(greatest(r * (0.9 / greatest(p, 1e-6)), 0), 1) AS r, least(greatest(g * (0.9 / greatest(p, 1e-6)), 0), 1) AS g, least(greatest(b * (0.9 / greatest(p, 1e-6)), 0), 1) AS b FROM balanced b JOIN levels USING (plane))
SELECT plane, y, x, """ + ", ".join(f"floor(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE pow({c}, 1 / 2.4::DOUBLE) * 1.055 - 0.055 END * 255 + 0.5)::BIGINT AS {c}" for c in "rgb") + " FROM z",
    "centre_crop": PLANE_SQL + "SELECT plane, y - 74 AS y, x - 16 AS x, v FROM plane WHERE x BETWEEN 16 AND 45 AND y BETWEEN 74 AND 173",
    "psnr": PLANE_SQL + """
, e AS (SELECT plane, v - (v // 16 * 16 + 8) AS e FROM plane), m AS (SELECT plane, avg(e * e) AS mse, max(abs(e)) AS max_error FROM e GROUP BY plane)
SELECT plane, CASE WHEN mse > 0 THEN 10 * log10(16769025::DOUBLE / mse) ELSE 'inf'::DOUBLE END AS psnr, sqrt(mse) AS rms, max_error, 0 AS unmatched FROM m""",
    "split_mosaic": PLANE_SQL + "SELECT plane, x % 2 + 2 * (y % 2) AS component, y // 2 AS y, x // 2 AS x, v FROM plane",
    "saxpy": "SELECT l_orderkey, l_linenumber, 2.5::DOUBLE * l_quantity + l_tax AS y FROM lineitem",
    "dwt53_row": PLANE_SQL + ROW + "SELECT * FROM row_",
    "idwt53_row": PLANE_SQL + lift_sql("plane", "x", "plane, y", "back", inverse=True) + "SELECT * FROM back",
    "dwt53_2d": PLANE_SQL + lift_sql("plane", "y", "plane, x", "col_") + lift_sql("col_", "x", "plane, y", "both_")
    + "SELECT plane, CASE WHEN x % 2 = 0 THEN 'L' ELSE 'H' END || CASE WHEN y % 2 = 0 THEN 'L' ELSE 'H' END AS band, y // 2 AS y, x // 2 AS x, v FROM both_",
    "dwt53_lossless": PLANE_SQL + PER_PLANE,
    "star_tetrix_lossless": PLANE_SQL + PER_PLANE,
    "fq_round": PLANE_SQL + ROW + "SELECT plane, y, x, CASE WHEN v - 2048 >= 0 THEN (v - 2048 + 4) >> 3 ELSE -((2048 - v + 4) >> 3) END AS v FROM row_",
    "rct": PLANE_SQL + """
, s AS (SELECT plane, y // 2 AS y, x // 2 AS x, max(v) FILTER (x % 2 = 0 AND y % 2 = 0) AS r, max(v) FILTER (x % 2 = 1 AND y % 2 = 0) AS g, max(v) FILTER (x % 2 = 1 AND y % 2 = 1) AS b FROM plane GROUP BY ALL)
SELECT plane, y, x, (r + 2 * g + b) >> 2 AS cy, b - g AS cb, r - g AS cr, true AS lossless FROM s""",
    "bitplane_count": PLANE_SQL + GROUPS + "SELECT * FROM bits",
    "quant_deadzone": PLANE_SQL + QUANT.format(index="abs(v) >> 3", back="(q << 3) + 4"),
    "quant_uniform": PLANE_SQL + QUANT.format(index="CASE WHEN planes <= 3 THEN 0 ELSE ((abs(v) << (planes - 2)) - abs(v) + (1::BIGINT << planes)) >> (planes + 1) END", back=SUM_SHIFTED),
    "truncation": "SELECT event_id, least(greatest(event_id % 20 - event_id % 5 - CASE WHEN event_id % 31 < user_id % 31 THEN 1 ELSE 0 END, 0), 15) AS cut FROM events",
    "vlc_length": """
WITH e AS (SELECT event_id, greatest(user_id % 15 - event_id % 8, 0) AS theta FROM events), r AS (SELECT *, event_id % 12 - least(theta, 5) AS residual FROM e)
SELECT event_id, residual, CASE WHEN residual > theta THEN residual + theta WHEN residual < 0 THEN -2 * residual - 1 ELSE 2 * residual END + 1 AS bits FROM r""",
    "vertical_predictor": PLANE_SQL + GROUPS + "SELECT *, greatest(planes, 2) - greatest(coalesce(lag(planes) OVER (PARTITION BY plane, g ORDER BY y), 2), 2) AS residual FROM bits",
    "q_histogram": PLANE_SQL + GROUPS + "SELECT plane, planes, count(*) AS n FROM bits GROUP BY ALL",
    "nlt_scale": PLANE_SQL + """
, s AS (SELECT plane, y, x, (v << 8) - 524288 AS lin, floor(sqrt((v << 24)::DOUBLE))::BIGINT - 131072 AS quad FROM plane)
SELECT *, least(greatest((lin + 524288 + 128) >> 8, 0), 4095) AS lin_back,
       least(greatest((least(greatest(quad + 131072, 0), 262143) * least(greatest(quad + 131072, 0), 262143) + 8388608) >> 24, 0), 4095) AS quad_back FROM s""",
    "rate_pick": PLANE_SQL + GROUPS + """
, each AS (SELECT plane, y, cut, sum(4 * greatest(planes - cut, 0))::BIGINT AS bits FROM bits, range(16) c(cut) GROUP BY ALL)
SELECT plane, y, min(cut) AS cut, arg_min(bits, cut) AS bits FROM each WHERE bits <= 300 GROUP BY plane, y""",
    "band_layout": """
WITH b AS (SELECT i AS band, i >= 30 AS whole FROM range(31) r(i)),
c AS (SELECT band, whole, CASE WHEN whole THEN -1 ELSE band // 3 END AS filter, CASE WHEN whole THEN band - 27 ELSE band % 3 END AS component FROM b)
SELECT band, component, filter, CASE WHEN whole THEN 0 WHEN filter >= 4 THEN 2 - (filter - 4) // 3 ELSE 2 END AS dy FROM c""",
}
