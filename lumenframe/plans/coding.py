"""Queries on resized planes, prefix codes, the quantiser's search and latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import codes, packetwalk, resample
from lumenframe.plans.geometry import COLUMNS, NLX, NLY, pictures
from lumenframe.plans.geometry import ORACLES as GEOMETRY_SQL
from lumenframe.plans.imaging import GROUPS, planes_of_bits
from lumenframe.sources.tables import FRAMES_SQL, LINES, PLANE_SQL, TOP, frames, plane, table
from lumenframe.storage import reserved
from lumenframe.streaming import latest

WIDE, TARGET, BUDGET, BANDS, RAW_BITS = 64, 24, 24, 5, 4


def resized(kernel: str, out: tuple[int, int]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return resample.resized(plane(spark, sf_dir), (WIDE, LINES), out, kernel, TOP)

    return run


def vlc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sixteen counts' codes, from events: their bytes, and the counts that are decoded from them."""
    e = table(spark, sf_dir, "events")
    theta = F.greatest(F.col("user_id") % 15 - F.col("event_id") % 8, F.lit(0))
    item = F.struct((F.col("event_id") % 16).alias("at"), (F.col("event_id") % 12 - F.least(theta, F.lit(5))).alias("residual"), theta.alias("theta"))
    lines = e.groupBy(F.expr("event_id div 16").alias("line")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    lines = lines.select("line", F.transform("items", lambda i: i["theta"]).alias("thetas"), codes.coded_bits(F.col("items")).alias("bits"))
    packed = lines.select("line", "thetas", codes.bits_to_bytes(F.col("bits")).alias("content"))
    back = packed.withColumn("runs", codes.runs_of(codes.bytes_to_bits(F.col("content")))).withColumn("got", codes.decoded(F.col("runs"), F.col("thetas")))
    # the outer form, as for the other Spark infers a filter and works the codes out anew in it
    return back.select("line", F.hex("content").alias("content"), F.posexplode_outer("got").alias("i", "residual")).withColumn("i", F.col("i").cast("long"))


def weights(spark: SparkSession) -> DataFrame:
    return spark.range(BANDS).select(F.col("id").alias("band"), (F.col("id") % 3).alias("gain"), ((F.col("id") * 3 + 1) % BANDS).alias("priority"))


def quantiser_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of planes stand in for precincts, every fifth group for a band."""
    bands = planes_of_bits(spark, sf_dir).withColumn("band", F.col("g") % BANDS)
    return codes.quantiser(bands, ["plane", "y"], weights(spark), BUDGET)


def count_modes(each_packet: bool):
    """Four lines of a plane stand in for a precinct, each for a packet; the upper two share bands, and the lower two."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = planes_of_bits(spark, sf_dir).withColumn("cut", F.expr("y div 4") % 3 + 1)
        told = codes.count_bits(p, ["plane", "g"], "y", "cut", 16)
        half = F.expr("y % 4 div 2")
        cells = told.select("plane", F.expr("y div 4").alias("precinct"), (F.col("y") % 4).alias("packet"), half.alias("set"), (half * 4 + F.expr("g div 4")).alias("band"), "flat", "up")
        return codes.count_modes(cells, ["plane", "precinct"], F.col("precinct") % 4 == 0, RAW_BITS, each_packet)

    return run


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = reserved(spark, "latest")
    rows = frames(spark, sf_dir, stream=True).select("camera", "arrival", "frame_number", "bytes_written")
    latest.publish(latest.latest_stream(rows, "camera", "arrival"), path)
    return latest.current(spark, path, "camera", "arrival")


#: Bands of the codestreams, and rows of precincts in a slice.
STREAM_BANDS, SLICE_ROWS = 31, 4


def codestreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made codestreams of the pictures that suppliers stand in for; every fifth is cut short, every seventh has an overlong packet.

    Lengths follow from a packet's place; modes 2 and 3 of a band have significance flags.
    """
    laid = packetwalk.layouts(pictures(spark, sf_dir), COLUMNS, NLX, NLY, components=4, apart=1, slice_rows=SLICE_ROWS)
    picture, modes = F.col("picture"), F.expr(f"transform(sequence(0, {STREAM_BANDS - 1}), b -> cast((b + picture) % 4 AS bigint))")
    broken = lambda p: (picture % 7 == 0) & (p == 5)  # noqa: E731; its length doesn't count what the packet has too much

    def lengths(p: Column, packet: Column, k: Column) -> Column:
        seed = picture + 3 * p["precinct"] + 5 * k
        flags = F.aggregate(F.filter(packet, lambda x: F.get("modes", x["band"]) >= 2), F.lit(0), lambda a, x: a + x["flags"])
        dat = seed % 11 + F.when(broken(p["precinct"]) & (k == 3), 900).otherwise(0)
        sig = F.when(seed % 6 == 0, 0).otherwise(F.ceil(flags / 8.0).cast("int"))
        return F.struct((seed % 6 == 0).alias("raw"), sig.alias("sig"), (seed % 3).alias("cnt"), dat.alias("dat"), (seed % 2).alias("sgn"))

    def held(p: Column) -> Column:
        told = F.transform(p["packets"], lambda packet, k: lengths(p, packet, k))
        text = packetwalk.packed_hex(F.col("modes"), told, p["precinct"] % 32, p["precinct"] % 3)
        return F.struct(p["slice"].alias("slice"), p["precinct"].alias("precinct"), text.alias("t"))

    def lead(x: Column, i: Column) -> Column:
        less = F.lpad(F.hex(F.conv(F.substring(x["t"], 1, 6), 16, 10).cast("long") - 900), 6, "0")
        text = F.when(broken(x["precinct"]), F.concat(less, F.substr(x["t"], F.lit(7)))).otherwise(x["t"])
        new = (i == 0) | (F.get("a", i - 1)["slice"] != x["slice"])
        return F.concat(F.when(new, F.concat(F.lit("FF200004"), F.lpad(F.hex(x["slice"]), 4, "0"))).otherwise(""), text)

    parts = laid.withColumn("modes", modes).withColumn("a", F.transform("layout", held))
    whole = parts.select("picture", "layout", F.unhex(F.concat(F.array_join(F.transform("a", lead), ""), F.lit("FF11"))).alias("c"))
    cut = F.when(picture % 5 == 0, F.expr("substring(c, 1, length(c) - 7)")).otherwise(F.col("c"))
    told = [F.lit(STREAM_BANDS).alias("bands"), F.lit(True).alias("short"), F.lit(True).alias("signs")]
    return whole.select("picture", cut.alias("content"), "layout", *told)


def packet_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packetwalk.walk(spark, codestreams(spark, sf_dir)).drop("at")


LANCZOS = resample.fitted(WIDE, LINES, TARGET)
LINEAR = (TARGET, LINES * TARGET // WIDE & ~1)

QUERIES = {
    "lanczos_resize": resized("lanczos", LANCZOS),
    "linear_resize": resized("linear", LINEAR),
    "vlc_lines": vlc_lines,
    "quantiser_search": quantiser_search,
    "count_modes": count_modes(True),
    "count_modes_by_set": count_modes(False),
    "stream_latest": stream_latest,
    "packet_walk": packet_walk,
}


def _taps_sql(name: str, size: int, out: int, kernel: str) -> str:
    scale = size / out
    if kernel == "lanczos":
        wide = max(scale, 1.0)
        x = f"((s - (o + 0.5::DOUBLE) * {scale}::DOUBLE + 0.5::DOUBLE) / {wide}::DOUBLE)"
        near = f"CASE WHEN {x} = 0 THEN 1.0::DOUBLE ELSE sin(pi() * {x}) / (pi() * {x}) * sin(pi() * {x} / 3) / (pi() * {x} / 3) END"
        edge = lambda sign: f"floor((o + 0.5::DOUBLE) * {scale}::DOUBLE {sign} {3 * wide}::DOUBLE + 0.5::DOUBLE)"
        raw = f"SELECT o, s, CASE WHEN abs({x}) < 3 THEN {near} ELSE 0 END AS w FROM range({out}) a(o), range({size}) b(s) WHERE s >= {edge('-')} AND s < {edge('+')}"
    else:
        at = f"greatest(0.0::DOUBLE, least({size - 1}::DOUBLE, (o + 0.5::DOUBLE) * {scale}::DOUBLE - 0.5::DOUBLE))"
        raw = f"SELECT o, s, greatest(0.0::DOUBLE, 1 - abs(s - {at})) AS w FROM range({out}) a(o), range({size}) b(s) WHERE abs(s - {at}) < 1"
    return f", {name}_raw AS ({raw}), {name} AS (SELECT o, s, CAST(floor(w / sum(w) OVER (PARTITION BY o) * 4194304 + 0.5) AS BIGINT) AS k FROM {name}_raw)\n"


def _resize_sql(kernel: str, out: tuple[int, int]) -> str:
    held = f"greatest(0, least({TOP}, (sum(v * k)::BIGINT + 2097152) >> 22))"
    return PLANE_SQL + _taps_sql("across", WIDE, out[0], kernel) + _taps_sql("down", LINES, out[1], kernel) + f"""
, wide AS (SELECT plane, y, o AS x, {held} AS v FROM plane JOIN across ON x = s GROUP BY plane, y, o)
SELECT plane, o AS y, x, {held} AS v FROM wide JOIN down ON y = s GROUP BY plane, o, x"""


MODES_SQL = PLANE_SQL + GROUPS + f"""
, cells AS (
  SELECT plane, g, y, y // 4 AS precinct, y % 4 AS packet, y % 4 // 2 AS set_, y % 4 // 2 * 4 + g // 4 AS band, greatest(planes, y // 4 % 3 + 1) AS held,
         y // 4 % 3 + 1 AS cut, lag(planes) OVER w AS above, lag(y // 4 % 3 + 1) OVER w AS cut_above
  FROM bits WINDOW w AS (PARTITION BY plane, g, y // 16 ORDER BY y)
), based AS (SELECT *, CASE WHEN above IS NULL THEN cut ELSE greatest(above, cut, cut_above) END AS base FROM cells),
sized AS (
  SELECT *, held - cut + 1 AS flat, 1 + CASE WHEN held - base > base - cut THEN held - cut WHEN held < base THEN 2 * (base - held) - 1 ELSE 2 * (held - base) END AS up FROM based
), modes AS (
  SELECT plane, precinct, band, sum(up) < sum(flat) AND precinct % 4 > 0 AS pred FROM sized GROUP BY plane, precinct, band
), packets AS (
  SELECT plane, precinct, set_, packet, CAST(ceil(sum(CASE WHEN pred THEN up ELSE flat END) / 8.0) AS BIGINT) AS coded_bytes,
         CAST(ceil(count(*) * {RAW_BITS} / 8.0) AS BIGINT) AS raw_bytes, count(DISTINCT band) FILTER (pred) AS predicted
  FROM sized JOIN modes USING (plane, precinct, band) GROUP BY plane, precinct, set_, packet
), told AS (SELECT *, {{raw}} AS raw FROM packets)
SELECT plane, precinct, packet, raw, coded_bytes, raw_bytes, CASE WHEN raw THEN raw_bytes ELSE coded_bytes END AS bytes, CASE WHEN raw THEN 0 ELSE predicted END AS predicted FROM told"""

ORACLES = {
    "count_modes": MODES_SQL.format(raw="coded_bytes > raw_bytes"),
    "count_modes_by_set": MODES_SQL.format(raw="sum(coded_bytes) OVER s > sum(raw_bytes) OVER s").replace("FROM packets)", "FROM packets WINDOW s AS (PARTITION BY plane, precinct, set_))"),
    "lanczos_resize": _resize_sql("lanczos", LANCZOS),
    "linear_resize": _resize_sql("linear", LINEAR),
    "vlc_lines": """
WITH e AS (
  SELECT event_id // 16 AS line, event_id % 16 AS k, greatest(user_id % 15 - event_id % 8, 0) AS theta,
         event_id % 12 - least(greatest(user_id % 15 - event_id % 8, 0), 5) AS residual FROM events
), bits AS (
  SELECT line, string_agg(repeat('1', (CASE WHEN residual > theta THEN residual + theta WHEN residual < 0 THEN -2 * residual - 1 ELSE 2 * residual END)::INT) || '0', '' ORDER BY k) AS b
  FROM e GROUP BY line
), filled AS (SELECT line, b || repeat('0', ((8 - length(b) % 8) % 8)::INT) AS b FROM bits),
packed AS (SELECT line, array_to_string(list_transform(range(length(b) // 4), lambda i: upper(printf('%x', list_reduce(list_transform(string_split(substr(b, i * 4 + 1, 4), ''), lambda d: d::INT), lambda x, y: x * 2 + y)))), '') AS content FROM filled)
SELECT line, content, row_number() OVER (PARTITION BY line ORDER BY k) - 1 AS i, residual FROM e JOIN packed USING (line)""",
    "quantiser_search": PLANE_SQL + GROUPS + f"""
, bands AS (SELECT plane, y, planes, g % {BANDS} AS band FROM bits),
hist AS (SELECT plane, y, band, planes, count(*) AS n FROM bands GROUP BY ALL),
sizes AS (
  SELECT plane, y, q, r, CAST(ceil(sum(4 * n * greatest(planes - least(greatest(q - band % 3 - CASE WHEN (band * 3 + 1) % {BANDS} < r THEN 1 ELSE 0 END, 0), 15), 0)) / 8.0) AS BIGINT) AS bytes
  FROM hist, range(32) a(q), range({2 * BANDS}) b(r) GROUP BY plane, y, q, r
), chosen AS (SELECT plane, y, min(q) AS q FROM sizes WHERE r = 0 AND bytes <= {BUDGET} GROUP BY plane, y),
best AS (SELECT plane, y, q, max(r) AS r, max_by(bytes, r) AS bytes FROM sizes JOIN chosen USING (plane, y, q) WHERE bytes <= {BUDGET} GROUP BY plane, y, q)
SELECT plane, y, q, r, bytes, {BUDGET} - bytes AS filler FROM (SELECT DISTINCT plane, y FROM bands) LEFT JOIN best USING (plane, y)""",
    "stream_latest": FRAMES_SQL + "SELECT camera, max(arrival) AS arrival, max_by(frame_number, arrival) AS frame_number, max_by(bytes_written, arrival) AS bytes_written FROM frames GROUP BY camera",
    "packet_walk": f"""
WITH layout AS ({GEOMETRY_SQL["packet_layout"]}), geo AS ({GEOMETRY_SQL["precinct_geometry"]}),
flags AS (
  SELECT picture, precinct, filter, flags FROM geo UNION ALL
  SELECT DISTINCT picture, precinct, 10, CASE WHEN "column" = max("column") OVER (PARTITION BY picture) THEN ((picture % 700 + 64 - 1) % 256 + 1 + 31) // 32 ELSE 8 END FROM geo
), grid AS (SELECT DISTINCT picture, precinct, "row" // {SLICE_ROWS} AS slice FROM geo),
sums AS (
  SELECT picture, precinct, packet, sum(CASE WHEN (band + picture) % 4 >= 2 THEN flags ELSE 0 END) AS g, picture + 3 * precinct + 5 * packet AS k
  FROM layout JOIN flags USING (picture, precinct) WHERE filter = least(band // 3, 10) GROUP BY picture, precinct, packet
), sized AS (
  SELECT picture, slice, precinct, packet, k % 6 = 0 AS raw, CASE WHEN k % 6 = 0 THEN 0 ELSE CAST(ceil(g / 8.0) AS BIGINT) END AS sig,
         k % 3 AS cnt, k % 11 AS dat, k % 2 AS sgn, packet = max(packet) OVER (PARTITION BY picture, precinct) AS last,
         picture % 7 = 0 AND precinct = 5 AND packet = 3 AS long, max(precinct) OVER (PARTITION BY picture) AS bottom
  FROM sums JOIN grid USING (picture, precinct)
), kept AS (
  SELECT * FROM sized WHERE NOT (picture % 7 = 0 AND (precinct > 5 OR (precinct = 5 AND packet >= 3)) AND bottom >= 5)
                        AND NOT (picture % 5 = 0 AND precinct = bottom AND NOT (picture % 7 = 0 AND bottom >= 5))
)
SELECT picture, slice, precinct, packet, precinct % 32 AS q, raw, sig, cnt, dat, sgn, CASE WHEN last THEN precinct % 3 END AS filler, NULL AS error FROM kept
UNION ALL
SELECT picture, slice, precinct, packet, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'the packets run past their precinct' FROM sized WHERE long
UNION ALL
SELECT DISTINCT picture, slice, precinct, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'the precinct runs past the end'
FROM sized WHERE picture % 5 = 0 AND precinct = bottom AND NOT (picture % 7 = 0 AND bottom >= 5)""",
}
