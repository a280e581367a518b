"""Queries on headers, packets, bit fields, reports and listings. Line items stand in for packets, parts for pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import bits as b
from lumenframe.functions import timing as t
from lumenframe.operators import codestream as c
from lumenframe.operators import telemetry
from lumenframe.sources import catalogues
from lumenframe.sources.tables import FRAMES_SQL, frames, table


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    return l.select(
        (F.col("l_orderkey") % 50).alias("slice"),
        F.col("l_orderkey").alias("precinct"),
        F.col("l_linenumber").alias("packet"),
        (F.col("l_linestatus") == "O").alias("raw"),
        (q % 5).alias("sig_bytes"),
        (q % 7).alias("cnt_bytes"),
        q.alias("dat_bytes"),
        (q % 3).alias("sgn_bytes"),
        (q * 3).alias("groups"),
        (q * 4 + 4).alias("samples"),
        (q + 6).alias("declared"),
        F.lit(55).cast("long").alias("precinct_bytes"),
    )


PACKETS_SQL = """
WITH l AS (SELECT *, l_quantity::BIGINT AS q FROM lineitem), packets AS (
  SELECT l_orderkey % 50 AS slice, l_orderkey AS precinct, l_linenumber AS packet, l_linestatus = 'O' AS raw, q % 5 AS sig_bytes, q % 7 AS cnt_bytes,
         q AS dat_bytes, q % 3 AS sgn_bytes, q * 3 AS groups, q * 4 + 4 AS samples, q + 6 AS declared, 55 AS precinct_bytes FROM l
)
"""


def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    h = p.select("p_partkey", (k % 9 * 10).alias("width"), (k % 7).alias("height"), (k % 10).alias("components"), (k % 7).alias("nlx"), (k % 4).alias("nly"), (k % 5).alias("transform"), (k % 12 + 6).alias("bits"))
    return c.header_errors(h).select("p_partkey", F.concat_ws(",", "errors").alias("errors"))


def subpacket_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.overlong(packets(spark, sf_dir)).select("precinct", "packet", "declared")


def band_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("picture"), (F.col("p_partkey") % 2000 + 32).alias("width"), (F.col("p_size") * 37 + 16).cast("long").alias("height"))
    return c.band_sizes(p, 5, 2)


def bit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        "event_id",
        b.with_byte((k * 2654435761) % 4294967296, k % 300, 2).alias("word"),
        b.lane_setting(F.when(k % 2 == 0, 2).otherwise(4)).alias("lanes"),
        b.has_bit(k, k % 7).alias("bit"),
    )


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    word = F.when(k % 4 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(k % 4 == 1, F.concat(F.lit("0"), F.conv(k.cast("string"), 10, 8))).when(k % 4 == 2, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit("z")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(b.parse_integer(word), F.lit(-1)).alias("number"), F.size(b.byte_list(F.concat_ws(",", F.lit("ff"), F.hex(k % 256)))).cast("long").alias("bytes"))


def frame_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the per-frame log."""
    f = frames(spark, sf_dir)
    crc = F.format_string("0x%08x", (F.col("arrival") * 7919) % 4294967296)
    latency = F.format_string("%.3f", F.coalesce(telemetry.latency_ms(), F.lit(0.0)))
    return f.select("arrival", F.concat_ws(",", "camera", F.col("frame_number").cast("string"), F.col("bytes_written").cast("string"), crc, F.col("dropped").cast("string"), latency).alias("line"))


def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run summary as one JSON text, with a list of cameras."""
    each = frames(spark, sf_dir).groupBy("camera").agg(F.count("*").alias("frames"), F.sum(telemetry.frame_bytes()).alias("bytes"))
    cameras = F.array_sort(F.collect_list(F.struct("camera", "frames", "bytes")))
    return each.agg(F.to_json(F.struct(F.sum("frames").alias("frames"), cameras.alias("cameras"))).alias("json"))


def markdown_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.select(F.format_string("| %d | %s | %s |", "n_nationkey", "n_name", F.coalesce("r_name", F.lit("-"))).alias("line"))


def probe_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.intervals(frames(spark, sf_dir), F.col("bytes_written") < 500)


def timestamp_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss-SSS").alias("label"))


def emulated_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and rate that registers ask for: a window if set, then halved by binning; a window of size 0 is the whole."""
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select("p_partkey", (k % 3 == 0).alias("crop"), (k % 2 == 0).alias("binned"), (k % 5 * 700).alias("w"), (k % 4 * 500).alias("h"), (k % 7 * 100).alias("hmax"), (k % 6 * 900).alias("vmax"))
    window = F.col("crop") & (F.col("w") > 0) & (F.col("h") > 0)
    half = F.when(F.col("binned"), 2).otherwise(1)
    size = [F.floor(F.when(window, F.col(a)).otherwise(b_) / half).alias(n) for a, b_, n in (("w", 3552, "width"), ("h", 3556, "height"))]
    return r.select("p_partkey", *size, F.when((F.col("hmax") > 0) & (F.col("vmax") > 0), t.fps_of(F.col("hmax"), F.col("vmax"))).otherwise(30.0).alias("fps"))


def csi_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalogues.modes(spark)
    line = t.line_stride(F.col("width"), F.col("bits"))
    return m.select("name", line.alias("line_bytes"), (line * (F.col("height") + 2) + 16).alias("length"), t.black_level(F.col("bits")).alias("black"))


def port_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's rows for one port; where none has it, its first row moved there."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 4).alias("port"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    each = rows.groupBy("l_suppkey").agg(F.min(F.when(F.col("port") == 3, F.col("k"))).alias("own"), F.min("k").alias("first"))
    return each.select("l_suppkey", F.coalesce("own", "first").alias("k"), F.col("own").isNull().alias("moved"))


def count_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 11).agg(F.count("*").alias("messages"), F.max("id").alias("last"))


def newest_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each stream, as a latest-value sink holds it."""
    return frames(spark, sf_dir).groupBy("event_type").agg(F.max("arrival").alias("sequence"), F.max_by("bytes_written", "arrival").alias("value"))


def cfa_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.operators.wavelet import CFA_PATTERNS

    known = spark.createDataFrame([(n, x, y, ct) for n, x, y, ct in CFA_PATTERNS], "name string, xs array<int>, ys array<int>, type int")
    k = F.col("p_partkey")
    bit = lambda i, d: (F.floor(k / (1 << i)) % 2).cast("int") if d else F.lit(0)
    asked = table(spark, sf_dir, "part").select("p_partkey", F.array(*[bit(i, 1) for i in range(4)]).alias("xs"), F.array(*[bit(i, 1) for i in range(4, 8)]).alias("ys"))
    met = asked.join(F.broadcast(known), ["xs", "ys"], "left")
    return met.select("p_partkey", F.coalesce("name", F.lit("reserved")).alias("pattern"), F.coalesce("type", F.lit(-1)).alias("type"))


QUERIES = {
    f.__name__: f
    for f in (
        header_rules, subpacket_lengths, band_geometry, bit_fields, number_texts, frame_csv, summary_json, markdown_catalogue, probe_intervals,
        timestamp_labels, emulated_geometry, csi_layout, port_override, count_messages, newest_per_stream, cfa_pattern,
    )
} | {"packet_profile": lambda s, d: c.profile(packets(s, d), ["slice"])}

LOW = "CAST(ceil({n} / {d}::DOUBLE) AS BIGINT)"
BANDS = []
for _name, _kx, _hx, _ky, _hy in [("LL", 5, 0, 2, 0)] + [(f"HL{k}", k, 1, 2, 0) for k in (5, 4, 3)] + [x for k in (2, 1) for x in ((f"HL{k}", k, 1, k, 0), (f"LH{k}", k, 0, k, 1), (f"HH{k}", k, 1, k, 1))]:
    _w = LOW.format(n="width", d=1 << (_kx - _hx)) + (" // 2" if _hx else "")
    _h = LOW.format(n="height", d=1 << (_ky - _hy)) + (" // 2" if _hy else "")
    BANDS.append(f"SELECT picture, {len(BANDS)} AS band, '{_name}' AS name, {_w} AS width, {_h} AS height FROM p")
RULES = [("width > 0", "width"), ("height > 0", "height"), ("components BETWEEN 1 AND 8", "components"), ("nly <= nlx", "vertical levels"), ("nlx BETWEEN 1 AND 5", "horizontal levels"), ("(transform <> 1 OR components >= 3)", "colour transform"), ("(transform <> 3 OR components = 4)", "mosaic transform"), ("bits BETWEEN 8 AND 16", "bit depth")]
ORACLES = {
    "header_rules": """
WITH h AS (SELECT p_partkey, p_partkey % 9 * 10 AS width, p_partkey % 7 AS height, p_partkey % 10 AS components, p_partkey % 7 AS nlx, p_partkey % 4 AS nly, p_partkey % 5 AS transform, p_partkey % 12 + 6 AS bits FROM part)
SELECT p_partkey, concat_ws(',', """ + ", ".join(f"CASE WHEN NOT ({ok}) THEN '{name}' END" for ok, name in RULES) + ") AS errors FROM h",
    "subpacket_lengths": PACKETS_SQL + "SELECT precinct, packet, declared FROM packets WHERE declared < sig_bytes + cnt_bytes + dat_bytes + sgn_bytes OR declared > precinct_bytes",
    "packet_profile": PACKETS_SQL + """
, s AS (SELECT slice, sum(sig_bytes)::BIGINT AS sig, sum(cnt_bytes)::BIGINT AS cnt, sum(dat_bytes)::BIGINT AS dat, sum(sgn_bytes)::BIGINT AS sgn, count(*) FILTER (raw) AS raw_packets,
  sum(samples)::BIGINT AS samples, sum(CASE WHEN raw THEN 0 ELSE (groups + 7) // 8 END)::BIGINT AS sig_needed FROM packets GROUP BY slice), t AS (SELECT *, sig + cnt + dat + sgn AS total FROM s)
SELECT slice, sig, cnt, dat, sgn, sig * 100 / total AS sig_percent, cnt * 100 / total AS cnt_percent, dat * 100 / total AS dat_percent, sgn * 100 / total AS sgn_percent, raw_packets, sig_needed, total * 8 / samples AS bits_per_sample FROM t""",
    "band_geometry": "WITH p AS (SELECT p_partkey AS picture, p_partkey % 2000 + 32 AS width, p_size * 37 + 16 AS height FROM part) " + " UNION ALL ".join(BANDS),
    "bit_fields": """
SELECT event_id, ((event_id * 2654435761 % 4294967296) & 4278255615) | (((event_id % 300) & 255) << 16) AS word, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 6 END AS lanes,
       (event_id >> (event_id % 7)::INT) & 1 = 1 AS bit FROM events""",
    "number_texts": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id ELSE -1 END AS number, 2 AS bytes FROM events",
    "frame_csv": FRAMES_SQL + """
SELECT arrival, concat_ws(',', camera, frame_number::VARCHAR, bytes_written::VARCHAR, printf('0x%08x', arrival * 7919 % 4294967296), dropped::VARCHAR,
  printf('%.3f', CASE WHEN timestamp_s > 0 AND received_s > 0 AND received_s - timestamp_s > -10 AND received_s - timestamp_s < 10
    THEN ((received_s - timestamp_s) * 1000000000 + received_ns - timestamp_ns) / 1e6 ELSE 0.0 END)) AS line FROM frames""",
    "summary_json": FRAMES_SQL + """
, e AS (SELECT camera, count(*) AS frames, CAST(sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) AS BIGINT) AS bytes FROM frames GROUP BY camera)
SELECT '{"frames":' || sum(frames)::BIGINT || ',"cameras":[' || string_agg('{"camera":"' || camera || '","frames":' || frames || ',"bytes":' || bytes || '}', ',' ORDER BY camera) || ']}' AS json FROM e""",
    "markdown_catalogue": "SELECT printf('| %d | %s | %s |', n_nationkey, n_name, coalesce(r_name, '-')) AS line FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "probe_intervals": FRAMES_SQL + """
, g AS (SELECT camera, bytes_written, timestamp_s - lag(timestamp_s) OVER (PARTITION BY camera ORDER BY arrival) AS gap FROM frames)
SELECT camera, count(*) AS parts, count(*) FILTER (bytes_written < 500) AS black, min(gap) AS least, max(gap) AS most, avg(gap) AS mean FROM g GROUP BY camera""",
    "timestamp_labels": "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S-') || lpad((extract(millisecond FROM ts) % 1000)::VARCHAR, 3, '0') AS label FROM events",
    "emulated_geometry": """
WITH r AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AND p_partkey % 5 > 0 AND p_partkey % 4 > 0 AS win, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS half, p_partkey % 7 * 100 AS hmax, p_partkey % 6 * 900 AS vmax FROM part)
SELECT k AS p_partkey, CASE WHEN win THEN k % 5 * 700 ELSE 3552 END // half AS width, CASE WHEN win THEN k % 4 * 500 ELSE 3556 END // half AS height,
       CASE WHEN hmax > 0 AND vmax > 0 THEN 74250000.0::DOUBLE / (hmax::DOUBLE * vmax) ELSE 30.0 END AS fps FROM r""",
    "csi_layout": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {(w * b_ // 8 + 7) // 8 * 8}, {(w * b_ // 8 + 7) // 8 * 8 * (h + 2) + 16}, {200 if b_ == 12 else 50})" for _, n, _, w, h, b_, _, _, _ in catalogues.MODES) + ") v(name, line_bytes, length, black)",
    "port_override": """
WITH r AS (SELECT l_suppkey, l_linenumber % 4 AS port, l_orderkey * 10 + l_linenumber AS k FROM lineitem), e AS (SELECT l_suppkey, min(k) FILTER (port = 3) AS own, min(k) AS first FROM r GROUP BY l_suppkey)
SELECT l_suppkey, coalesce(own, first) AS k, own IS NULL AS moved FROM e""",
    "count_messages": "SELECT 10 AS messages, 10 AS last",
    "newest_per_stream": FRAMES_SQL + "SELECT event_type, max(arrival) AS sequence, arg_max(bytes_written, arrival) AS value FROM frames GROUP BY event_type",
    "cfa_pattern": """
WITH b AS (SELECT p_partkey, p_partkey % 16 AS x, p_partkey // 16 % 16 AS y FROM part)
SELECT p_partkey, CASE WHEN x = 10 AND y = 12 THEN 'RGGB' WHEN x = 3 AND y = 5 THEN 'BGGR' WHEN x = 5 AND y = 12 THEN 'GRBG' WHEN x = 12 AND y = 5 THEN 'GBRG' ELSE 'reserved' END AS pattern,
       CASE WHEN x = 10 AND y = 12 OR x = 3 AND y = 5 THEN 0 WHEN x = 5 AND y = 12 OR x = 12 AND y = 5 THEN 1 ELSE -1 END AS type FROM b""",
}
