"""Queries on captures: integrity of frames, dumps and sidecars, rig configurations, request bodies, headers and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import bits, strings
from lumenframe.functions import timing as t
from lumenframe.operators import codestream, imaging, joins, planning, telemetry, wavelet
from lumenframe.operators.ordering import numbered
from lumenframe.plans.planning import requests
from lumenframe.plans.telemetry import TOTALS
from lumenframe.sources import blobs, captures
from lumenframe.sources.tables import FRAMES_SQL, PAYLOAD_SQL, PLANE_SQL, frames, payload_frames, plane, table
from lumenframe.storage import shared_dir
from lumenframe.streaming import frame_stats

EVERY = 3
#: Bits of coefficients and samples, the two thresholds of the curve, and its slope.
CURVE = (18, 12, 20_000, 150_000, 2)
#: Seconds after a camera's first frame between which rates are measured; some cameras' frames end before.
WARM, END = 86_400, 10 * 86_400


def pick(names: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))


def verdict_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with checksums and flat frames; the fourth camera's rate is far from expected, the fifth sends nothing."""
    plan = spark.createDataFrame([(f"cam{i}", 1e-12 if i == 3 else 1e-3) for i in range(5)], "camera string, expected_gbps double")
    f = payload_frames(spark, sf_dir)
    met = telemetry.verdicts(f, F.broadcast(plan), 1e6, 1_000_000_000, "gbps", telemetry.integrity(f, EVERY))
    return met.drop("expected_gbps")


def dump_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.dumped(payload_frames(spark, sf_dir), 10, 7)


def window_or_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last camera's frames end before its warm-up does."""
    f = frames(spark, sf_dir)
    return telemetry.window_or_run(f.where("camera <> 'cam3' OR arrival < 40"), WARM, END)


def psnr_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plane(spark, sf_dir)
    coarse = p.select("plane", "y", "x", F.when(F.col("x") % 2 == 0, F.floor(F.col("v") / 16) * 16 + 8).otherwise(F.col("v")).cast("long").alias("v"))
    return imaging.compared_sites(p, coarse)


def control_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as JSON, as a form with a key twice and a flag, and as a form among blanks."""
    k, name = F.col("p_partkey"), F.url_encode("p_name")
    body = (
        F.when(k % 3 == 0, F.concat(F.lit('{"fps": '), k.cast("string"), F.lit(', "name": "'), F.col("p_name"), F.lit('", "on": true}')))
        .when(k % 3 == 1, F.concat(F.lit("fps=1&on&name="), name, F.lit("&fps="), k.cast("string")))
        .otherwise(F.concat(F.lit(" \tfps="), k.cast("string"), F.lit("&name=&name="), name, F.lit("\n")))
    )
    fields = table(spark, sf_dir, "part").select("p_partkey", strings.request_fields(body).alias("f"))
    return fields.select("p_partkey", F.col("f")["fps"].alias("fps"), F.col("f")["name"].alias("name"), F.coalesce(F.col("f")["on"], F.lit("-")).alias("on"))


def status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each camera's control state with its statistics as one object; a camera without frames has its state alone."""
    state = spark.createDataFrame([(f"cam{i}", "FULL_RAW10", 10 * i) for i in range(5)], "camera string, mode string, gain int")
    stats = telemetry.totals(frames(spark, sf_dir), telemetry.span()).select("camera", F.to_json(F.struct("frames", "bytes")).alias("stats"))
    met = F.broadcast(state).join(stats, "camera", "left")
    return met.select("camera", strings.merged_objects(F.to_json(F.struct("camera", "mode", "gain")), F.coalesce("stats", F.lit(" {} "))).alias("status"))


def dumped_planes(spark: SparkSession, sf_dir: str) -> str:
    """Writes two planes of each camera as RAW12 dumps; their folder."""
    lines = plane(spark, sf_dir).groupBy("plane", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"].cast("int")).alias("px"))
    packed = blobs.pack_lines(lines, "px", 12).groupBy("plane").agg(F.array_sort(F.collect_list(F.struct("y", "px"))).alias("lines"))
    data = F.aggregate("lines", F.unhex(F.lit("")), lambda acc, line: F.concat(acc, line["px"]))
    rows = packed.select("plane", F.concat(F.lit("cam"), (F.col("plane") % 2).cast("string")).alias("camera"), F.size("lines").alias("height"), data.alias("data"))
    first = numbered(rows, ["camera"], "plane", "number").where("number <= 2").withColumn("dump", (F.col("number") - 1).cast("int"))
    settings = F.to_json(F.struct(F.lit(64).alias("width"), "height", F.lit(12).alias("bits"), F.lit(96).alias("line_bytes"), F.lit(0).alias("start_byte")))
    folder = f"{shared_dir(spark)}/dumps-{uuid.uuid4().hex}"
    out = first.select("camera", "dump", F.col("plane").alias("frame_number"), blobs.jamcrc(F.col("data")).alias("crc"), "data", settings.alias("settings"))
    captures.write_dumps(out, folder).write.format("noop").mode("overwrite").save()
    return folder


def raw_dump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures.raw_frames(spark, dumped_planes(spark, sf_dir))
    return found.select("name", F.col("frame_number").alias("plane"), F.col("y").cast("long").alias("y"), F.posexplode("px").alias("x", "v")).select("name", "plane", "y", F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))


def sidecar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.sidecars(spark, dumped_planes(spark, sf_dir)).select("name", "camera", "frame_number", "bytes", "width", "height", "bits", "line_bytes")


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of all files of a dump folder, the newest first."""
    return captures.newest_first(captures.listing(spark, dumped_planes(spark, sf_dir)), 100).where("name LIKE '%.raw'").select("name", "size")


def listing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    path = F.when(F.col("page_id") % 5 == 0, F.concat(path, F.lit("/"))).otherwise(path)
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    tests = {"by_text": {"text": "BLOG"}, "by_prefix": {"prefix": "1"}, "by_both": {"text": "/en", "prefix": "2"}, "by_name": {"exact": "blog.tionsh.example.com/en/"}}
    return p.select("page_id", *[captures.listed(F.col("path"), **how).alias(n) for n, how in tests.items()])


RIGS = [
    '{"cameras": [{"port": "j1a", "fps": 25.5}, {"port": "CAM2", "mode": "bin2_raw12", "lanes": 2}], "report_interval_s": 5}',
    '{"receiver": "usb", "cameras": [{"port": "j1a"}]}',
    '{"receiver": "linux", "cameras": []}',
    '{"cameras": [{"port": "J1B", "gain_db": 6}, {"mode": "FULL_RAW10"}]}',
    '{"cameras": [{"port": "3", "mode": "none"}, {"port": "x"}]}',
    '{"cameras": [{"port": "J1A"}, {"port": "cam3", "mode": "3"}, {"port": "cam1"}]}',
]


def rigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("config"), pick(RIGS, k).alias("json"))


def rig_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures.rig_cameras(rigs(spark, sf_dir)).where("camera IS NOT NULL")
    return found.select("config", "receiver", "report_interval_s", "camera", F.coalesce("connector", F.lit("-")).alias("connector"), F.coalesce("mode_name", F.lit("-")).alias("mode"), "fps", "lanes", "exposure_ms", "gain_db")


def pgx_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes as PGX images, every other one with the low byte first."""
    cells = plane(spark, sf_dir).groupBy("plane").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("cells"), (F.max("y") + 1).alias("height"))
    two = lambda c: F.when(F.col("plane") % 2 == 0, F.lpad(F.hex(c["v"]), 4, "0")).otherwise(F.concat(F.lpad(F.hex(c["v"] % 256), 2, "0"), F.lpad(F.hex(F.floor(c["v"] / 256)), 2, "0")))
    head = F.concat(F.lit("PG "), F.when(F.col("plane") % 2 == 0, "ML").otherwise("LM"), F.lit(" +12 64 "), F.col("height").cast("string"), F.lit("\n"))
    content = F.concat(F.encode(head, "UTF-8"), F.unhex(F.array_join(F.transform("cells", two), "")))
    back = blobs.from_pgx(cells.select("plane", content.alias("content")))
    return back.select("plane", "y", F.posexplode("px").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


def codestream_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of codestreams; some lack a segment, repeat one, or end too early."""
    k = F.col("s_suppkey")
    number = lambda v, digits: F.lpad(F.hex(v.cast("long")), digits, "0")
    pih = F.concat(F.lit("FF12001A"), F.lit("00000000" + "00000000"), number(k % 5000, 4), number(k % 3000 + 1, 4), F.lit("0000" + "0010" + "04" + "04" + "08" + "14" + "84" + "03"), F.lit("52"), F.lit("00"))
    cdt, wgt = F.lit("FF13000A0C110C110C110C11"), F.lit("FF1400040102")
    tail = F.when(k % 5 == 0, F.concat(cdt, wgt)).when(k % 5 == 1, cdt).when(k % 5 == 2, F.concat(cdt, wgt, cdt)).when(k % 5 == 3, F.concat(cdt, wgt, F.lit("FF150004AAAA"), F.lit("FF150004BBBB"))).otherwise(F.concat(cdt, F.lit("FF14FFFF")))
    hexed = F.concat(F.lit("FF10FF5000040000"), pih, tail, F.when(k % 5 == 4, "").otherwise("FF200004"))
    found = codestream.scan_headers(table(spark, sf_dir, "supplier").select(k.cast("long").alias("picture"), F.unhex(hexed).alias("content")))
    fields = [F.col("header")[c].alias(c) for c in ("width", "height", "slice_lines", "components", "bw", "fq", "br", "transform", "nlx", "nly")]
    return found.select("picture", F.size("segments").cast("long").alias("segments"), F.col("segments")[1]["at"].cast("long").alias("pih_at"), *fields, "error")


def coding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with settings that differ by order, and the rules that they break."""
    k = F.col("o_orderkey")
    fields = {
        "components": 1 + k % 5, "ng": F.lit(4), "ss": F.when(k % 13 == 0, 7).otherwise(8), "nlx": 1 + k % 6, "nly": k % 4, "sy_most": 1 + k % 2, "sx_most": 1 + k % 3 % 2,
        "fslc": F.lit(0), "ppoc": F.when(k % 17 == 0, 1).otherwise(0), "transform": k % 4, "qpih": k % 3, "fs": k % 2, "rm": k % 2, "slice_lines": k % 19, "bits": 7 + k % 11, "width": k % 200,
        "height": k % 23, "cw": k % 3, "fq": F.when(k % 3 == 0, 0).when(k % 3 == 1, 6).otherwise(8), "bw": F.when(k % 3 == 0, 7 + k % 11).when(k % 3 == 1, 18).otherwise(20 + k % 2), "br": 4 + k % 2,
        "alike": k % 5 > 0, "plain": k % 7 > 0, "nlt": k % 3, "cts": k % 2 == 1, "crg": k % 3 > 0, "apart": k % 3, "cap": k % 512, "rl": k % 2,
    }
    h = table(spark, sf_dir, "orders").select(k.alias("order"), *[(v if n in ("alike", "plain", "cts", "crg") else v.cast("long")).alias(n) for n, v in fields.items()])
    return codestream.coding_errors(h).select("order", F.array_join("errors", ", ").alias("errors"))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as coded precincts of 50 pictures."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 50).alias("picture"), (F.col("l_quantity") % 16).cast("long").alias("q"), (F.col("l_linenumber") % 4).alias("d_mode"), (F.col("l_partkey") % 900).alias("bytes"), F.lit(700).alias("budget"))


def console_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each camera and one for all together."""
    each = telemetry.totals(frames(spark, sf_dir), telemetry.span()).select("camera", "frames", "bytes")
    both = each.unionByName(each.agg(F.lit("all").alias("camera"), F.sum("frames").alias("frames"), F.sum("bytes").alias("bytes")))
    return both.select(F.format_string("%-12s %9d %14d", "camera", "frames", "bytes").alias("line"))


def markdown_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue line for each customer with an order: a left join of the newest order and of its last line."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").select("l_orderkey", (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("place"), "l_partkey")
    last = joins.newest(li, "l_orderkey", "place")
    met = c.join(joins.newest(o, "o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey")).join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    shown = F.coalesce(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.lit(""))
    return met.select(F.format_string("| `%s` | %d | %s |", "c_name", "o_orderkey", shown).alias("line"))


def timing_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with a lane rate and an HMAX of the request's own, and what another frame rate makes of them."""
    k = F.col("request")
    asked = requests(spark, sf_dir).withColumn("rate_override", F.when(k % 4 == 0, pick(["594", "1440", "2376", "1188"], F.floor(k / 4)).cast("int"))).withColumn("hmax_override", F.when(k % 5 == 0, k % 700).cast("int"))
    plans = planning.plan_timing(asked).withColumn("exposure_s", F.lit(0.005)).withColumn("wanted", 5.0 + k % 50)
    done = planning.frame_rate_changed(plans.where("error = ''"), "wanted")
    told = done.select("request", "mbps", "hmax", "vmax", "new_vmax", "new_fps", "new_shutter", "error")
    return told.unionByName(plans.where("error <> ''").select("request", "error"), allowMissingColumns=True).fillna(0).fillna(0.0)


def capability_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", bits.with_bit(k % 512, k % 9).cast("long").alias("flags"), bits.has_bit(bits.with_bit(k % 512, k % 9), k % 7).alias("has"))


def yuv_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", t.yuv_bytes(k % 4000 + 2, k % 2001 + 1, F.when(k % 2 == 0, 8).otherwise(10)).alias("bytes"))


def line_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as parts of a stream: how many are dark, how many lack samples, and how bright the darkest and the brightest are."""
    parts = plane(spark, sf_dir).groupBy("plane", "y").agg((F.avg(F.greatest(F.col("v") - 2048, F.lit(0))) / 16).alias("luma"), F.count("*").alias("samples"))
    return parts.groupBy("plane").agg(F.count("*").alias("parts"), F.count_if(F.col("luma") < 0.5).alias("black"), F.count_if(F.col("samples") < 64).alias("errors"), F.min("luma").alias("darkest"), F.max("luma").alias("brightest"))


def png_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each plane as a PNG image, read back."""
    cells = imaging.centre_crop(plane(spark, sf_dir), 64, 250, 30, 100)
    lines = cells.groupBy("plane", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"]).alias("px"))
    back = blobs.from_png(blobs.to_png(lines, 4095))
    return back.select("plane", "y", F.posexplode("px").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


def precinct_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    parts = {"sig_bytes": k % 3, "cnt_bytes": F.col("l_partkey") % 13, "dat_bytes": F.col("l_suppkey") % 100, "sgn_bytes": F.col("l_linenumber"), "groups": F.col("l_partkey") % 17}
    packets = table(spark, sf_dir, "lineitem").select(k.alias("precinct"), *[v.cast("long").alias(n) for n, v in parts.items()])
    return codestream.precinct_sizes(packets, ["precinct"])


def nlt_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples through the three-part curve and back."""
    c = wavelet.extended_in(F.col("v"), *CURVE)
    return plane(spark, sf_dir).select("plane", "y", "x", c.cast("long").alias("coefficient"), wavelet.extended_out(c, *CURVE).cast("long").alias("back"))


def stream_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a tap after the statistics got, unchanged."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    frame_stats.running_stats(frames(spark, sf_dir, stream=True), path, tap=lambda batch: batch.select("camera", "arrival", "bytes_written"))
    return spark.read.schema("camera string, arrival long, bytes_written long").parquet(f"{path}/tapped/*")


QUERIES = {
    "integrity_counts": lambda s, d: telemetry.integrity(payload_frames(s, d), EVERY),
    "verdict_checked": verdict_checked,
    "dump_counts": dump_counts,
    "window_or_run": window_or_run,
    "psnr_sites": psnr_sites,
    "control_bodies": control_bodies,
    "status_merge": status_merge,
    "raw_dump_scan": raw_dump_scan,
    "sidecar_scan": sidecar_scan,
    "file_listing": file_listing,
    "listing_filter": listing_filter,
    "rig_cameras": rig_cameras,
    "rig_errors": lambda s, d: captures.rig_errors(rigs(s, d)),
    "pgx_read": pgx_read,
    "codestream_headers": codestream_headers,
    "coding_rules": coding_rules,
    "encoder_stats": lambda s, d: codestream.encoder_stats(coded(s, d), ["picture"]),
    "mode_histograms": lambda s, d: codestream.histograms(coded(s, d), ["q", "d_mode"]),
    "console_table": console_table,
    "markdown_captures": markdown_captures,
    "timing_overrides": timing_overrides,
    "capability_bits": capability_bits,
    "yuv_size": yuv_size,
    "line_luma": line_luma,
    "stream_tap": stream_tap,
    "png_crop": png_crop,
    "precinct_bytes": precinct_bytes,
    "nlt_extended": nlt_extended,
}

INTEGRITY_SQL = f"""
, numbered AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY arrival) AS k FROM frames),
crcs AS MATERIALIZED (
  SELECT camera, arrival, h, coalesce(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS own FROM numbered, tab WHERE k % {EVERY} = 0
), looked AS (
  SELECT camera, CASE WHEN arrival % 7 = 0 THEN 0 WHEN arrival % 44 = 1 THEN xor(own, 1) ELSE own END AS crc, crc <> own AS wrong,
         length(h) >= 128 AND len(list_distinct(list_transform(range(0, greatest(length(h) // 8, 1), greatest(length(h) // 8 // 4096, 1)), lambda i: substr(h, 8 * i + 1, 8)))) <= 4 AS flat
  FROM crcs
), checks AS (
  SELECT camera, count(*) FILTER (crc <> 0) AS crc_checked, count(*) FILTER (crc <> 0 AND wrong) AS crc_bad, count(*) FILTER (crc = 0) AS crc_unavailable,
         count(*) FILTER (crc <> 0 AND flat) AS flat_frames FROM looked GROUP BY camera
)
"""
WINDOW = """
, firsts AS (SELECT camera, min(timestamp_s) AS first_s FROM frames GROUP BY camera),
seen AS (
  SELECT camera, count(*) AS n, sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) AS b FROM frames JOIN firsts USING (camera)
  WHERE timestamp_s - first_s > 86400 AND timestamp_s - first_s <= 864000 GROUP BY camera
)
SELECT camera, n IS NOT NULL AS windowed, CASE WHEN n IS NOT NULL THEN n / 777600::DOUBLE ELSE fps END AS fps, CASE WHEN n IS NOT NULL THEN b * 8 / 777600::DOUBLE / 1e9 ELSE gbps END AS gbps
FROM totals LEFT JOIN seen USING (camera)"""
DUMPS_SQL = PLANE_SQL + """
, firsts AS (
  SELECT plane, 'cam' || (plane % 2) AS camera, row_number() OVER (PARTITION BY plane % 2 ORDER BY plane) - 1 AS dump, height
  FROM (SELECT plane, count(DISTINCT y) AS height FROM plane GROUP BY plane)
), named AS (SELECT *, printf('%s_%03d_f%06d', camera, dump, plane) AS name FROM firsts WHERE dump < 2)
"""
RIG_CAMERAS = """
WITH c(k, receiver, report, camera, connector, mode, fps, lanes, gain) AS (
  VALUES (0, 'roce', 5.0, 0, 'J1A', 'FULL_RAW12', 25.5, 4, 0.0), (0, 'roce', 5.0, 1, 'J1B', 'BIN2_RAW12', 0.0, 2, 0.0), (1, 'usb', 2.0, 0, 'J1A', 'FULL_RAW12', 0.0, 4, 0.0),
         (3, 'roce', 2.0, 0, 'J1B', 'FULL_RAW12', 0.0, 4, 6.0), (3, 'roce', 2.0, 1, '-', 'FULL_RAW10', 0.0, 4, 0.0), (4, 'roce', 2.0, 0, 'J1D', '-', 0.0, 4, 0.0), (4, 'roce', 2.0, 1, '-', 'FULL_RAW12', 0.0, 4, 0.0),
         (5, 'roce', 2.0, 0, 'J1A', 'FULL_RAW12', 0.0, 4, 0.0), (5, 'roce', 2.0, 1, 'J1C', 'CROP_3552X2160_RAW10', 0.0, 4, 0.0), (5, 'roce', 2.0, 2, 'J1A', 'FULL_RAW12', 0.0, 4, 0.0)
)
SELECT s_suppkey AS config, receiver, report::DOUBLE AS report_interval_s, camera, connector, mode, fps::DOUBLE AS fps, lanes, 10.0::DOUBLE AS exposure_ms, gain::DOUBLE AS gain_db FROM supplier JOIN c ON s_suppkey % 6 = k"""


def rule(test: str, name: str) -> str:
    return f"CASE WHEN NOT ({test}) THEN '{name}' END"


CAPS = lambda bit: f"(cap & {1 << bit}) > 0"
RULES = ", ".join(
    rule(*r)
    for r in [
        ("components BETWEEN 1 AND 8", "components"), ("ng = 4 AND ss = 8", "groups"), ("nlx BETWEEN 1 AND 8", "horizontal levels"),
        ("nly >= log2(sy_most) AND nly <= least(nlx, 6)", "vertical levels"), ("fslc = 0 AND ppoc = 0", "order"), ("transform IN (0, 1, 3)", "transform"),
        ("qpih <= 1 AND fs <= 1 AND rm <= 1", "modes"), ("slice_lines >= 1", "slice height"), ("bits BETWEEN 8 AND 16", "bit depth"), ("width >= (sx_most << nlx)", "width"),
        ("height >= (sy_most << nly)", "height"), ("cw = 0 OR width % greatest(8 * cw * (sx_most << nlx), 1) >= (sx_most << nlx)", "precinct width"),
        (f"fq <> 0 OR (bw = bits AND alike AND br = CASE WHEN bits <= 12 THEN 4 ELSE 5 END AND nlt = 0 AND {CAPS(6)})", "lossless"), ("fq = 0 OR bw IN (18, 20)", "coefficient bits"),
        (f"fq = 0 OR bw <> 18 OR (fq = 6 AND br = 4 AND nlt > 0 AND ({CAPS(2)} OR {CAPS(3)}))", "18 bits"), (f"fq = 0 OR bw <> 20 OR (fq = 8 AND br = 4 AND NOT {CAPS(2)} AND NOT {CAPS(3)})", "20 bits"),
        (f"nlt = 0 OR (nlt = 1 AND {CAPS(2)}) OR (nlt = 2 AND {CAPS(3)})", "curve"), ("transform <> 1 OR (components >= 3 AND plain)", "colour transform"),
        (f"transform <> 3 OR (components >= 4 AND plain AND cts AND crg AND {CAPS(1)})", "mosaic transform"), ("transform = 3 OR NOT cts", "stray settings"),
        (f"apart = 0 OR (components > 3 AND apart < components AND {CAPS(5)})", "components apart"), (f"({CAPS(4)}) = (sy_most > 1)", "vertical capability"), (f"({CAPS(8)}) = (rl = 1)", "raw capability"),
    ]
)
CODED_SQL = "WITH coded AS (SELECT l_orderkey % 50 AS picture, CAST(l_quantity % 16 AS BIGINT) AS q, l_linenumber % 4 AS d_mode, l_partkey % 900 AS bytes, 700 AS budget FROM lineitem)\n"
PICKED = """
WITH modes(mode, name, readout, height, bits, fps0, mode_hmax) AS (
  VALUES (0, 'FULL_RAW10', 'all', 3556, 10, 30.0, 0), (1, 'FULL_RAW12', 'all', 3556, 12, 30.0, 0), (2, 'BIN2_RAW12', 'bin2x2', 1778, 12, 30.0, 0),
         (3, 'CROP_3552X2160_RAW10', 'crop', 2160, 10, 50.0, 0), (4, 'CROP_1280X720_RAW10', 'crop', 720, 10, 60.0, 0), (5, 'BIN2_RAW12_60', 'bin2x2', 1778, 12, 60.0, 341)
), rates(mbps, h4, h2) AS (VALUES (2376, 318, 628), (2079, 366, 366), (1782, 314, 314), (1440, 628, 628), (1188, 628, 1256), (891, 628, 628), (720, 1256, 1256), (594, 1256, 1256)),
allowed(readout, bits, r) AS (VALUES ('bin2x2', 12, [1782, 891, 594]), ('all', 10, [2376, 1188, 594]), ('crop', 10, [2376, 1188, 594]), ('all', 12, [1440, 720])),
asked AS (
  SELECT o_orderkey AS request, (['FULL_RAW10', 'FULL_RAW12', 'BIN2_RAW12', 'CROP_3552X2160_RAW10', 'CROP_1280X720_RAW10', 'BIN2_RAW12_60', ''])[o_orderkey % 7 + 1] AS name,
         o_custkey % 70 AS fps, CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 4 END AS lanes, 500 + o_orderkey % 2000 AS limit_mbps,
         CASE WHEN o_orderkey % 4 = 0 THEN ([594, 1440, 2376, 1188])[(o_orderkey // 4) % 4 + 1] END AS over_rate, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 700 END AS over_hmax
  FROM orders
), found AS (
  SELECT a.*, m.mode, m.readout, m.height, fps0, mode_hmax, r, list_max(list_filter(r, lambda x: x <= limit_mbps)) AS best FROM asked a LEFT JOIN modes m ON m.name = a.name LEFT JOIN allowed l ON l.readout = m.readout AND l.bits = m.bits
), rated AS (
  SELECT *, coalesce(over_rate, best) AS mbps,
         CASE WHEN mode IS NULL THEN 'unknown mode' WHEN over_rate IS NOT NULL AND NOT (list_contains(r, over_rate) AND over_rate <= limit_mbps) THEN 'lane rate override'
              WHEN coalesce(over_rate, best) IS NULL THEN 'no lane rate' WHEN over_hmax < 100 THEN 'hmax override' ELSE '' END AS error FROM found
), timed AS (
  SELECT d.*, coalesce(over_hmax, CASE WHEN mode_hmax > 0 THEN mode_hmax WHEN lanes = 2 THEN h2 ELSE h4 END) AS hmax, CASE WHEN readout = 'bin2x2' THEN 2 * height ELSE height END + 72 AS least FROM rated d LEFT JOIN rates USING (mbps)
), counted AS (
  SELECT *, CAST(ceil(74.25e6::DOUBLE / (hmax * CASE WHEN fps > 0 THEN fps ELSE fps0 END::DOUBLE)) AS BIGINT) AS n1, CAST(ceil(74.25e6::DOUBLE / (hmax * (5.0 + request % 50)::DOUBLE)) AS BIGINT) AS n2 FROM timed WHERE error = ''
), lined AS (
  SELECT *, least(greatest(n1 + n1 % 2, least), 1048575) AS vmax, least(greatest(n2 + n2 % 2, least), 1048575) AS new_vmax FROM counted
)
SELECT request, mbps, hmax, vmax, new_vmax, 74.25e6::DOUBLE / (hmax::DOUBLE * new_vmax) AS new_fps,
       least(greatest(new_vmax - CAST(round(0.005::DOUBLE / (hmax / 74.25e6::DOUBLE)) AS BIGINT), 8), new_vmax - 2) AS new_shutter, error FROM lined
UNION ALL SELECT request, 0, 0, 0, 0, 0.0, 0, error FROM timed WHERE error <> ''"""
ORACLES = {
    "integrity_counts": PAYLOAD_SQL + INTEGRITY_SQL + "SELECT * FROM checks",
    "verdict_checked": PAYLOAD_SQL + INTEGRITY_SQL + TOTALS.format(span="max(timestamp_s) - min(timestamp_s)", where="") + """
, last AS (SELECT camera, frame_number - lag(frame_number) OVER (PARTITION BY camera ORDER BY arrival) - 1 AS gap FROM frames),
gaps AS (SELECT camera, CAST(coalesce(sum(gap), 0) AS BIGINT) AS gaps FROM last GROUP BY camera),
short AS (SELECT camera, count(*) FILTER (bytes_written > 0 AND bytes_written < frame_size) AS short_frames FROM frames GROUP BY camera),
met AS (
  SELECT p.camera, e, coalesce(fps, 0.0) AS fps, coalesce(gbps, 0.0) AS gbps, coalesce(frames, 0) AS frames, coalesce(bytes, 0) AS bytes, coalesce(gaps, 0) AS gaps, 0 AS dropped_total,
         coalesce(short_frames, 0) AS short_frames, coalesce(crc_checked, 0) AS crc_checked, coalesce(crc_bad, 0) AS crc_bad, coalesce(flat_frames, 0) AS flat_frames
  FROM (SELECT 'cam' || i AS camera, CASE WHEN i = 3 THEN 1e-12::DOUBLE ELSE 1e-3::DOUBLE END AS e FROM range(5) r(i)) p
  LEFT JOIN totals USING (camera) LEFT JOIN gaps USING (camera) LEFT JOIN short USING (camera) LEFT JOIN checks USING (camera)
), told AS (
  SELECT *, CASE WHEN frames = 0 THEN 'no frames' WHEN abs(gbps - e) > 1e6 * e THEN 'rate' WHEN gaps > 1000000000 THEN 'loss' WHEN short_frames > 0 THEN 'short frames'
                 WHEN crc_bad > 0 THEN 'checksums' WHEN flat_frames > 0 THEN 'flat frames' ELSE '' END AS reason FROM met
)
SELECT * EXCLUDE (e), reason = '' AS pass FROM told""",
    "dump_counts": PAYLOAD_SQL + "SELECT camera, least(count(*) // 10, 7) AS frames_dumped FROM frames GROUP BY camera",
    "window_or_run": FRAMES_SQL.replace("FROM events", "FROM events WHERE user_id % 4 <> 3 OR event_id < 40") + TOTALS.format(span="max(timestamp_s) - min(timestamp_s)", where="") + WINDOW,
    "psnr_sites": PLANE_SQL + """
, e AS (
  SELECT plane, CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 'R' WHEN x % 2 = 1 AND y % 2 = 1 THEN 'B' WHEN y % 2 = 0 THEN 'G1' ELSE 'G2' END AS site,
         CASE WHEN x % 2 = 0 THEN v - (v // 16 * 16 + 8) ELSE 0 END AS e FROM plane
) SELECT plane, site, sqrt(avg(e * e)) AS rms, max(abs(e)) AS max_error, max(abs(e)) = 0 AS identical FROM e GROUP BY plane, site""",
    "control_bodies": "SELECT p_partkey, p_partkey::VARCHAR AS fps, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE '-' END AS \"on\" FROM part",
    "status_merge": FRAMES_SQL + """
, s AS (SELECT camera, count(*) AS n, CAST(sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) AS BIGINT) AS b FROM frames GROUP BY camera)
SELECT 'cam' || i AS camera, '{"camera":"cam' || i || '","mode":"FULL_RAW10","gain":' || 10 * i || CASE WHEN n IS NULL THEN '' ELSE ',"frames":' || n || ',"bytes":' || b END || '}' AS status
FROM range(5) r(i) LEFT JOIN s ON s.camera = 'cam' || i""",
    "raw_dump_scan": DUMPS_SQL + "SELECT name, plane, y, x, v FROM plane JOIN named USING (plane)",
    "sidecar_scan": DUMPS_SQL + "SELECT name, camera, plane AS frame_number, 96 * height AS bytes, 64 AS width, height, 12 AS bits, 96 AS line_bytes FROM named",
    "file_listing": DUMPS_SQL + "SELECT name || '.raw' AS name, 96 * height AS size FROM named",
    "listing_filter": """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE WHEN page_id % 5 = 0 THEN '/' ELSE '' END AS path FROM pages),
f AS (SELECT *, path NOT LIKE '%/' AS file, regexp_extract(path, '([^/]*)$', 1) AS base FROM p)
SELECT page_id, file AND contains(lower(path), 'blog') AS by_text, file AND starts_with(base, '1') AS by_prefix, file AND contains(lower(path), '/en') AND starts_with(base, '2') AS by_both, path = 'blog.tionsh.example.com/en/' AS by_name FROM f""",
    "rig_cameras": RIG_CAMERAS,
    "rig_errors": """SELECT s_suppkey AS config, ([2, 1, 0, 2, 2, 3])[s_suppkey % 6 + 1] AS cameras, (['', 'receiver', 'no cameras', 'missing port', 'unknown mode', 'port listed twice'])[s_suppkey % 6 + 1] AS error FROM supplier""",
    "pgx_read": PLANE_SQL + "SELECT * FROM plane",
    "codestream_headers": """
SELECT s_suppkey AS picture, ([4, 3, 5, 6, 3])[s_suppkey % 5 + 1] AS segments, 8 AS pih_at, s_suppkey % 5000 AS width, s_suppkey % 3000 + 1 AS height, 16 AS slice_lines, 4 AS components, 20 AS bw, 8 AS fq, 4 AS br, 3 AS transform, 5 AS nlx, 2 AS nly,
       (['', 'missing segment', 'repeated segment', '', 'length'])[s_suppkey % 5 + 1] AS error FROM supplier""",
    "coding_rules": f"""
WITH h AS (
  SELECT k AS "order", 1 + k % 5 AS components, 4 AS ng, CASE WHEN k % 13 = 0 THEN 7 ELSE 8 END AS ss, (1 + k % 6)::INT AS nlx, (k % 4)::INT AS nly, 1 + k % 2 AS sy_most, 1 + k % 3 % 2 AS sx_most, 0 AS fslc,
         CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS ppoc, k % 4 AS transform, k % 3 AS qpih, k % 2 AS fs, k % 2 AS rm, k % 19 AS slice_lines, 7 + k % 11 AS bits, k % 200 AS width, k % 23 AS height, k % 3 AS cw,
         CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 6 ELSE 8 END AS fq, CASE WHEN k % 3 = 0 THEN 7 + k % 11 WHEN k % 3 = 1 THEN 18 ELSE 20 + k % 2 END AS bw, 4 + k % 2 AS br, k % 5 > 0 AS alike, k % 7 > 0 AS plain,
         k % 3 AS nlt, k % 2 = 1 AS cts, k % 3 > 0 AS crg, k % 3 AS apart, k % 512 AS cap, k % 2 AS rl
  FROM (SELECT o_orderkey AS k FROM orders)
) SELECT "order", concat_ws(', ', {RULES}) AS errors FROM h""",
    "encoder_stats": CODED_SQL + "SELECT picture, min(q) AS min_q, max(q) AS max_q, avg(q) AS mean_q, CAST(sum(greatest(budget - bytes, 0)) AS BIGINT) AS filler_bytes FROM coded GROUP BY picture",
    "mode_histograms": CODED_SQL + "SELECT 'q' AS kind, q AS value, count(*) AS n FROM coded GROUP BY ALL UNION ALL SELECT 'd_mode', d_mode, count(*) FROM coded GROUP BY ALL",
    "console_table": FRAMES_SQL + """
, s AS (SELECT camera, count(*) AS n, CAST(sum(CASE WHEN bytes_written > 0 THEN bytes_written ELSE frame_size END) AS BIGINT) AS b FROM frames GROUP BY camera),
a AS (SELECT * FROM s UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT), CAST(sum(b) AS BIGINT) FROM s) SELECT printf('%-12s %9d %14d', camera, n, b) AS line FROM a""",
    "markdown_captures": """
WITH o AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey), l AS (SELECT l_orderkey, arg_max(l_partkey, l_linenumber * 10000000 + l_partkey) AS p FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey)
SELECT '| `' || c_name || '` | ' || k || ' | ' || coalesce('p' || p, '') || ' |' AS line FROM customer JOIN o ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = k""",
    "timing_overrides": PICKED,
    "capability_bits": "SELECT event_id, (event_id % 512) | (1 << (event_id % 9)::INT) AS flags, (((event_id % 512) | (1 << (event_id % 9)::INT)) >> (event_id % 7)::INT) & 1 = 1 AS has FROM events",
    "yuv_size": "SELECT p_partkey, ((p_partkey % 4000 + 2) * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END + 255) // 256 * 256 * (p_partkey % 2001 + 1 + (p_partkey % 2001 + 1) // 2) AS bytes FROM part",
    "line_luma": PLANE_SQL + """
, parts AS (SELECT plane, y, avg(greatest(v - 2048, 0)) / 16 AS luma, count(*) AS samples FROM plane GROUP BY ALL)
SELECT plane, count(*) AS parts, count(*) FILTER (luma < 0.5) AS black, count(*) FILTER (samples < 64) AS errors, min(luma) AS darkest, max(luma) AS brightest FROM parts GROUP BY plane""",
    "png_crop": PLANE_SQL + "SELECT plane, y - 74 AS y, x - 16 AS x, v FROM plane WHERE x BETWEEN 16 AND 45 AND y BETWEEN 74 AND 173",
    "precinct_bytes": """
SELECT l_orderkey AS precinct, CAST(sum(l_suppkey % 100 + l_linenumber + least(ceil(l_partkey % 17 * 4 / 8), l_orderkey % 3 + l_partkey % 13)) AS BIGINT) AS bytes,
       count(*) FILTER (ceil(l_partkey % 17 * 4 / 8) < l_orderkey % 3 + l_partkey % 13) AS raw_packets FROM lineitem GROUP BY l_orderkey""",
    "nlt_extended": PLANE_SQL + """
, n AS (SELECT plane, y, x, v << 24 AS n FROM plane),
c AS (
  SELECT plane, y, x, CASE WHEN n < 1710720000 THEN 52768 - floor(sqrt(greatest(2784461824 - n, 0)::DOUBLE))::BIGINT WHEN n < 10230400000 THEN (n - 400000000) >> 16
         ELSE 117232 + floor(sqrt(greatest(n - 9156658176, 0)::DOUBLE))::BIGINT END AS c FROM n
), d AS (SELECT *, least(greatest(52768 - c, 0), 262143) AS dark, least(greatest(c - 117232, 0), 262143) AS bright FROM c),
e AS (SELECT *, CASE WHEN c < 20000 THEN 2784461824 - dark * dark WHEN c < 150000 THEN (c << 16) + 400000000 ELSE 9156658176 + bright * bright END AS curve FROM d)
SELECT plane, y, x, c - 131072 AS coefficient, least(greatest((curve + 8388608) >> 24, 0), 4095) AS back FROM e""",
    "stream_tap": FRAMES_SQL + "SELECT camera, arrival, bytes_written FROM frames",
}
