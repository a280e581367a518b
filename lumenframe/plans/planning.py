"""Queries on link budgets, timing plans, settings and joins. Orders and events stand in for requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import strings as s_
from lumenframe.functions import timing as t
from lumenframe.operators import joins, planning
from lumenframe.sources import catalogues as c
from lumenframe.sources.tables import FRAMES_SQL, frames, table

NAMES = ["FULL_RAW10", "full_raw12", "Bin2_RAW12", "3", "CROP_1280X720_RAW10", "BIN2_RAW12_60", "BIN2_RAW10"]
REGISTERS = {0x3028: "vmax_low", 0x302C: "hmax_low", 0x3018: "winmode", 0x301B: "addmode"}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pick = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("o_orderkey") % len(NAMES) + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("request"),
        pick.alias("mode_name"),
        ((F.col("o_custkey") % 70) / 1.0).alias("fps"),
        F.when(F.col("o_custkey") % 3 == 0, 2).otherwise(4).alias("lanes"),
        (500 + F.col("o_orderkey") % 2000).cast("int").alias("limit_mbps"),
    )


def link_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (1000 + F.col("event_id") % 8001).alias("mtu"), (1 + F.col("user_id") % 10).cast("double").alias("link"))
    w, h, bits = F.lit(3552), F.lit(3556), F.lit(10)
    mtu, link = F.col("mtu"), F.col("link")
    budget = t.link_payload_gbps(link, mtu)
    return e.select("event_id", t.payload_per_packet(mtu).alias("payload"), budget.alias("gbps"), t.fps_within(w, h, bits, budget).alias("max_fps"), t.packets_per_second(w, h, bits, F.lit(30.0), mtu).alias("packets"))


def plan_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_timing(requests(spark, sf_dir)).select("request", "name", "mbps", "hmax", "vmax", "planned_fps", "gbps", "error").fillna("", ["name"]).fillna(0, ["mbps", "hmax", "vmax"]).fillna(0.0, ["planned_fps", "gbps"])


def lane_rate_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir).select("request", "limit_mbps", F.lit("crop").alias("readout"), F.when(F.col("request") % 2 == 0, 10).otherwise(12).alias("bits"))
    return planning.pick_lane_rate(asked).select("request", F.coalesce("mbps", F.lit(0)).alias("mbps"))


def exposure_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (3630 + F.col("user_id") * 2).alias("vmax"), F.lit(628).alias("hmax"), (F.col("value") / 1e4).alias("seconds"), (F.col("value") / 5 - 3).alias("db"))
    shutter = t.shutter_for(F.col("vmax"), F.col("hmax"), F.col("seconds"))
    return e.select("event_id", shutter.alias("shutter"), t.exposure_seconds(F.col("vmax"), shutter, F.col("hmax")).alias("exposure_s"), t.gain_register(F.col("db")).alias("gain"))


def mode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.find_mode(requests(spark, sf_dir)).groupBy("mode_name").agg(F.count("*").alias("requests"), F.coalesce(F.max("mode"), F.lit(-1)).alias("mode"))


def dup_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("j1a", "CAM2", "cam3", "2", "J1D", "J9")])
    e = table(spark, sf_dir, "events").select(F.element_at(names, (F.col("user_id") % 6 + 1).cast("int")).alias("port"))
    return planning.duplicate_ports(e)


def preview_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (640 + F.col("p_partkey") % 3000).alias("w"), (480 + F.col("p_partkey") % 2000).alias("h"), (F.col("p_size") * 40 - 40).alias("target"))
    w, h = t.halved_size(F.col("w"), F.col("h"), F.col("target"))
    return p.select("p_partkey", w.alias("width"), h.alias("height"), t.line_stride(F.col("w"), F.lit(10)).alias("stride"))


def register_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.element_at(F.array(*[F.lit(a) for a in [*REGISTERS, 0x3000]]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    writes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("device"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), address.alias("address"), F.col("l_quantity").cast("long").alias("value"))
    return planning.registers_to_columns(writes, REGISTERS)


def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    ends = f.where("arrival % 3 <> 0").select("camera", "arrival")
    marks = f.where("arrival % 3 = 0").select("camera", F.col("arrival").alias("mark"), F.col("bytes_written").alias("t"))
    return joins.asof_forward(ends, marks, "camera", "arrival", "mark", "t", width=1000)


def catalog_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    last = joins.newest(orders, "o_custkey", "o_orderkey")
    met = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("last_order"), F.coalesce("o_totalprice", F.lit(0.0)).alias("price"))


def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("value"))
    return joins.overridden(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0").withColumn("value", F.col("value") + 100), p.where("p_partkey % 5 = 0").withColumn("value", F.col("value") + 1000), "p_partkey")


def fan_in_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("camera", "event_type", "arrival", "bytes_written")
    return joins.fan_in([f.where(F.col("camera") == f"cam{i}").drop("camera") for i in range(4)], "event_type", "arrival", "bytes_written")


def settings_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("on", "OFF", "yes", "0", "1.5", "-3e2", "4x", "", "True")])
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(words, (F.col("event_id") % 9 + 1).cast("int")).alias("word"))
    flag, number = s_.parse_bool(F.col("word")), s_.parse_number(F.col("word"))
    return e.select("event_id", F.coalesce(flag.cast("string"), F.lit("?")).alias("flag"), F.coalesce(number, F.lit(-1.0)).alias("number"))


def control_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") - 10).alias("fps"), (F.col("event_id") % 1100).alias("black"), (F.col("user_id") % 40).alias("pattern"))
    checks = (F.col("fps") > 0, "fps must be positive"), (F.col("black").between(0, 1023), "black level 0..1023"), (F.col("pattern").between(0, 31), "pattern 0..31")
    return e.select("event_id", s_.errors(*checks).alias("error"))


def paths_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    end = F.element_at(F.array(*[F.lit(x) for x in (".html", "/../x.PNG", ".jpg", "", ".json")]), (F.col("page_id") % 5 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(url, "[?#].*$", ""), end).alias("path"))
    return p.select("page_id", s_.content_type(F.col("path")).alias("kind"), s_.path_ok(F.col("path")).alias("ok"))


def form_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("fps="), F.col("p_size").cast("string"), F.lit("&name="), F.url_encode("p_name"), F.lit("&gain="), F.col("p_partkey").cast("string"))
    fields = table(spark, sf_dir, "part").select("p_partkey", s_.form_fields(body).alias("f"))
    return fields.select("p_partkey", F.col("f")["fps"].cast("int").alias("fps"), F.col("f")["name"].alias("name"), F.col("f")["gain"].cast("long").alias("gain"))


def marker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((65296 + F.col("event_id") % 70).cast("int").alias("code"))
    met = e.groupBy("code").agg(F.count("*").alias("n")).join(F.broadcast(c.markers(spark)), "code", "left")
    high, low = F.shiftright("code", 8), F.col("code").bitwiseAND(255)
    return met.select("code", "n", F.coalesce("marker", F.lit("?")).alias("marker"), ((high == 255) & ~low.isin(0, 255)).alias("is_marker"))


QUERIES = {
    f.__name__: f
    for f in (
        link_budget, plan_timing, lane_rate_pick, exposure_gain, mode_lookup, dup_ports, preview_size, register_pivot, asof_forward,
        catalog_left_join, override_merge, fan_in_union, settings_parse, control_checks, paths_and_types, form_parse, marker_names,
    )
}

MODES_SQL = "(VALUES " + ", ".join(f"({m},'{n}','{r}',{w},{h},{b},{f}::DOUBLE,{x})" for m, n, r, w, h, b, f, _, x in c.MODES) + ") m(mode, name, readout, width, height, bits, default_fps, mode_hmax)"
RATES_SQL = "(VALUES " + ", ".join(f"('{r}',{b},{x})" for r, b, rates in c.ALLOWED for x in rates) + ") a(readout, bits, mbps)"
LANES_SQL = "(VALUES " + ", ".join(f"({a},{b},{d})" for a, b, d in c.LANE_RATES) + ") l(mbps, hmax4, hmax2)"
REQUESTS_SQL = f"""
WITH requests AS (
  SELECT o_orderkey AS request, [{", ".join(f"'{n}'" for n in NAMES)}][o_orderkey % {len(NAMES)} + 1] AS mode_name, (o_custkey % 70)::DOUBLE AS fps,
         CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 4 END AS lanes, 500 + o_orderkey % 2000 AS limit_mbps
  FROM orders
)
"""
PAYLOAD = "((1000 + event_id % 8001 - 74) // 128 * 128)"
SHUTTER = "least(greatest(vmax - CAST(round(seconds / (628 / 74250000.0::DOUBLE)) AS BIGINT), 8), vmax - 2)"
ORACLES = {
    "link_budget": f"""
WITH p AS (SELECT event_id, {PAYLOAD} AS payload, (1 + user_id % 10)::DOUBLE AS link FROM events),
q AS (SELECT *, link * payload / (payload + 94) AS gbps FROM p)
SELECT event_id, payload, gbps, gbps * 1e9 / (3552::DOUBLE * 3556 * 10) AS max_fps, 30.0::DOUBLE * ceil(3552::DOUBLE * 3556 * 10 / 8 / payload) AS packets FROM q""",
    "plan_timing": REQUESTS_SQL + f"""
, found AS (SELECT r.*, m.* FROM requests r LEFT JOIN {MODES_SQL} ON upper(mode_name) = name OR mode_name = mode::VARCHAR),
picked AS (SELECT f.*, (SELECT max(mbps) FROM {RATES_SQL} WHERE a.readout = f.readout AND a.bits = f.bits AND a.mbps <= f.limit_mbps) AS mbps FROM found f),
timed AS (
  SELECT p.*, CASE WHEN mode IS NULL THEN 'unknown mode' WHEN p.mbps IS NULL THEN 'no lane rate' ELSE '' END AS error,
         CASE WHEN mode_hmax > 0 THEN mode_hmax WHEN lanes = 2 THEN hmax2 ELSE hmax4 END AS h,
         CASE WHEN fps > 0 THEN fps ELSE default_fps END AS wanted
  FROM picked p LEFT JOIN {LANES_SQL} ON l.mbps = p.mbps
), lines AS (
  SELECT *, CASE WHEN error = '' THEN h END AS hmax, CAST(ceil(74250000.0::DOUBLE / (h * wanted)) AS BIGINT) AS n FROM timed
), full_plan AS (
  SELECT *, CASE WHEN error = '' THEN least(greatest(n + n % 2, CASE WHEN readout = 'bin2x2' THEN 2 * height ELSE height END + 72), 1048575) END AS vmax FROM lines
), rated AS (SELECT *, 74250000.0::DOUBLE / (hmax::DOUBLE * vmax) AS planned_fps FROM full_plan)
SELECT request, coalesce(name, '') AS name, coalesce(mbps, 0) AS mbps, coalesce(hmax, 0) AS hmax, coalesce(vmax, 0) AS vmax,
       coalesce(planned_fps, 0.0) AS planned_fps, coalesce(width::DOUBLE * height * bits * planned_fps / 1e9, 0.0) AS gbps, error
FROM rated""",
    "lane_rate_pick": REQUESTS_SQL + f"""
SELECT request, coalesce((SELECT max(mbps) FROM {RATES_SQL} WHERE readout = 'crop' AND bits = CASE WHEN request % 2 = 0 THEN 10 ELSE 12 END AND mbps <= limit_mbps), 0) AS mbps FROM requests""",
    "exposure_gain": f"""
WITH e AS (SELECT event_id, 3630 + user_id * 2 AS vmax, value / 1e4 AS seconds, value / 5 - 3 AS db FROM events),
s AS (SELECT *, {SHUTTER} AS shutter FROM e)
SELECT event_id, shutter, CASE WHEN shutter >= vmax THEN 0.0::DOUBLE ELSE (vmax - shutter) * (628 / 74250000.0::DOUBLE) END AS exposure_s,
       CAST(least(round(least(greatest(db, 0.0), 240 * 0.3::DOUBLE) / 0.3::DOUBLE), 240) AS BIGINT) AS gain FROM s""",
    "mode_lookup": REQUESTS_SQL + f"SELECT mode_name, count(*) AS requests, coalesce(max(mode), -1) AS mode FROM requests LEFT JOIN {MODES_SQL} ON upper(mode_name) = name OR mode_name = mode::VARCHAR GROUP BY mode_name",
    "dup_ports": """
WITH named AS (SELECT upper(['j1a','CAM2','cam3','2','J1D','J9'][user_id % 6 + 1]) AS port FROM events),
ports AS (SELECT * FROM (VALUES (0,'J1A','CAM1'),(1,'J1B','CAM2'),(2,'J1C','CAM3'),(3,'J1D','CAM4')) p(camera, connector, label))
SELECT connector, count(*) AS cameras FROM named JOIN ports ON port IN (connector, label, camera::VARCHAR) GROUP BY connector HAVING count(*) > 1""",
    "preview_size": """
WITH p AS (SELECT p_partkey, 640 + p_partkey % 3000 AS w, 480 + p_partkey % 2000 AS h, p_size * 40 - 40 AS target FROM part),
q AS (SELECT *, greatest(target // 2 * 2, 2) AS dw FROM p)
SELECT p_partkey, CASE WHEN target <= 0 OR target >= w THEN w ELSE dw END AS width,
       CASE WHEN target <= 0 OR target >= w THEN h ELSE greatest((h * dw // w) // 2 * 2, 2) END AS height,
       ((w * 10 // 8) + 7) // 8 * 8 AS stride FROM q""",
    "register_pivot": """
WITH writes AS (SELECT l_suppkey AS device, l_orderkey * 10 + l_linenumber AS seq, [12328, 12332, 12312, 12315, 12288][l_linenumber % 5 + 1] AS address, l_quantity::BIGINT AS value FROM lineitem)
SELECT device, coalesce(arg_max(value, seq * 1000 + value) FILTER (address = 12328), 0) AS vmax_low, coalesce(arg_max(value, seq * 1000 + value) FILTER (address = 12332), 0) AS hmax_low,
       coalesce(arg_max(value, seq * 1000 + value) FILTER (address = 12312), 0) AS winmode, coalesce(arg_max(value, seq * 1000 + value) FILTER (address = 12315), 0) AS addmode
FROM writes WHERE address <> 12288 GROUP BY device""",
    "asof_forward": FRAMES_SQL + """
, marks AS (SELECT camera, arrival AS mark, bytes_written::DOUBLE AS t FROM frames WHERE arrival % 3 = 0),
lasts AS (SELECT camera, arg_max(t, mark) AS last_t FROM marks GROUP BY camera)
SELECT e.camera, e.arrival, coalesce(m.t, last_t, 0.0) AS t
FROM (SELECT camera, arrival FROM frames WHERE arrival % 3 <> 0) e ASOF LEFT JOIN marks m ON e.camera = m.camera AND e.arrival <= m.mark LEFT JOIN lasts l ON l.camera = e.camera""",
    "catalog_left_join": """
WITH last AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(k, -1) AS last_order, coalesce(price, 0.0) AS price FROM customer LEFT JOIN last ON c_custkey = o_custkey""",
    "override_merge": """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1000 WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS value
FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0""",
    "fan_in_union": FRAMES_SQL + "SELECT event_type, arg_max(bytes_written, arrival) AS bytes_written, count(*) AS rows FROM frames GROUP BY event_type",
    "settings_parse": """
WITH w AS (SELECT event_id, ['on','OFF','yes','0','1.5','-3e2','4x','','True'][event_id % 9 + 1] AS word FROM events)
SELECT event_id, CASE WHEN lower(word) IN ('1','true','on','yes') THEN 'true' WHEN lower(word) IN ('0','false','off','no') THEN 'false' ELSE '?' END AS flag,
       coalesce(TRY_CAST(word AS DOUBLE), -1.0) AS number FROM w""",
    "control_checks": """
SELECT event_id, concat_ws('; ', CASE WHEN NOT value - 10 > 0 THEN 'fps must be positive' END, CASE WHEN event_id % 1100 > 1023 THEN 'black level 0..1023' END,
       CASE WHEN user_id % 40 > 31 THEN 'pattern 0..31' END) AS error FROM events""",
    "paths_and_types": """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') || ['.html','/../x.PNG','.jpg','','.json'][page_id % 5 + 1] AS path FROM pages),
q AS (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM p)
SELECT page_id, CASE e WHEN 'html' THEN 'text/html' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'json' THEN 'application/json'
       WHEN 'csv' THEN 'text/csv' ELSE 'application/octet-stream' END AS kind, NOT (contains(path, '..') OR starts_with(path, '/') OR contains(path, '\\')) AS ok FROM q""",
    "form_parse": "SELECT p_partkey, p_size AS fps, p_name AS name, p_partkey AS gain FROM part",
    "marker_names": "WITH e AS (SELECT CAST(65296 + event_id % 70 AS INT) AS code, count(*) AS n FROM events GROUP BY 1) SELECT code, n, coalesce(marker, '?') AS marker, code >> 8 = 255 AND code & 255 NOT IN (0, 255) AS is_marker FROM e LEFT JOIN (VALUES "
    + ", ".join(f"({a},'{b}')" for a, b in c.MARKERS)
    + ") k(code, marker) USING (code)",
}
