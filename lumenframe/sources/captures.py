"""Raw frame dumps with JSON sidecars in a folder that all executors share, listings of such folders, and rig configurations."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources.blobs import unpack_depths
from lumenframe.sources.catalogues import modes, ports

SIDECAR = "camera string, frame_number long, bytes long, crc long, file string, width int, height int, bits int, line_bytes int, start_byte int"
#: Lengths of packed lines are told apart; these bit depths can be unpacked.
DEPTHS = (10, 12)


def dump_name(camera: Column, dump: Column, frame_number: Column) -> Column:
    """Counted by dumps, as some senders leave the frame number at 0."""
    return F.format_string("%s_%03d_f%06d", camera, dump, F.greatest(frame_number, F.lit(0)))


def write_dumps(frames: DataFrame, folder: str) -> DataFrame:
    """(name, bytes) of frames (camera, dump, frame_number, crc, data, settings), each written as NAME.raw and NAME.json.

    ``settings`` is a JSON object whose members the sidecar begins with. Tasks write their own rows, one at a time; a task
    that runs again writes the same files again.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for b in batches:
            sizes = []
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                path = f"{base}/{r['name']}"
                with files.open_output_stream(f"{path}.raw") as out:
                    out.write(r["data"])
                side = json.loads(r["settings"] or "{}") | {"camera": r["camera"], "frame_number": r["frame_number"], "bytes": len(r["data"]), "crc": r["crc"], "file": f"{path}.raw"}
                with files.open_output_stream(f"{path}.json") as out:
                    out.write(json.dumps(side).encode())
                sizes.append(len(r["data"]))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(sizes, pa.int64())], ["name", "bytes"])

    named = frames.select(dump_name(F.col("camera"), F.col("dump"), F.col("frame_number")).alias("name"), "camera", "frame_number", "crc", "data", "settings")
    return named.mapInArrow(write, "name string, bytes long")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(name, SIDECAR) of the sidecars in a folder, by a scan with a fixed schema."""
    found = spark.read.schema(SIDECAR).option("multiLine", True).option("pathGlobFilter", "*_f*.json").json(folder)
    return found.withColumn("name", base_name(F.input_file_name()))


def raw_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(name, camera, frame_number, y, px) of all dumps of a folder; a file shorter than its sidecar says is an error."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(folder).select(base_name("path").alias("name"), "content")
    met = sidecars(spark, folder).join(content, "name")
    start, line = F.coalesce("start_byte", F.lit(0)), F.col("line_bytes")
    needed = start + line * F.col("height")
    whole = F.when(F.octet_length("content") >= needed, F.col("content")).otherwise(F.raise_error(F.concat("name", F.lit(" is cut short"))).cast("binary"))
    numbers = F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")
    data = F.expr("substring(content, coalesce(start_byte, 0) + 1 + y * line_bytes, line_bytes)")
    lines = met.withColumn("content", whole).select("*", numbers).select("name", "camera", "frame_number", "bits", "width", "y", data.alias("px"))
    return unpack_depths(lines, "px", "bits", DEPTHS).select("name", "camera", "frame_number", "y", F.slice("px", 1, F.col("width")).alias("px"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, modified) of a folder's files; their content isn't read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def newest_first(files: DataFrame, most: int) -> DataFrame:
    """The ``most`` files changed last, the newest first."""
    return files.orderBy(F.desc("modified"), "name").limit(most)


def listed(path: Column, text: str | None = None, prefix: str | None = None, exact: str | None = None) -> Column:
    """Whether a listing shows a member: one that holds a text in any case, whose file name begins so, or that is named so.

    Folders, whose names end with a slash, are only found by their exact name.
    """
    file, ok = ~path.endswith("/"), F.lit(True)
    if text is not None:
        ok = ok & file & F.lower(path).contains(text.lower())
    if prefix is not None:
        ok = ok & file & F.regexp_extract(path, r"([^/]*)$", 1).startswith(prefix)
    return ok & (path == exact) if exact is not None else ok


CAMERA = "port string, mode string, fps double, lanes int, exposure_ms double, gain_db double, test_pattern boolean, test_pattern_select int, lane_rate_mbps int, hmax int"
RIG = f"receiver string, ibv_name string, ibv_port int, cuda_device int, lane_rate_limit_mbps int, leading_lines int, reset_board boolean, report_interval_s double, p22 struct<enabled:boolean,expander_address:int>, cameras array<struct<{CAMERA.replace(' ', ':').replace(',:', ',')}>>"
# What a camera and a rig have where their configuration says nothing.
CAMERA_DEFAULTS = {"mode": "FULL_RAW12", "fps": 0.0, "lanes": 4, "exposure_ms": 10.0, "gain_db": 0.0, "test_pattern": False, "test_pattern_select": 0}
RIG_DEFAULTS = {"board_ip": "192.168.0.2", "receiver": "roce", "ibv_name": "", "ibv_port": 1, "cuda_device": 0, "lane_rate_limit_mbps": 1500, "leading_lines": 0, "board_required": True, "reset_board": True, "report_interval_s": 2.0}
#: How the keys look that tell of the board, whatever its product is called: its address, and whether it must be there.
BOARD_KEYS = {"board_ip": r"_ip$", "board_required": r"^require_"}
# The same of the port expander.
EXPANDER_DEFAULTS = {"enabled": True, "expander_address": 0x20}


def rig_cameras(configs: DataFrame) -> DataFrame:
    """A row for each camera of the rigs (config, json), with defaults; a rig without cameras has one row, without a port."""
    parsed = configs.select("config", F.from_json("json", RIG).alias("r"), F.from_json("json", "map<string,string>").alias("m"))
    told = {k: F.expr(f"get(map_values(map_filter(m, (k, v) -> k RLIKE '{p}')), 0)") for k, p in BOARD_KEYS.items()}
    board = {"board_ip": told["board_ip"], "board_required": told["board_required"].cast("boolean")}
    rig = [F.coalesce(board[k] if k in board else F.col("r")[k], F.lit(v)).alias(k) for k, v in RIG_DEFAULTS.items()]
    rig += [F.coalesce(F.col("r.p22")[k], F.lit(v)).alias(f"p22_{k}") for k, v in EXPANDER_DEFAULTS.items()]
    cams = parsed.select("config", *rig, F.posexplode_outer("r.cameras").alias("camera", "c"))
    own = [F.coalesce(F.col("c")[k], F.lit(CAMERA_DEFAULTS[k])).alias(k) if k in CAMERA_DEFAULTS else F.col("c")[k].alias(k) for k in (x.split()[0] for x in CAMERA.split(", "))]
    named = ports(configs.sparkSession).select(F.explode(F.array("connector", "label", F.col("camera").cast("string"))).alias("key"), "connector")
    known = modes(configs.sparkSession).select(F.explode(F.array("name", F.col("mode").cast("string"))).alias("key"), F.col("name").alias("mode_name"))
    met = cams.select("config", *RIG_DEFAULTS, *[f"p22_{k}" for k in EXPANDER_DEFAULTS], "camera", *own)
    met = met.join(F.broadcast(named), F.upper("port") == F.col("key"), "left").drop("key")
    return met.join(F.broadcast(known), F.upper("mode") == F.col("key"), "left").drop("key")


def rig_errors(configs: DataFrame) -> DataFrame:
    """(config, cameras, error): the first thing wrong with each rig, empty if nothing is."""
    cams = rig_cameras(configs)
    twice = cams.where("connector IS NOT NULL").groupBy("config", "connector").agg(F.count("*").alias("n")).where("n > 1").groupBy("config").agg(F.min("connector").alias("twice"))
    wrong = F.when(F.col("port").isNull(), "missing port").when(F.col("connector").isNull(), "unknown port").when(F.col("mode_name").isNull(), "unknown mode")
    first = F.min(F.when(wrong.isNotNull(), F.struct("camera", wrong.alias("error"))))["error"]
    each = cams.groupBy("config").agg(F.min("receiver").alias("receiver"), F.count("camera").alias("cameras"), first.alias("camera_error"))
    met = each.join(twice, "config", "left")
    error = F.when(~F.col("receiver").isin("roce", "linux"), "receiver").when(F.col("cameras") == 0, "no cameras").when(F.col("camera_error").isNotNull(), F.col("camera_error")).when(F.col("twice").isNotNull(), "port listed twice").otherwise("")
    return met.select("config", "cameras", error.alias("error"))
