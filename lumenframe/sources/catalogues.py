"""Fixed dimension tables of sensors, boards and codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sensor modes as (mode, name, readout, width, height, bits, default fps, window, hmax).
MODES = [
    (0, "FULL_RAW10", "all", 3552, 3556, 10, 30.0, None, 0),
    (1, "FULL_RAW12", "all", 3552, 3556, 12, 30.0, None, 0),
    (2, "BIN2_RAW12", "bin2x2", 1776, 1778, 12, 30.0, None, 0),
    (3, "CROP_3552X2160_RAW10", "crop", 3552, 2160, 10, 50.0, [0, 3552, 698, 2160], 0),
    (4, "CROP_1280X720_RAW10", "crop", 1280, 720, 10, 60.0, [1136, 1280, 1418, 720], 0),
    (5, "BIN2_RAW12_60", "bin2x2", 1776, 1778, 12, 60.0, None, 341),
]
# Lane rates in Mbps with the HMAX of four and of two lanes.
LANE_RATES = [(2376, 318, 628), (2079, 366, 366), (1782, 314, 314), (1440, 628, 628), (1188, 628, 1256), (891, 628, 628), (720, 1256, 1256), (594, 1256, 1256)]
# Lane rates that a readout and bit depth allow.
ALLOWED = [("bin2x2", 12, [1782, 891, 594]), ("bin2x2", 10, [1782, 891, 594]), ("all", 10, [2376, 1188, 594]), ("crop", 10, [2376, 1188, 594]), ("all", 12, [1440, 720]), ("crop", 12, [1440, 720])]
# Board connectors.
PORTS = [(0, "J1A", "CAM1"), (1, "J1B", "CAM2"), (2, "J1C", "CAM3"), (3, "J1D", "CAM4")]
# Codestream marker codes, as ISO/IEC 21122-1 has them.
MARKERS = [
    (0xFF10, "SOC"), (0xFF11, "EOC"), (0xFF12, "PIH"), (0xFF13, "CDT"), (0xFF14, "WGT"), (0xFF15, "COM"), (0xFF16, "NLT"), (0xFF17, "CWD"),
    (0xFF18, "CTS"), (0xFF19, "CRG"), (0xFF1A, "TPC"), (0xFF1B, "WGR"), (0xFF20, "SLH"), (0xFF21, "SLI"), (0xFF50, "CAP"),
]


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "mode int, name string, readout string, width int, height int, bits int, default_fps double, window array<int>, mode_hmax int")


def lane_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANE_RATES, "mbps int, hmax4 int, hmax2 int")


def allowed_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALLOWED, "readout string, bits int, allowed array<int>")


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORTS, "camera int, connector string, label string")


def markers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKERS, "code int, marker string")
