"""Link and sensor arithmetic against known vectors."""

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import timing as t
from lumenframe.operators import planning


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("mtu", "payload"), [(1500, 1408), (4200, 4096), (9000, 8832)])
def test_payload(spark, mtu, payload):
    assert value(spark, t.payload_per_packet(F.lit(mtu))) == payload


def test_small_mtu_is_an_error(spark):
    with pytest.raises(Exception, match="MTU too small"):
        value(spark, t.payload_per_packet(F.col("id") + 74))


def test_links(spark):
    assert value(spark, t.link_payload_gbps(F.lit(10.0), F.lit(1500))) == pytest.approx(9.37, abs=0.01)
    assert value(spark, t.stream_gbps(F.lit(3552), F.lit(3552), F.lit(10), F.lit(40.0))) == pytest.approx(5.047, abs=0.001)
    assert value(spark, t.fps_within(F.lit(3552), F.lit(3552), F.lit(10), F.lit(5.5))) == pytest.approx(43.6, abs=0.05)


@pytest.mark.parametrize(("seconds", "shutter"), [(0.010, 3942 - 1182), (10.0, 8), (0.0, 3940)])
def test_shutter(spark, seconds, shutter):
    assert value(spark, t.shutter_for(F.lit(3942), F.lit(628), F.lit(seconds))) == shutter


@pytest.mark.parametrize(("db", "register"), [(12.0, 40), (72.0, 240), (100.0, 240), (-3.0, 0)])
def test_gain(spark, db, register):
    assert value(spark, t.gain_register(F.lit(db))) == register


def test_plans(spark):
    asked = [("FULL_RAW12", 30.0, 4, 1500), ("FULL_RAW10", 60.0, 4, 1500), ("BIN2_RAW12_60", 60.0, 4, 1500), ("FULL_RAW12", 30.0, 4, 700), ("BIN2_RAW10", 1.0, 4, 1500)]
    plan = [r for r in planning.plan_timing(spark.createDataFrame(asked, "mode_name string, fps double, lanes int, limit_mbps int")).collect()]
    by = {(r.mode_name, r.limit_mbps): r for r in plan}
    full12, full10, binned = by["FULL_RAW12", 1500], by["FULL_RAW10", 1500], by["BIN2_RAW12_60", 1500]
    assert (full12.mbps, full12.hmax, full12.vmax % 2) == (1440, 628, 0)
    assert full12.planned_fps == pytest.approx(30, abs=0.02)
    assert full10.vmax == 3628 and full10.planned_fps == pytest.approx(32.59, abs=0.05)
    assert (binned.mbps, binned.hmax, binned.vmax) == (891, 341, 3630)
    assert by["FULL_RAW12", 700].error == "no lane rate" and by["BIN2_RAW10", 1500].error == "unknown mode"


def test_ports_under_two_names(spark):
    got = planning.duplicate_ports(spark.createDataFrame([("J1A",), ("cam1",), ("J1B",)], "port string")).collect()
    assert [(r.connector, r.cameras) for r in got] == [("J1A", 2)]
