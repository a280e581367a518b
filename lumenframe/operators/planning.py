"""Sensor timing plans from mode and lane-rate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import timing as t
from lumenframe.sources import catalogues as c


#: Least HMAX that a request may ask for.
LEAST_HMAX = 100


def find_mode(requests: DataFrame) -> DataFrame:
    """Requests with the mode that ``mode_name`` names, in any case, or numbers; a broadcast of the six modes."""
    modes = c.modes(requests.sparkSession)
    asked = requests.withColumn("__key", F.upper("mode_name"))
    keys = modes.select(F.explode(F.array("name", F.col("mode").cast("string"))).alias("__key"), *modes.columns)
    return asked.join(F.broadcast(keys), "__key", "left").drop("__key")


def pick_lane_rate(requests: DataFrame) -> DataFrame:
    """The fastest allowed lane rate up to ``limit_mbps``; null if none fits.

    Requests have readout, bits and limit_mbps. The rates are a bounded table, so each request takes the largest
    element of a filtered array and no pairs of rows are made.
    """
    allowed = c.allowed_rates(requests.sparkSession)
    best = F.array_max(F.filter("allowed", lambda r: r <= F.col("limit_mbps")))
    return requests.join(F.broadcast(allowed), ["readout", "bits"], "left").withColumn("mbps", best).drop("allowed")


def plan_timing(requests: DataFrame) -> DataFrame:
    """Lane rate, HMAX, VMAX and frame rate of each request (mode_name, fps, lanes, limit_mbps); errors are told in ``error``.

    Requests may have rate_override, a lane rate that must be allowed and within the limit, and hmax_override, of at least
    LEAST_HMAX; both may be null.
    """
    spark, own = requests.sparkSession, [x for x in ("rate_override", "hmax_override") if x in requests.columns]
    picked = pick_lane_rate(find_mode(requests))
    rate = F.col("rate_override") if "rate_override" in own else F.lit(None).cast("int")
    over = F.col("hmax_override") if "hmax_override" in own else F.lit(None).cast("int")
    picked = picked.join(F.broadcast(c.allowed_rates(spark)), ["readout", "bits"], "left").withColumn("__wrong", rate.isNotNull() & ~F.coalesce(F.array_contains("allowed", rate) & (rate <= F.col("limit_mbps")), F.lit(False)))
    picked = picked.withColumn("mbps", F.coalesce(rate, "mbps")).drop("allowed")
    found = picked.join(F.broadcast(c.lane_rates(spark)), "mbps", "left")
    hmax = F.when(over.isNotNull(), over).when(F.col("mode_hmax") > 0, F.col("mode_hmax")).when(F.col("lanes") == 2, F.col("hmax2")).otherwise(F.col("hmax4"))
    wanted = F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.col("default_fps"))
    error = F.when(F.col("mode").isNull(), "unknown mode").when(~F.col("lanes").isin(2, 4), "lanes").when(F.col("__wrong"), "lane rate override").when(F.col("mbps").isNull(), "no lane rate").when(over < LEAST_HMAX, "hmax override").otherwise("")
    out = found.withColumn("error", error).withColumn("hmax", F.when(F.col("error") == "", hmax).cast("long"))
    out = out.withColumn("vmax", F.when(F.col("error") == "", t.vmax_for(F.col("readout"), F.col("height"), F.col("hmax"), wanted)))
    out = out.drop("__wrong")
    return out.withColumn("planned_fps", t.fps_of(F.col("hmax"), F.col("vmax"))).withColumn("gbps", t.stream_gbps(F.col("width"), F.col("height"), F.col("bits"), F.col("planned_fps")))


def frame_rate_changed(plans: DataFrame, fps: str) -> DataFrame:
    """Plans (readout, height, hmax, exposure_s) with new_vmax, new_fps and new_shutter at another frame rate and the same HMAX."""
    out = plans.withColumn("new_vmax", t.vmax_for(F.col("readout"), F.col("height"), F.col("hmax"), F.col(fps)))
    out = out.withColumn("new_fps", t.fps_of(F.col("hmax"), F.col("new_vmax")))
    return out.withColumn("new_shutter", t.shutter_for(F.col("new_vmax"), F.col("hmax"), F.col("exposure_s")))


def duplicate_ports(cameras: DataFrame) -> DataFrame:
    """Ports that more than one camera names, by connector, label or number, with how many do."""
    ports = c.ports(cameras.sparkSession)
    keys = ports.select(F.explode(F.array("connector", "label", F.col("camera").cast("string"))).alias("__key"), "connector")
    named = cameras.withColumn("__key", F.upper("port")).join(F.broadcast(keys), "__key", "left")
    return named.where("connector IS NOT NULL").groupBy("connector").agg(F.count("*").alias("cameras")).where("cameras > 1")


def registers_to_columns(writes: DataFrame, names: dict[int, str]) -> DataFrame:
    """One row for each device with the last value written to each named register, 0 if none was.

    Of writes with equal seq the larger value counts. ``writes`` has device, seq, address and value. The names are a closed list, so this is one aggregation.
    """
    last = [F.coalesce(F.max(F.when(F.col("address") == a, F.struct("seq", "value")))["value"], F.lit(0)).cast("long").alias(n) for a, n in names.items()]
    return writes.where(F.col("address").isin(*names)).groupBy("device").agg(*last)
