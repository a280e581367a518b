"""Columns for link budgets, sensor timing, exposure and gain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes around a packet's payload, on the wire, and in a page.
PACKET_BYTES, WIRE_BYTES, PAGE_BYTES = 74, 20, 128
# Line clock, blank lines, counter limits, shortest shutter, integration and gain steps.
LINE_CLOCK, BLANK_LINES, MOST_LINES, LEAST_SHUTTER, LEAST_LINES, GAIN_STEPS, STEP_DB = 74.25e6, 72, 1_048_575, 8, 2, 240, 0.3


def payload_per_packet(mtu: Column) -> Column:
    """Whole pages in a packet; an MTU that holds none beside the overhead is an error."""
    pages = F.floor((mtu - PACKET_BYTES) / PAGE_BYTES) * PAGE_BYTES
    return F.when(mtu > PACKET_BYTES, pages.cast("long")).otherwise(F.raise_error(F.lit("MTU too small")).cast("long"))


def link_payload_gbps(link_gbps: Column, mtu: Column) -> Column:
    payload = payload_per_packet(mtu)
    return link_gbps * payload / (payload + PACKET_BYTES + WIRE_BYTES)


def stream_gbps(width: Column, height: Column, bits: Column, fps: Column) -> Column:
    return width.cast("double") * height * bits * fps / 1e9


def packets_per_second(width: Column, height: Column, bits: Column, fps: Column, mtu: Column) -> Column:
    return fps * F.ceil(width.cast("double") * height * bits / 8 / payload_per_packet(mtu))


def fps_within(width: Column, height: Column, bits: Column, gbps: Column) -> Column:
    return gbps * 1e9 / (width.cast("double") * height * bits)


def line_seconds(hmax: Column) -> Column:
    return hmax / F.lit(LINE_CLOCK)


def fps_of(hmax: Column, vmax: Column) -> Column:
    return F.lit(LINE_CLOCK) / (hmax.cast("double") * vmax)


def readout_lines(readout: Column, height: Column) -> Column:
    return F.when(readout == "bin2x2", 2 * height).otherwise(height)


def least_vmax(readout: Column, height: Column) -> Column:
    return readout_lines(readout, height) + BLANK_LINES


def vmax_for(readout: Column, height: Column, hmax: Column, fps: Column) -> Column:
    """Lines for a frame rate, up to an even number, within the limits; rates must be positive."""
    lines = F.ceil(F.lit(LINE_CLOCK) / (hmax * fps))
    within = F.least(F.greatest(lines + lines % 2, least_vmax(readout, height)), F.lit(MOST_LINES)).cast("long")
    return F.when(fps > 0, within).otherwise(F.raise_error(F.lit("frame rate must be positive")).cast("long"))


def shutter_for(vmax: Column, hmax: Column, seconds: Column) -> Column:
    lines = F.round(seconds / line_seconds(hmax)).cast("long")
    return F.least(F.greatest(vmax - lines, F.lit(LEAST_SHUTTER)), vmax - LEAST_LINES).cast("long")


def exposure_seconds(vmax: Column, shutter: Column, hmax: Column) -> Column:
    return F.when(shutter >= vmax, 0.0).otherwise((vmax - shutter) * line_seconds(hmax))


def gain_register(db: Column) -> Column:
    steps = F.least(F.greatest(db, F.lit(0.0)), F.lit(GAIN_STEPS * STEP_DB)) / STEP_DB
    return F.least(F.round(steps), F.lit(float(GAIN_STEPS))).cast("long")


def black_level(bits: Column) -> Column:
    return F.when(bits == 12, 200).otherwise(50)


def line_stride(width: Column, bits: Column) -> Column:
    """Bytes of a packed line, up to a multiple of eight."""
    return (F.ceil(F.floor(width * bits / 8) / 8) * 8).cast("long")


def halved_size(width: Column, height: Column, target: Column) -> tuple[Column, Column]:
    """Even size of a preview no wider than target, at least 2; the same size if target is 0 or isn't smaller."""
    even = lambda x: (F.floor(x / 2) * 2).cast("long")
    w = F.greatest(even(target), F.lit(2))
    h = F.greatest(even(F.floor(height * w / width)), F.lit(2))
    same = (target <= 0) | (target >= width)
    return F.when(same, width).otherwise(w).cast("long"), F.when(same, height).otherwise(h).cast("long")


def yuv_bytes(width: Column, height: Column, bits: Column, align: int = 256) -> Column:
    """Bytes of a 4:2:0 picture: a pitch of one or two bytes for each luma sample, aligned, over the luma and half as many lines."""
    pitch = F.ceil(width * F.when(bits > 8, 2).otherwise(1) / float(align)) * align
    return (pitch * (height + F.floor(height / 2))).cast("long")
