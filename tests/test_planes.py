"""Transforms, codes and packed bytes against known vectors and round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.operators import wavelet as w
from lumenframe.sources import blobs


def line(spark, values):
    return spark.createDataFrame([(0, 0, x, v) for x, v in enumerate(values)], "plane long, y long, x long, v long")


def values(df):
    return [r.v for r in df.orderBy("y", "x").collect()]


def test_inverse_lifting_vector(spark):
    low, high = [100, -37, 5, 1200], [-8, 13, 0]
    mixed = [v for pair in zip(low, [*high, None]) for v in pair if v is not None]
    assert values(w.lifted(line(spark, mixed), "x", ["plane", "y"], inverse=True)) == [104, 25, -38, -5, 2, 601, 1200]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 17])
def test_lifting_round_trip(spark, n):
    v = np.random.default_rng(n).integers(-4000, 4000, n).tolist()
    there = w.lifted(line(spark, v), "x", ["plane", "y"])
    assert values(w.lifted(there, "x", ["plane", "y"], inverse=True)) == v


@pytest.mark.parametrize(("group", "planes"), [([0, 0, 0, 0], 0), ([1, 0, 0, 0], 1), ([0, -1, 0, 0], 1), ([3, -4, 2, 1], 3), ([0, 0, -32768, 5], 16), ([16383, 2], 14)])
def test_bit_planes(spark, group, planes):
    assert w.bit_planes(line(spark, group), ["plane", "y"]).first().planes == planes


@pytest.mark.parametrize(("x", "bits"), [(-1, 2), (1, 3), (-2, 4), (3, 6)])
def test_code_length(spark, x, bits):
    assert spark.range(1).select(w.code_length(F.lit(x), F.lit(7), F.lit(5)).alias("v")).first().v == bits


def test_code_of_too_small_a_residual_is_an_error(spark):
    with pytest.raises(Exception, match="below -theta"):
        spark.range(1).select(w.code_length(F.col("id") - 3, F.lit(7), F.lit(5)).alias("v")).collect()


@pytest.mark.parametrize("uniform", [False, True])
def test_quantisation_error_is_below_a_step(spark, uniform):
    cells = spark.range(4096).select(F.col("id").alias("m"), F.lit(12).cast("long").alias("planes"), F.lit(4).cast("long").alias("cut"))
    q = cells.withColumn("q", w.quantised(F.col("m"), F.col("planes"), F.col("cut"), uniform))
    off = q.select(F.abs(F.col("m") - w.dequantised(F.col("q"), F.col("planes"), F.col("cut"), uniform)).alias("e")).agg(F.max("e")).first()[0]
    assert off <= 16


def test_jamcrc_vectors(spark):
    rows = spark.createDataFrame([("123456789",), ("",)], "s string").select(blobs.jamcrc(F.col("s").cast("binary")).alias("c"))
    assert sorted(r.c for r in rows.collect()) == [0x340BC6D9, 0xFFFFFFFF]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.sampled_from([10, 12]), st.randoms())
def test_packing_round_trip(lines, runs, bits, random):
    n = runs * (4 if bits == 10 else 2)
    v = np.array([[random.randrange(1 << bits) for _ in range(n)] for _ in range(lines)], np.int32)
    assert (blobs.unpacked(blobs.packed(v, bits), bits) == v).all()


def test_ivf_frames_and_bad_files():
    frames = [(1000, b"abcd"), (2000, b"xyz"), (3000, b"")]
    whole = blobs.ivf_bytes(frames, b"AV01", 8, 8)
    assert [(p, d) for _, p, d in blobs.ivf_frames(whole)] == frames
    assert [(p, d) for _, p, d in blobs.ivf_frames(whole[:-14])] == frames[:1]
    with pytest.raises(ValueError):
        list(blobs.ivf_frames(b"RIFF" + whole[4:]))


def test_ivf_segments(spark, monkeypatch):
    monkeypatch.setattr(blobs, "SEGMENT", 2)
    rows = spark.createDataFrame([(1, i, bytes([i])) for i in range(5)], "stream long, pts long, data binary")
    files = blobs.to_ivf(rows)
    assert files.count() == 3
    assert sorted((r.pts, bytes(r.data)) for r in blobs.from_ivf(files).collect()) == [(i, bytes([i])) for i in range(5)]


def test_pgm_bytes_and_bad_images():
    for top, kind in ((255, np.uint8), (4095, np.uint16)):
        image = np.random.default_rng(1).integers(0, top + 1, (3, 5)).astype(kind)
        back, found = blobs.pgm_samples(blobs.pgm_bytes(image, top))
        assert found == top and (back == image).all()
    assert blobs.pgm_samples(b"P5 # a\n# b\n2 1\n255\nab")[0].tolist() == [[97, 98]]
    for bad in (b"P6 1 1 255 a", b"P5 2 2 255 abc"):
        with pytest.raises(ValueError):
            blobs.pgm_samples(bad)


def extended(v, width, depth, t1, t2, e):
    """The three-part curve on one number."""
    eps, clamp = width - e, lambda x, lo, hi: min(max(x, lo), hi)
    b2 = t1 * t1
    a1, b1 = b2 + (t1 << eps) + (1 << (2 * width - 2 - 2 * e)), t1 + (1 << (eps - 1))
    a3, b3 = b2 + (t2 << eps) - (1 << (2 * width - 2 - 2 * e)), t2 - (1 << (eps - 1))
    v += 1 << width >> 1
    if v < t1:
        v = a1 - clamp(b1 - v, 0, (1 << width) - 1) ** 2
    elif v < t2:
        v = (v << eps) + b2
    else:
        v = a3 + clamp(v - b3, 0, (1 << width) - 1) ** 2
    zeta = 2 * width - depth
    return clamp((v + (1 << zeta >> 1)) >> zeta, 0, (1 << depth) - 1)


def test_extended_curve(spark):
    args = (18, 12, 3000, 90_000, 2)
    cells = spark.range(-131_072, 131_072, 997).select(F.col("id").alias("v"), w.extended_out(F.col("id"), *args).alias("out"))
    assert [(r.v, r.out) for r in cells.orderBy("v").collect()] == [(v, extended(v, *args)) for v in range(-131_072, 131_072, 997)]
    there = spark.range(4096).select("id", w.extended_out(w.extended_in(F.col("id"), *args), *args).alias("back"))
    assert there.agg(F.max(F.abs(F.col("id") - F.col("back")))).first()[0] <= 1
