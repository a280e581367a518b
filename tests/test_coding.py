"""Resizing, prefix codes, the quantiser's search and latest values against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import codes, resample
from lumenframe.streaming import latest


def planes(spark, images):
    rows = [(p, y, x, int(v)) for p, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "plane long, y long, x long, v long")


def plain_weights(size, out, kernel):
    """Rows of weights, one for each output cell, in floating point."""
    w, scale = np.zeros((out, size)), size / out
    for o in range(out):
        for s in range(size):
            if kernel == "lanczos":
                x = (s + 0.5 - (o + 0.5) * scale) / max(scale, 1)
                w[o, s] = np.sinc(x) * np.sinc(x / 3) if abs(x) < 3 else 0
            else:
                w[o, s] = max(0, 1 - abs(s - min(max((o + 0.5) * scale - 0.5, 0), size - 1)))
    return w / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("kernel", ["lanczos", "linear"])
@pytest.mark.parametrize(("size", "out"), [((20, 12), (7, 5)), ((9, 7), (20, 15)), ((8, 8), (8, 8)), ((16, 3), (1, 1))])
def test_resized_planes(spark, kernel, size, out):
    r = np.random.default_rng(size[0])
    images = [r.integers(0, 256, size[::-1]), np.full(size[::-1], 77), np.where(np.indices(size[::-1])[1] % 2, 255, 0)]
    got = np.zeros((3, out[1], out[0]), int)
    rows = resample.resized(planes(spark, images), size, out, kernel, 255).collect()
    assert len(rows) == got.size
    for p, y, x, v in rows:
        got[p, y, x] = v
    for p, image in enumerate(images):
        wide = np.clip(np.floor(image @ plain_weights(size[0], out[0], kernel).T + 0.5), 0, 255)
        want = np.clip(np.floor(plain_weights(size[1], out[1], kernel) @ wide + 0.5), 0, 255)
        assert np.abs(got[p] - want).max() <= 1
    assert (got[1] == 77).all()
    if size == out:
        assert (got[0] == images[0]).all()


def test_resizing_compares_no_pairs(spark):
    plan = resample.resized(planes(spark, [np.zeros((4, 4))]), (4, 4), (2, 2), "lanczos", 255)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        resample.resized_along(planes(spark, [np.zeros((1, 1))]), "x", 10**6, 5, "linear", 255)
    assert [resample.fitted(*x) for x in ((64, 250, 24), (3552, 3556, 1280), (10, 1, 2))] == [(24, 94), (1280, 1281), (2, 1)]


# Residual, theta and the bits of their code, made by hand from the code's rule.
VECTORS = [(0, 0, "0"), (1, 0, "10"), (2, 0, "110"), (0, 2, "0"), (-1, 2, "10"), (1, 2, "110"), (-2, 2, "1110"), (2, 2, "11110"), (3, 2, "111110"), (4, 2, "1111110"), (-1, 1, "10"), (1, 1, "110"), (2, 1, "1110")]


def line(spark, items):
    return spark.createDataFrame([(items,)], "items array<struct<residual:bigint,theta:bigint>>")


@pytest.mark.parametrize(("residual", "theta", "bits"), VECTORS)
def test_codes_by_hand(spark, residual, theta, bits):
    (row,) = line(spark, [(residual, theta)]).select(codes.coded_bits(F.col("items")).alias("b")).collect()
    assert row.b == bits.ljust(8, "0")


def test_decoding_is_the_inverse(spark):
    r = random.Random(1)
    lines = [[(r.randint(-t, 9), t) for t in (r.randint(0, 9) for _ in range(n))] for n in [0, 1, 2, 3, *(r.randint(1, 60) for _ in range(80))]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, items array<struct<residual:bigint,theta:bigint>>")
    packed = rows.select("items", codes.bits_to_bytes(codes.coded_bits(F.col("items"))).alias("content"))
    back = packed.select("items", "content", codes.decoded(codes.runs_of(codes.bytes_to_bits(F.col("content"))), F.transform("items", lambda i: i["theta"])).alias("got"))
    for row in back.collect():
        assert row.got == [x.residual for x in row["items"]]
        ones = [x.residual + x.theta if x.residual > x.theta else -2 * x.residual - 1 if x.residual < 0 else 2 * x.residual for x in row["items"]]
        bits = "".join("1" * n + "0" for n in ones)
        assert "".join(f"{b:08b}" for b in bytes(row.content)) == bits.ljust(-(-len(bits) // 8) * 8, "0")


@pytest.mark.parametrize(("bits", "thetas", "error"), [("11111111", [0], "cut short"), ("10100000", [0] * 8, "cut short"), ("1" * 32 + "0" * 8, [0], "too long"), ("0010" + "0000", [0, 0], "behind"), ("0" * 16, [0], "behind"), ("", [1], "cut short")])
def test_bad_bits_are_errors(spark, bits, thetas, error):
    rows = spark.createDataFrame([(bits, thetas)], "b string, t array<bigint>").select(codes.decoded(codes.runs_of(F.col("b")), F.col("t")))
    with pytest.raises(Exception, match=error):
        rows.collect()


def test_residuals_below_theta_are_errors(spark):
    with pytest.raises(Exception, match="below -theta"):
        line(spark, [(-3, 2)]).select(codes.coded_bits(F.col("items"))).collect()


@pytest.mark.parametrize("budget", [0, 3, 20, 60, 10_000])
def test_quantiser_by_trying_all(spark, budget):
    r = random.Random(budget)
    weights = [(b, r.randint(0, 4), p) for b, p in enumerate(r.sample(range(4), 4))]
    rows = [(p, b, r.randint(0, 15)) for p in range(12) for b in range(4) for _ in range(r.randint(1, 12))]
    got = codes.quantiser(spark.createDataFrame(rows, "p int, band long, planes long"), ["p"], spark.createDataFrame(weights, "band long, gain long, priority long"), budget, most_q=15)

    def size(p, q, refine):
        cut = {b: min(max(q - gain - (priority < refine), 0), 15) for b, gain, priority in weights}
        return math.ceil(sum(4 * max(n - cut[b], 0) for x, b, n in rows if x == p) / 8)

    seen = got.collect()
    assert len(seen) == 12
    for row in seen:
        q = next((q for q in range(16) if size(row.p, q, 0) <= budget), None)
        if q is None:
            assert row.q is None and row.filler is None
            continue
        refine = max(x for x in range(8) if size(row.p, q, x) <= budget)
        assert (row.q, row.r, row.bytes, row.filler) == (q, refine, size(row.p, q, refine), budget - size(row.p, q, refine))


def test_latest_values_of_split_batches(spark, tmp_path):
    """Batches change some keys; one that runs again changes nothing, and readers get what is newer than what they saw."""
    schema, path = "camera string, sequence long, value string", f"file://{tmp_path}/out"
    parts = [[("a", 1, "x"), ("b", 2, "y")], [("a", 5, "z"), ("a", 4, "w")], [("c", 6, None), ("b", 1, "old")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*")
        latest.publish(latest.latest_stream(stream, "camera", "sequence"), path)
    want = [("a", 5, "z"), ("b", 2, "y"), ("c", 6, None)]
    assert sorted(map(tuple, latest.current(spark, path, "camera", "sequence").collect())) == want
    again = latest.latest_stream(spark.createDataFrame(parts[1], schema), "camera", "sequence")
    for _ in range(2):
        latest.upserted(again, 1, path)
        assert sorted(map(tuple, latest.current(spark, path, "camera", "sequence").collect())) == want
    assert sorted(map(tuple, latest.current(spark, path, "camera", "sequence", newer_than=5).collect())) == [("c", 6, None)]
