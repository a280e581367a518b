"""Byte layouts, headers, request bodies, rigs and checked verdicts by hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.functions import strings
from lumenframe.operators import codestream, telemetry
from lumenframe.operators.ordering import numbered
from lumenframe.sources import blobs, captures


@pytest.mark.parametrize(
    ("bits", "samples", "packed"),
    [
        (10, [0x3FF, 0, 0, 0], "ff00000003"),
        (10, [0x001, 0x002, 0x003, 0x200], "0000008039"),
        (10, [0x155, 0x2AA, 0x0F3, 0x30C], "55aa3cc339"),
        (12, [0xFFF, 0], "ff000f"),
        (12, [0xABC, 0x123], "ab123c"),
        (12, [0x00F, 0xF00, 0x0F0, 0x812], "00f00f0f8120"),
    ],
)
def test_packed_bytes(bits, samples, packed):
    """The high bits of each sample come first, then one byte with the low bits, the first sample's lowest."""
    line = np.array([samples], np.int32)
    assert blobs.packed(line, bits).tobytes().hex() == packed
    assert blobs.unpacked(np.frombuffer(bytes.fromhex(packed), np.uint8)[None], bits).tolist() == [samples]


def test_pgx_vectors():
    assert blobs.pgx_samples(b"PG ML +12 2 1\n\x01\x02\x0f\xff").tolist() == [[0x102, 0xFFF]]
    assert blobs.pgx_samples(b"PG LM - 8 2 1\n\xff\x7f").tolist() == [[-1, 127]]
    for bad in (b"P5 2 1\n", b"PG ML +12 2 2\n\0\0\0\0"):
        with pytest.raises(ValueError):
            blobs.pgx_samples(bad)


def test_flat_frames(spark):
    rows = [(1, b"abcd" * 16), (2, b"abcd" * 15), (3, bytes(range(64))), (4, None), (5, b"\0" * 100_000), (6, b"abcdefghijklmnop" * 8), (7, b"")]
    got = {r.k: r.data for r in blobs.flat_flags(spark.createDataFrame(rows, "k int, data binary"), "data").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False}


def test_request_bodies(spark):
    bodies = ["a=1&a=2", "flag&b=x%20y&=z", "", None, '{"a": "q", "n": 1.5, "t": true}', " {bad", "a=b=c"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {r.k: r.f for r in rows.select("k", strings.request_fields(F.col("body")).alias("f")).collect()}
    assert got == {0: {"a": "2"}, 1: {"b": "x y", "": "z"}, 2: {}, 3: None, 4: {"a": "q", "n": "1.5", "t": "true"}, 5: {}, 6: {"a": "b=c"}}


@pytest.mark.parametrize(("a", "b", "want"), [('{"a":1}', '{"b":2}', '{"a":1,"b":2}'), ("{}", '{"b":2}', '{"b":2}'), ('{"a":1}', " { } ", '{"a":1}'), ("x", "{}", "{}")])
def test_merged_objects(spark, a, b, want):
    assert spark.range(1).select(strings.merged_objects(F.lit(a), F.lit(b)).alias("o")).first().o == want


def test_all_reasons_of_a_verdict(spark):
    schema = "camera string, arrival long, frame_number long, dropped long, bytes_written long, frame_size long, timestamp_s long, data binary, crc long"
    good = {"data": bytes(range(64)) * 2, "number": 0, "written": 128}
    cases = {"good": {}, "rate": {"step": 100}, "loss": {"number": 50}, "short": {"written": 100}, "wrong": {"crc": 5}, "flat": {"data": b"\1" * 128}, "unsaid": {"crc": 0, "data": b"\1" * 128}}
    import zlib

    rows = []
    for camera, change in cases.items():
        c = good | change
        for i in range(10):
            own = ~zlib.crc32(c["data"][: c["written"]]) & 0xFFFFFFFF
            jump = c["number"] if i == 9 else 0
            rows.append((camera, i, i + jump, 0, c["written"], 128, i * c.get("step", 1), c["data"], c.get("crc", own)))
    frames = spark.createDataFrame(rows, schema)
    checks = telemetry.integrity(frames, 2)
    counts = {r.camera: (r.crc_checked, r.crc_bad, r.crc_unavailable, r.flat_frames) for r in checks.collect()}
    assert counts["good"] == (5, 0, 0, 0) and counts["wrong"] == (5, 5, 0, 0) and counts["flat"] == (5, 0, 0, 5) and counts["unsaid"] == (0, 0, 5, 0)
    gbps = 10 * 128 * 8 / 9 / 1e9
    plan = spark.createDataFrame([(k, gbps) for k in [*cases, "absent"]], "camera string, expected_gbps double")
    got = {r.camera: r.reason for r in telemetry.verdicts(frames, plan, 0.3, 3, "gbps", checks).collect()}
    assert got == {"good": "", "rate": "rate", "loss": "loss", "short": "short frames", "wrong": "checksums", "flat": "flat frames", "unsaid": "", "absent": "no frames"}


def test_header_segments():
    cap, pih, cdt, wgt = "FF500004 0000", "FF12001A" + "00" * 24, "FF130004 0C11", "FF140004 0102"
    scan = lambda *parts: codestream.header_segments(bytes.fromhex("".join(parts).replace(" ", "")))
    assert scan("FF10", cap, pih, cdt, wgt, "FF20") == ([(0xFF50, 2, 4), (0xFF12, 8, 26), (0xFF13, 36, 4), (0xFF14, 42, 4)], "")
    wrong = {"no start": ("FF11",), "order": ("FF10", pih, cap, cdt, wgt, "FF20"), "missing segment": ("FF10", cap, pih, wgt, "FF20"), "repeated segment": ("FF10", cap, pih, cdt, wgt, wgt, "FF20")}
    wrong |= {"no marker": ("FF10", cap, "0012"), "length": ("FF10", cap, "FF12 FFFF"), "unexpected marker": ("FF10", "FF99 0002", "FF20")}
    assert {k: scan(*v)[1] for k, v in wrong.items()} == {k: k for k in wrong}


def test_dumps_and_short_files(spark, tmp_path):
    folder = f"file://{tmp_path}/dumps"
    settings = '{"width": 2, "height": 2, "bits": 12, "line_bytes": 3, "start_byte": 1}'
    rows = [("c", 0, -1, 7, bytes.fromhex("00ab123cff000f"), settings)]
    schema = "camera string, dump int, frame_number long, crc long, data binary, settings string"
    assert captures.write_dumps(spark.createDataFrame(rows, schema), folder).collect() == [("c_000_f000000", 7)]
    assert [(r.y, r.px) for r in captures.raw_frames(spark, folder).orderBy("y").collect()] == [(0, [0xABC, 0x123]), (1, [0xFFF, 0])]
    assert captures.sidecars(spark, folder).first().frame_number == -1
    assert {(r.name, r["size"]) for r in captures.listing(spark, folder).where("name LIKE '%.raw'").collect()} == {("c_000_f000000.raw", 7)}
    captures.write_dumps(spark.createDataFrame([("c", 1, 3, 7, b"\0" * 5, settings)], schema), folder).collect()
    with pytest.raises(Exception, match="cut short"):
        captures.raw_frames(spark, folder).collect()


@pytest.mark.parametrize("width", [1, 3, 100])
def test_numbered_in_ranges(spark, width):
    rows = spark.createDataFrame([("a", i * i) for i in range(9)] + [("b", -5), ("b", 5)], "g string, k long")
    got = {(r.g, r.k): r.n for r in numbered(rows, ["g"], "k", "n", width).collect()}
    assert got == {("a", i * i): i + 1 for i in range(9)} | {("b", -5): 1, ("b", 5): 2}


def test_tables_are_discarded(spark):
    begun = storage.mark()
    first, second = (storage.stored(spark.range(n), "gone") for n in (3, 4))
    storage.discard(spark, begun, keep=1)
    assert second.count() == 4 and storage.mark() == begun + 1
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(first.inputFiles()[0]).count()
