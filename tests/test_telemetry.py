"""Hand-made frame sequences with results known from their definition."""

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import telemetry as t
from lumenframe.streaming import frame_stats
from lumenframe.streaming.frame_stats import folded

SCHEMA = "camera string, arrival long, frame_number long, dropped long, bytes_written long, frame_size long, timestamp_s long, timestamp_ns long, received_s long, received_ns long"


def frames(spark, numbers, dropped=None, **other):
    dropped = dropped or [-1] * len(numbers)
    rows = [("a", i, n, d, 10, 10, 100 + i, 0, 101 + i, 0) for i, (n, d) in enumerate(zip(numbers, dropped))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("numbers", "gaps", "first", "last"), [([1, 2, 3], 0, 1, 3), ([1, 2, 6], 3, 1, 6), ([1, 2, 6, 5, 9], 6, 1, 9), ([-1, 4, -1, 7], 2, 4, 7), ([-1], 0, -1, -1)])
@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_gaps_and_ends(spark, monkeypatch, numbers, gaps, first, last, chunk):
    monkeypatch.setattr(t, "CHUNK", chunk)
    f = frames(spark, numbers)
    assert t.gaps(f).first().gaps == gaps
    assert tuple(t.first_last(f).first())[1:] == (first, last)


@pytest.mark.parametrize(("counter", "total"), [([5, 5, 8], 3), ([5, 2, 4], 2), ([-1, 3, -1, 4], 1)])
@pytest.mark.parametrize("chunk", [1, 100])
def test_counter_growth(spark, monkeypatch, counter, total, chunk):
    monkeypatch.setattr(t, "CHUNK", chunk)
    assert t.counter_growth(frames(spark, [1] * len(counter), counter)).first().dropped_total == total


def test_stream_state_is_the_batch_result(spark):
    f = frames(spark, [1, 2, 6, 5, -1, 9], [5, 2, 4, -1, 4, 9])
    state = (0, 0, 0, 0, -1, -1, -1)
    parts = f.toPandas()
    for part in (parts[:2], parts[2:5], parts[5:]):
        state = folded(state, part)
    assert state == (6, 60, 6, 7, 1, 9, 9)
    assert (t.gaps(f).first().gaps, t.counter_growth(f).first().dropped_total) == (6, 7)


def test_running_stats_gathers_no_camera(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(t, "CHUNK", 2)
    f = frames(spark, [1, 2, 6, 5, -1, 9], [5, 2, 4, -1, 4, 9]).coalesce(1)
    for low, high in ((0, 2), (2, 5), (5, 6)):
        f.where((F.col("arrival") >= low) & (F.col("arrival") < high)).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = frame_stats.running_stats(stream, f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == [("a", 2, 20, 0, 0, 1, 2), ("a", 5, 50, 3, 2, 1, 5), ("a", 6, 60, 6, 7, 1, 9)]


def test_latency_needs_clocks_close_together(spark):
    rows = [("a", 0, 1, 0, 10, 10, ts, 0, rs, 500_000_000) for ts, rs in ((100, 100), (0, 5), (100, 110), (100, 90))]
    row = t.mean_latency(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.latency_ms, row.latency_frames) == (500.0, 1)


def test_sampling_counts_from_one_and_nothing_for_zero(spark):
    f = frames(spark, list(range(10)))
    assert sorted(r.arrival for r in t.sampled(f, 3).collect()) == [2, 5, 8]
    assert sorted(r.arrival for r in t.sampled(f, 3, limit=2).collect()) == [2, 5]
    assert t.sampled(f, 0).count() == 0


def test_rate_limit_walks_steady_cameras_range_by_range(spark, monkeypatch):
    monkeypatch.setattr(t, "RANGE", 1)
    times = {"a": [s for s in range(1, 1500) if s % 11 and not 700 < s < 730], "b": [s // 3 for s in range(600)], "c": [5, 2, 900, 901, 904]}
    rows = [(c, i, 1, 0, 10, 10, s, 0, s, 0) for c, ts in times.items() for i, s in enumerate(ts)]
    want = []
    for c, ts in times.items():
        last = None
        for s, i in sorted((s, i) for i, s in enumerate(ts)):
            if last is None or s - last >= 3:
                last = s
                want.append((c, i))
    limited = t.rate_limited(spark.createDataFrame(rows, SCHEMA), 3)
    assert sorted(map(tuple, limited.collect())) == sorted(want)
    plan = limited._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_verdict_gives_the_first_reason(spark):
    plan = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "camera string, expected_fps double")
    got = {r.camera: r.reason for r in t.verdicts(frames(spark, [1, 2, 9, 10]), plan, 0.5, 3).collect()}
    assert got == {"a": "loss", "b": "no frames"}


def test_empty_frames(spark):
    f = frames(spark, [])
    assert t.gaps(f).count() == t.first_last(f).count() == t.rate_limited(f, 5).count() == 0
    assert t.totals(f, F.lit(1)).count() == 0
