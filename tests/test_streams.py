"""Data sources of frames, keyed state, limiters and report intervals, by hand-made cases and plain versions."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import imaging
from lumenframe.operators import telemetry as t
from lumenframe.operators.ordering import segmented
from lumenframe.plans.streams import rocks
from lumenframe.plans import streams
from lumenframe.sources import blobs, ivf_files, paced
from lumenframe.streaming import frame_stats, keyed_state

FRAMES = "camera string, arrival long, frame_number long, dropped long, bytes_written long, frame_size long, timestamp_s long, timestamp_ns long, received_s long, received_ns long"


def names(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def payloads(spark, n=25):
    rows = [(i % 2, 1000 * (i // 2) + i % 2, bytes([i]) * i) for i in range(n)]
    return spark.createDataFrame(rows, "stream long, pts long, data binary").repartition(4), rows


def test_ivf_written_and_read(spark, tmp_path):
    frames, rows = payloads(spark)
    ivf_files.write_ivf(frames, f"file://{tmp_path}/out", most=5, fourcc="HEVC", width="320", height="200")
    assert names(f"{tmp_path}/out") == [f"{s}/{g:08d}.ivf" for s in (0, 1) for g in range(3)]
    got = ivf_files.read_ivf(spark, f"{tmp_path}/out").collect()
    assert sorted((int(r.file[0]), r.pts, bytes(r.data)) for r in got) == sorted(rows)
    place = {(s, p): i for s in (0, 1) for i, p in enumerate(sorted(p for x, p, _ in rows if x == s))}
    assert all(place[int(r.file[0]), r.pts] == int(r.file[2:]) * 5 + r.frame and r.size == len(r.data) for r in got)
    heads = ivf_files.read_ivf(spark, f"{tmp_path}/out", "headers").collect()
    assert {(r.fourcc, r.width, r.height) for r in heads} == {("HEVC", 320, 200)} and sum(r.frames for r in heads) == 25
    one = ivf_files.read_ivf(spark, f"{tmp_path}/out/1/00000002.ivf").collect()
    assert {r.file for r in one} == {"00000002"} and len(one) == 2
    content = spark.read.format("binaryFile").load(f"{tmp_path}/out/*/*.ivf").select(F.lit(1).cast("long").alias("stream"), F.lit(0).cast("long").alias("segment"), "content")
    assert sorted((r.pts, bytes(r.data)) for r in blobs.from_ivf(content).collect()) == sorted((p, d) for _, p, d in rows)


def test_ivf_modes(spark, tmp_path):
    frames, _ = payloads(spark, 6)
    folder = f"file://{tmp_path}/out"
    ivf_files.write_ivf(frames, folder, most=2)
    before = names(f"{tmp_path}/out")
    with pytest.raises(Exception, match="is there already"):
        ivf_files.write_ivf(frames, folder, most=2)
    assert names(f"{tmp_path}/out") == before
    ivf_files.write_ivf(frames.where("stream = 1"), folder, most=100, mode="overwrite")
    assert names(f"{tmp_path}/out") == ["1/00000000.ivf"]


@pytest.mark.parametrize("kind", ["udf", "parted", "shared"])
def test_a_write_that_fails_leaves_no_file(spark, tmp_path, kind):
    rows = spark.range(40).select((F.col("id") % 4).cast("string").alias("file"), F.col("id").alias("pts"), F.lit(b"x").alias("data")).repartition(4, "file").sortWithinPartitions("file", "pts")
    if kind == "udf":  # one task of several fails after some rows
        rows = rows.withColumn("data", F.when(F.col("pts") == 38, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("data")))
    elif kind == "parted":  # a file's rows aren't together
        rows = spark.range(40).coalesce(1).select((F.col("id") % 4).cast("string").alias("file"), F.col("id").alias("pts"), F.lit(b"x").alias("data"))
    else:  # two tasks write one file
        rows = spark.range(40).repartition(3).select(F.lit("a").alias("file"), F.col("id").alias("pts"), F.lit(b"x").alias("data"))
    ivf_files.registered(spark)
    with pytest.raises(Exception, match={"udf": "broken", "parted": "together", "shared": "same file"}[kind]):
        rows.write.format("ivf").mode("append").save(f"file://{tmp_path}/out")
    assert names(f"{tmp_path}") == []


def test_ivf_broken_files(spark, tmp_path):
    whole = blobs.ivf_bytes([(7, b"abc"), (8, b""), (9, b"defg")], b"AV01", 64, 64)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.ivf").write_bytes(b"no")
    (tmp_path / "note.txt").write_bytes(b"no")
    for name, cut in (("a", 0), ("b", 1), ("c", 5), ("d", 20)):
        (tmp_path / f"{name}.ivf").write_bytes(whole[: len(whole) - cut])
    got = ivf_files.read_ivf(spark, f"file://{tmp_path}").collect()
    assert sorted((r.file, r.frame, r.pts, bytes(r.data)) for r in got) == [("a", 0, 7, b"abc"), ("a", 1, 8, b""), ("a", 2, 9, b"defg"), *((f, i, *x) for f in "bc" for i, x in enumerate([(7, b"abc"), (8, b"")])), ("d", 0, 7, b"abc")]
    for content in (b"DKIF", b"DKIX" + whole[4:], whole[:4] + b"\1" + whole[5:]):
        (tmp_path / "e.ivf").write_bytes(content)
        with pytest.raises(Exception, match="no IVF file"):
            ivf_files.read_ivf(spark, f"file://{tmp_path}").count()
    with pytest.raises(Exception, match="isn't there"):
        ivf_files.read_ivf(spark, f"file://{tmp_path}/none").count()
    with pytest.raises(Exception, match="frames or headers"):
        ivf_files.read_ivf(spark, f"file://{tmp_path}", "both").count()
    (tmp_path / "empty").mkdir()
    assert ivf_files.read_ivf(spark, f"file://{tmp_path}/empty").count() == 0


def test_no_frames_make_no_file(spark, tmp_path):
    frames, _ = payloads(spark, 4)
    ivf_files.write_ivf(frames.limit(0), f"file://{tmp_path}/out")
    assert names(f"{tmp_path}") == []


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_segments_in_order(spark, width):
    r = random.Random(width)
    rows = [(s, p, b"") for s in (3, 4) for p in r.sample(range(300), 70)]
    got = segmented(spark.createDataFrame(rows, "stream long, pts long, data binary"), 8, width)
    place = {(s, p): i for s in (3, 4) for i, p in enumerate(sorted(p for x, p, _ in rows if x == s))}
    assert {(x.stream, x.pts): x.segment for x in got.collect()} == {k: i // 8 for k, i in place.items()}


def test_equal_times_share_a_segment(spark):
    rows = [(1, p, b"") for p in (0, 1, 1, 1, 1, 2, 3)]
    got = segmented(spark.createDataFrame(rows, "stream long, pts long, data binary"), 2, 2).collect()
    by = {}
    for x in got:
        by.setdefault(x.pts, set()).add(x.segment)
    assert len(got) == 7 and all(len(s) == 1 for s in by.values()) and [min(by[p]) for p in range(4)] == sorted(min(by[p]) for p in range(4))


def test_numbering_moves_no_payload(spark):
    frames, _ = payloads(spark)
    plan = segmented(frames, 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line or "Aggregate" in line]
    assert windows and not any("data#" in line for line in windows)


def test_only_looked_at_payloads_are_moved(spark):
    schema = "camera string, arrival long, frame_number long, bytes_written long, crc long, data binary"
    rows = [("a", 3 * i, i, -1, 0 if i % 4 == 0 else 1, bytes([i]) * 70) for i in range(20)]
    frames = spark.createDataFrame(rows, schema)
    out = t.integrity(frames, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("data#" in line for line in plan.splitlines() if "Window" in line)
    assert out.collect() == [("a", 5, 5, 1, 5)]


@pytest.mark.parametrize("bits", [10, 12])
def test_paced_pictures_are_the_batch_generator_s(spark, bits):
    for phase in (0, 3, 5):
        want = {(r.y, r.x): r.v for r in imaging.test_frame(spark, 64, 6, bits, phase).collect()}
        got = paced.pattern(64, 6, bits, phase)
        assert {(y, x): int(got[y, x]) for y in range(6) for x in range(64)} == want
        assert len(paced.payload(64, 6, bits, phase)) == 6 * ((64 * bits // 8 + 7) // 8 * 8)


def test_paced_stream_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """Three runs of one stream: what is due at the first, what has become due since, and the rest up to the limits."""
    start = int((time.time() - 20) * 1e6)
    cameras = [{"camera": "a", "fps": 10, "limit": 0}, {"camera": "b", "fps": 0.5, "limit": 300}, {"camera": "c", "fps": 1000, "limit": 50}]

    def run(begin):
        rows = frame_stats.run_to_end(paced.paced(spark, cameras, begin), f"file://{tmp_path}/out", "append")
        return sorted((r.camera, r.frame, r.phase, r.due_us) for r in rows.collect())

    one = run(start)
    count = lambda rows, c: sum(r[0] == c for r in rows)
    assert 200 <= count(one, "a") <= 260 and 10 <= count(one, "b") <= 14 and count(one, "c") == 50
    time.sleep(1)
    two = run(start)
    assert count(two, "a") >= count(one, "a") + 9 and set(one) <= set(two)
    three = run(start - 10**9)
    assert count(three, "b") == 300
    for c in "abc":
        assert [r[1] for r in three if r[0] == c] == list(range(count(three, c)))
    assert all(r[2] == r[1] // 8 for r in three) and all(r[3] == start + r[1] * 100_000 for r in two if r[0] == "a")


@pytest.mark.parametrize(("bits", "width"), [(12, 64), (10, 64), (10, 20), (12, 6)])
def test_sums_of_frames(spark, bits, width):
    """Lines that are and aren't filled up, and more frames than are unpacked at once."""
    frames = [(i, paced.payload(width, 5, bits, i % 7)) for i in range(blobs.SUMMED + 3)]
    got = dict(map(tuple, blobs.sample_sums(spark.createDataFrame(frames, "i long, data binary").coalesce(1), "data", bits, width).collect()))
    assert got == {i: int(paced.pattern(width, 5, bits, i % 7).sum()) for i, _ in frames}


def test_remembered_pictures_are_those_drawn(spark):
    """A wide picture has more places of its bar than are remembered."""
    reader = paced.PacedReader([], 0, 160, 4, 12)
    for batch in reader.read(paced.Span("a", 1, 3, 200)):
        assert all(r["data"] == paced.payload(160, 4, 12, r["frame"] // paced.PHASE) and r["phase"] == r["frame"] // paced.PHASE for r in batch.to_pylist())


def test_paced_frames_move_no_samples(spark, sf_dir):
    text = streams.paced_frames(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Generate" not in text and "data" not in text.split("ReadSchema")[-1]


def test_paced_options(spark):
    assert paced.Camera.of({"camera": "x"}).period_us == 33_333 and paced.Camera.of({"camera": "x", "fps": -1}).limit == 0
    assert [paced.Camera("x", 100, 3).due(s) for s in (-1, 0, 99, 100, 10**9)] == [0, 1, 1, 2, 3]
    with pytest.raises(Exception, match="same name"):
        paced.paced(spark, [{"camera": "a"}, {"camera": "a"}], 0).writeStream.format("noop").start().awaitTermination()


def many(seed, n=400):
    """Frames of two cameras with unknown numbers, jumps and counters that fall."""
    r = random.Random(seed)
    rows, number, count = [], 0, 0
    for i in range(n):
        number += r.choice([1, 1, 1, 2, 7, -5])
        count = max(0, count + r.choice([0, 0, 1, 3, -2]))
        rows.append((r.choice("ab"), i, r.choice([number, number, -1]), r.choice([count, count, -1]), r.choice([5, 10, 0]), 10, i // 3, r.randrange(10**9), i, 0))
    return rows


@pytest.mark.parametrize("width", [10, 64, 10_000])
def test_keyed_state_is_the_batch_result(spark, tmp_path, width):
    """Batches cut through ranges, the stream is stopped and started between them, and one range is met by several batches."""
    rows, source = many(width), f"{tmp_path}/in"
    for k, (low, high) in enumerate(((0, 33), (33, 150), (150, 151), (151, 400))):
        spark.createDataFrame(rows[low:high], FRAMES).repartition(3).write.parquet(f"{source}/part={k}")
        stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 3).parquet(f"{source}/part=*")
        with rocks(spark):
            out = frame_stats.run_to_end(keyed_state.range_states(stream, width), f"file://{tmp_path}/out", "update")
        got = {r.camera: r for r in keyed_state.folded(keyed_state.newest_ranges(out)).collect()}
        so_far = spark.createDataFrame(rows[:high], FRAMES)
        want = so_far.groupBy("camera").agg(F.count("*").alias("n"), F.sum(t.frame_bytes()).alias("bytes")).join(t.gaps(so_far), "camera").join(t.counter_growth(so_far), "camera").join(t.first_last(so_far), "camera")
        for r in want.collect():
            g = got[r.camera]
            assert (g.frames, g.bytes, g.gaps, g.dropped_total, g.first_frame, g.last_frame) == (r.n, r.bytes, r.gaps, r.dropped_total, r.first_frame, r.last_frame)
    assert out.where("frames > 0").groupBy("camera", "range").count().count() == len({(r[0], r[1] // width) for r in rows})


def passing(times, least):
    last, out = None, []
    for s, i in sorted(times):
        if last is None or s - last >= least:
            last = s
            out.append(i)
    return out


def fast(seed, n=600):
    r = random.Random(seed)
    at, rows = {c: 10**18 for c in "abc"}, []
    for i in range(n):
        c = r.choice("abc")
        at[c] += {"a": 33_333_333, "b": r.choice([0, 1, 99_999_999, 100_000_000, 5]), "c": r.choice([10**6, 4 * 10**9])}[c]
        rows.append((c, i, at[c]))
    return rows


@pytest.mark.parametrize("least", [0.1, 0.05, 1e-9, 3.0])
def test_limiter_below_a_second(spark, monkeypatch, least):
    monkeypatch.setattr(t, "RANGE", 0)  # ranges of 64 least intervals
    rows = fast(1) + [("d", i, None) for i in range(5)]
    times = spark.createDataFrame(rows, "camera string, arrival long, t long")
    want = {i for c in "abc" for i in passing([(s, i) for x, i, s in rows if x == c], round(least * 1e9))}
    assert {r.arrival for r in t.rate_limited(times, least, F.col("t")).collect()} == want
    split = times.select("camera", "arrival", F.expr("t div 1000000000").alias("timestamp_s"), F.expr("t % 1000000000").alias("timestamp_ns"))
    assert {r.arrival for r in t.rate_limited(split, least).collect()} == want
    assert t.rate_limited(split, 0).count() == 600


def test_limiter_of_a_stream_in_any_batches(spark, tmp_path):
    rows = fast(2)
    for k, (low, high) in enumerate(((0, 100), (100, 110), (110, 600))):
        spark.createDataFrame(rows[low:high], "camera string, arrival long, time_ns long").repartition(2).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema("camera string, arrival long, time_ns long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/part=*")
        with rocks(spark):
            out = frame_stats.run_to_end(keyed_state.limited_stream(stream, 10**8), f"file://{tmp_path}/out", "append")
    want = sorted(i for c in "abc" for i in passing([(s, i) for x, i, s in rows if x == c], 10**8))
    assert sorted(r.arrival for r in out.collect()) == want


def plain_reports(frames, least):
    """frames: (t, arrival, bytes) in order."""
    out, last, n, size, whole = [], frames[0][0], 0, 0, 0
    for k, (s, a, b) in enumerate(frames):
        n, size, whole = n + 1, size + b, whole + 1
        if s - last >= least or k == len(frames) - 1:
            out.append((s, a, n, size, (s - last) / 1e9, whole))
            last, n, size = s, 0, 0
    return out


@pytest.mark.parametrize("seconds", [0.1, 0.5, 7.0, 1e6])
def test_report_intervals(spark, monkeypatch, seconds):
    monkeypatch.setattr(t, "RANGE", 0)
    rows = [(c, i, s, 7 * i % 50) for c, i, s in fast(3)] + [("one", 900, 5, 3), (None, 901, 5, 3), ("none", 902, None, 3)]
    frames = spark.createDataFrame(rows, "camera string, arrival long, t long, bytes_written long").withColumn("frame_size", F.lit(4))
    got = t.reports(frames, seconds, F.col("t")).collect()
    want = []
    for c in ("a", "b", "c", "one"):
        mine = sorted((s, i, b if b > 0 else 4) for x, i, s, b in rows if x == c)
        want += [(c, *r) for r in plain_reports(mine, round(seconds * 1e9))]
    assert sorted((r.camera, r.report_ns, r.arrival, r.frames, r.bytes, r.interval_s, r.total_frames) for r in got) == sorted(want)
    for r in got:
        assert r.fps == (r.frames / r.interval_s if r.interval_s > 0 else 0)


def test_reports_need_an_interval(spark):
    with pytest.raises(ValueError):
        t.reports(spark.createDataFrame([], FRAMES), 0)
    assert t.reports(spark.createDataFrame([], FRAMES), 2).count() == 0


def test_a_slow_start_fails_no_camera(spark):
    """Ten seconds of nothing, then a frame a second: over the whole run half of what is expected."""
    seconds = [0, *range(11, 21)]
    rows = [("a", i, i, 0, 10, 10, 100 + s, 0, 100 + s, 0) for i, s in enumerate(seconds)]
    frames, plan = spark.createDataFrame(rows, FRAMES), spark.createDataFrame([("a", 1.0)], "camera string, expected_fps double")
    assert t.verdicts(frames, plan, 0.1, 0).first().reason == "rate"
    (row,) = t.verdicts(frames, plan, 0.1, 0, window=(10, 20)).collect()
    assert row["pass"] and row.fps == 1.0 and row.frames == 11
    assert t.verdicts(frames, plan, 0.1, 0, window=(50, 60)).first().reason == "rate"
