"""Per-camera totals, loss, latency and verdicts of frame streams.

Frames have camera, arrival (the order in which they came), frame_number and dropped (-1 if unknown), bytes_written,
frame_size, and capture and reception times as seconds and nanoseconds. Cameras are few and frames many: windows that
need a camera's order are split at fixed ranges of arrival or time first, so that no task sorts a whole camera's frames.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.ordering import numbered, running
from lumenframe.sources.blobs import flat_flags, jamcrc
from lumenframe.storage import stored

#: Frames of a camera that one task puts in order.
CHUNK = 100_000
#: Seconds of a camera that one task walks, at least; nanoseconds in a second.
RANGE, SECOND = 600, 1_000_000_000


def clock_ok() -> Column:
    """Both clocks are set and less than 10 s apart."""
    apart = F.col("received_s") - F.col("timestamp_s")
    return (F.col("timestamp_s") > 0) & (F.col("received_s") > 0) & (apart > -10) & (apart < 10)


def latency_ms() -> Column:
    """Reception minus capture; null where the clocks can't be compared."""
    seconds, nanos = F.col("received_s") - F.col("timestamp_s"), F.col("received_ns") - F.col("timestamp_ns")
    return F.when(clock_ok(), (seconds * 1_000_000_000 + nanos) / 1e6)


def is_short() -> Column:
    return (F.col("frame_size") > 0) & (F.col("bytes_written") > 0) & (F.col("bytes_written") < F.col("frame_size"))


def is_mismatched() -> Column:
    """Unlike a short frame this also is an empty or an oversized one."""
    return (F.col("frame_size") > 0) & (F.col("bytes_written") >= 0) & (F.col("bytes_written") != F.col("frame_size"))


def span() -> Column:
    """Seconds from the first captured frame to the last, as an aggregate."""
    return F.max("timestamp_s") - F.min("timestamp_s")


def frame_bytes() -> Column:
    return F.when(F.col("bytes_written") > 0, F.col("bytes_written")).otherwise(F.col("frame_size"))


def with_previous(frames: DataFrame, column: str, previous: str) -> DataFrame:
    """Adds the last known (not negative) value of a column before each frame of its camera.

    Frames are ordered within chunks of arrival; each chunk's first frames take the last known value of the chunks
    before, which is a window over one row a chunk.
    """
    known = F.when(F.col(column) >= 0, F.col(column))
    chunked = frames.withColumn("__chunk", F.floor(F.col("arrival") / CHUNK))
    inside = Window.partitionBy("camera", "__chunk").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    ends = chunked.where(known.isNotNull()).groupBy("camera", "__chunk").agg(F.max_by(column, "arrival").alias("__end"))
    chunks = chunked.groupBy("camera", "__chunk").agg(F.count("*").alias("__n")).join(ends, ["camera", "__chunk"], "left")
    before = Window.partitionBy("camera").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("camera", "__chunk", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    met = chunked.withColumn(previous, F.last(known, ignorenulls=True).over(inside)).join(carried, ["camera", "__chunk"])
    return met.withColumn(previous, F.coalesce(previous, "__carried")).drop("__chunk", "__carried")


def gaps(frames: DataFrame) -> DataFrame:
    """(camera, gaps): frame numbers skipped, in arrival order. A jump back adds none and counts on from there."""
    last, now = F.col("__last"), F.col("frame_number")
    missing = F.when((now >= 0) & (now > last + 1), now - last - 1).otherwise(0)
    return with_previous(frames, "frame_number", "__last").groupBy("camera").agg(F.sum(missing).alias("gaps"))


def counter_growth(frames: DataFrame, counter: str = "dropped") -> DataFrame:
    """(camera, dropped_total): what a counter grew by; the first value sets the base and a fall sets it anew."""
    step = F.when(F.col(counter) > F.col("__last"), F.col(counter) - F.col("__last")).otherwise(0)
    return with_previous(frames, counter, "__last").groupBy("camera").agg(F.sum(step).alias("dropped_total"))


def totals(frames: DataFrame, seconds: Column) -> DataFrame:
    """Frames, bytes and mean rates of each camera over ``seconds``, an aggregate; rates are 0 without time."""
    out = frames.groupBy("camera").agg(F.count("*").alias("frames"), F.sum(frame_bytes()).alias("bytes"), seconds.cast("double").alias("elapsed_s"))
    rate = lambda x: F.when(F.col("elapsed_s") > 0, x / F.col("elapsed_s")).otherwise(0.0)
    return out.select("camera", "frames", "bytes", "elapsed_s", rate(F.col("frames")).alias("fps"), (rate(F.col("bytes") * 8) / 1e9).alias("gbps"))


def first_last(frames: DataFrame) -> DataFrame:
    """The first and the last known frame number by arrival, -1 if none is known."""
    number, at = F.when(F.col("frame_number") >= 0, F.col("frame_number")), F.when(F.col("frame_number") >= 0, F.col("arrival"))
    out = frames.groupBy("camera").agg(F.min_by(number, at).alias("first_frame"), F.max_by(number, at).alias("last_frame"))
    return out.select("camera", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("first_frame", "last_frame")])


def mean_latency(frames: DataFrame) -> DataFrame:
    """Mean latency of comparable frames, 0 without any, and how many these are."""
    return frames.groupBy("camera").agg(F.coalesce(F.avg(latency_ms()), F.lit(0.0)).alias("latency_ms"), F.count(latency_ms()).alias("latency_frames"))


def interval_rates(frames: DataFrame, seconds: int) -> DataFrame:
    """Frames, bytes and rates of each camera and interval of so many seconds."""
    bucket = F.window("ts", f"{seconds} seconds")["start"]
    out = frames.groupBy("camera", bucket.alias("start")).agg(F.count("*").alias("frames"), F.sum(frame_bytes()).alias("bytes"))
    return out.withColumn("fps", F.col("frames") / float(seconds)).withColumn("gbps", F.col("bytes") * 8 / float(seconds) / 1e9)


def sampled(frames: DataFrame, every: int, limit: int | None = None) -> DataFrame:
    """Each camera's frames number every, 2 * every, ... by arrival, ``limit`` of them; none if every is 0."""
    if every <= 0:
        return frames.limit(0)
    placed = numbered(frames, ["camera"], "arrival", "sequence", CHUNK)
    kept = placed.where(F.col("sequence") % every == 0)
    return kept if limit is None else kept.where(F.col("sequence") <= every * limit)


def integrity(frames: DataFrame, every: int) -> DataFrame:
    """Counts of each camera over every so-manieth frame: with a checksum and without, wrong ones, and flat frames.

    Frames also have data and crc, what the sender says; 0 says nothing, and such a frame is neither checked nor flat.
    Checked are the bytes written, or all of data if their number isn't known. Frames are numbered by camera and arrival
    alone; only the payload of those that are looked at meets their keys. An arrival is unique within its camera.
    """
    keys = sampled(frames.select("camera", "arrival"), every).select("camera", "arrival")
    size = F.least(F.octet_length("data"), F.when(F.col("bytes_written") > 0, F.col("bytes_written")).otherwise(F.octet_length("data")))
    told = frames.join(keys, ["camera", "arrival"], "left_semi").select("camera", "crc", F.expr("data").substr(F.lit(1), size.cast("int")).alias("data"))
    told = flat_flags(told.withColumn("wrong", F.col("crc") != jamcrc(F.col("data"))), "data")
    checked = F.col("crc") != 0
    counts = {"crc_checked": checked, "crc_bad": checked & F.col("wrong"), "crc_unavailable": F.col("crc") == 0, "flat_frames": checked & F.col("data")}
    return told.groupBy("camera").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def dumped(frames: DataFrame, every: int, limit: int) -> DataFrame:
    """(camera, frames_dumped): how many frames a sampled dump writes."""
    return frames.groupBy("camera").agg(F.least(F.floor(F.count("*") / every), F.lit(limit)).cast("long").alias("frames_dumped"))


CHECKS = ("crc_checked", "crc_bad", "flat_frames")


def verdicts(frames: DataFrame, plan: DataFrame, tolerance: float, allowed: int, rate: str = "fps", checks: DataFrame | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """A verdict with its first failing reason for each camera of the plan (camera and the expected fps or gbps).

    Tested in order: frames came, the rate is within the tolerance, losses are allowed ones, no frame is short. With
    ``checks``, which integrity() gives and in which a camera may be missing, also that no checksum is wrong and that no
    frame is flat.
    """
    short = frames.groupBy("camera").agg(F.count_if(is_short()).alias("short_frames"))
    loss = gaps(frames).join(counter_growth(frames), "camera")
    sums = totals(frames, span())
    if window is not None:
        sums = sums.drop("fps", "gbps").join(window_or_run(frames, *window).drop("windowed"), "camera")
    met = plan.join(sums, "camera", "left").join(loss, "camera", "left").join(short, "camera", "left")
    names = ["frames", "bytes", "gaps", "dropped_total", "short_frames"]
    if checks is not None:
        met, names = met.join(checks.select("camera", *CHECKS), "camera", "left"), [*names, *CHECKS]
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in names]
    expected = f"expected_{rate}"
    met = met.select("camera", expected, F.coalesce("fps", F.lit(0.0)).alias("fps"), F.coalesce("gbps", F.lit(0.0)).alias("gbps"), *zero)
    reason = (
        F.when(F.col("frames") == 0, "no frames")
        .when(F.abs(F.col(rate) - F.col(expected)) > tolerance * F.col(expected), "rate")
        .when(F.col("gaps") + F.col("dropped_total") > allowed, "loss")
        .when(F.col("short_frames") > 0, "short frames")
    )
    if checks is not None:
        reason = reason.when(F.col("crc_bad") > 0, "checksums").when(F.col("flat_frames") > 0, "flat frames")
    return met.withColumn("reason", reason.otherwise("")).withColumn("pass", F.col("reason") == "")


def run_summary(verdict: DataFrame) -> DataFrame:
    """One row: the cameras, their payload together, and whether all pass."""
    return verdict.agg(F.count("*").alias("cameras"), F.sum("gbps").alias("aggregate_gbps"), F.bool_and("pass").alias("all_pass"))


def time_ns() -> Column:
    """Capture time in nanoseconds; null without seconds."""
    return (F.col("timestamp_s") * SECOND + F.coalesce("timestamp_ns", F.lit(0))).cast("long")


def rate_limited(frames: DataFrame, least_seconds: float, time: Column | None = None) -> DataFrame:
    """(camera, arrival) of frames that a limiter lets pass: the first, then each at least so long after the last that passed.

    Frames come in order of time (time_ns() unless told otherwise), of one time in order of arrival. Frames without a time
    don't pass, unless least_seconds is 0 or less: then all with a time do.
    """
    timed = frames.select("camera", "arrival", (time_ns() if time is None else time).alias("t")).where(F.col("t").isNotNull())
    least = round(least_seconds * SECOND)
    return (timed if least <= 0 else spaced(timed, least)).select("camera", "arrival")


def spaced(timed: DataFrame, least: int) -> DataFrame:
    """Of rows (camera, arrival, t) the first of each camera, then each at least ``least`` after the last one taken.

    Of the rows of one time only the first to come can be taken. Times go into ranges. What was taken before a range
    holds back less than ``least`` of it, so few times can be its first to be taken. Each range is walked from each of
    these, which gives a table of where it is left; the tables are followed in the order of ranges, and each range is
    walked from the time that is taken first. Only one range's times are ever in one task's memory.
    """
    width = max(RANGE * SECOND, 64 * least)
    times = timed.groupBy("camera", "t").agg(F.min("arrival").alias("arrival"))
    ranged = stored(times.withColumn("range", place_of("t", width)), "times")

    def tabulate(key: tuple, table: pa.Table) -> pa.Table:
        camera, number = (k.as_py() for k in key)
        t = np.sort(table.column("t").to_numpy())
        onward, last = np.searchsorted(t, t + least), np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if onward[i] < len(t):
                last[i] = last[onward[i]]
        n = min(len(t), int(np.searchsorted(t, t[0] + least)) + 1)
        return pa.table({"camera": pa.array([camera] * n, pa.string()), "range": pa.array([number] * n, pa.int64()), "enter": t[:n], "leave": t[last[:n]]})

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done, free = (), None, None
        for b in batches:
            out: list[tuple] = []
            for camera, number, enter, leave in zip(*(b.column(c).to_pylist() for c in ("camera", "range", "enter", "leave"))):
                if at != (camera,):
                    at, done, free = (camera,), None, enter
                if number != done and enter >= free:
                    out.append((camera, number, enter))
                    done, free = number, leave + least
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["by", "at", "start"])

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, kept = table.column("t").to_numpy(), []
        i = int(np.searchsorted(t, table.column("start")[0].as_py()))
        while i < len(t):
            kept.append(i)
            i = int(np.searchsorted(t, t[i] + least))
        return table.select(["camera", "arrival", "t"]).take(pa.array(kept, pa.int64()))

    tables = ranged.groupBy("camera", "range").applyInArrow(tabulate, "camera string, range long, enter long, leave long")
    starts = tables.repartition("camera").sortWithinPartitions("camera", "range", "enter").mapInArrow(follow, "by string, at long, start long")
    met = ranged.join(starts, F.col("camera").eqNullSafe(F.col("by")) & (F.col("range") == F.col("at"))).drop("by", "at")
    return met.groupBy("camera", "range").applyInArrow(walk, "camera string, arrival long, t long")


def reports(frames: DataFrame, seconds: float, time: Column | None = None) -> DataFrame:
    """The reports of each camera's statistics: one at the first frame ``seconds`` or more after the last, and one at the end.

    Time begins at the camera's first frame; frames come in order of time and arrival, and a report counts its own frame.
    A row has report_ns and arrival, the frame that it came with, the frames and bytes since the last report, interval_s,
    fps and gbps over that interval (0 without time), and total_frames, total_bytes and mean_fps since the start. Frames
    without a camera or a time don't count.

    Report times are taken range by range (spaced()); frames meet the report that counts them within ranges of time, and
    what comes after a range's last report is carried on by one row a range.
    """
    if seconds <= 0:
        raise ValueError("an interval is longer than nothing")
    timed = frames.select("camera", "arrival", (time_ns() if time is None else time).alias("t"), F.coalesce(frame_bytes(), F.lit(0)).alias("size"))
    timed = timed.where(F.col("t").isNotNull() & F.col("camera").isNotNull())
    ends = timed.groupBy("camera").agg(F.min("t").alias("begin"), F.max(F.struct("t", "arrival")).alias("end"))
    taken = spaced(timed.select("camera", "arrival", "t"), round(seconds * SECOND)).join(ends.select("camera", "begin"), "camera").where(F.col("t") > F.col("begin"))
    marks = stored(taken.select("camera", "t", "arrival").union(ends.select("camera", "end.t", "end.arrival")).distinct(), "reports")

    width = max(RANGE * SECOND, round(64 * seconds * SECOND))
    place = place_of("t", width).alias("range")
    both = timed.select("camera", place, "t", "arrival", F.lit(0).alias("side"), "size").unionByName(marks.select("camera", place, "t", "arrival", F.lit(1).alias("side"), F.lit(None).cast("long").alias("size")))
    mark = F.when(F.col("side") == 1, F.struct("t", "arrival"))
    ahead = Window.partitionBy("camera", "range").orderBy(F.desc("t"), F.desc("arrival"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("camera").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy("camera", "range").agg(F.min(mark).alias("mark"))
    carried = firsts.select("camera", "range", F.last("mark", ignorenulls=True).over(behind).alias("later"))
    met = both.withColumn("next", F.last(mark, ignorenulls=True).over(ahead)).where("side = 0").join(carried, ["camera", "range"])
    sums = met.groupBy("camera", F.coalesce("next", "later").alias("mark")).agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"))
    rows = sums.select("camera", F.col("mark.t").alias("report_ns"), F.col("mark.arrival").alias("arrival"), "frames", "bytes")

    rows = running(rows.withColumn("at", place_of("report_ns", width)), ["camera"], "at", ["report_ns", "arrival"], {"frames": "total_frames", "bytes": "total_bytes"}, previous={"report_ns": "last_ns"})
    rows = rows.join(ends.select("camera", "begin"), "camera")
    since = (F.col("report_ns") - F.coalesce("last_ns", "begin")) / float(SECOND)
    whole = (F.col("report_ns") - F.col("begin")) / float(SECOND)
    rate = lambda x, time: F.when(time > 0, x / time).otherwise(0.0)
    return rows.select(
        "camera", "report_ns", "arrival", "frames", "bytes", since.alias("interval_s"),
        rate(F.col("frames"), since).alias("fps"), (rate(F.col("bytes") * 8, since) / 1e9).alias("gbps"),
        "total_frames", "total_bytes", rate(F.col("total_frames"), whole).alias("mean_fps"),
    )


def place_of(column: str, width: int) -> Column:
    return F.expr(f"floor({column} / {width}D)")


def publish_sequence(frames: DataFrame) -> DataFrame:
    """Frames with the sequence number that publishing gives them."""
    return sampled(frames, 1)


def warm_window(frames: DataFrame, warm_s: int, end_s: int) -> DataFrame:
    """Totals of frames captured after the warm-up and up to the end, in seconds from the camera's first frame."""
    starts = frames.groupBy("camera").agg(F.min("timestamp_s").alias("__first"))
    age = F.col("timestamp_s") - F.col("__first")
    return totals(frames.join(starts, "camera").where((age > warm_s) & (age <= end_s)), F.lit(end_s - warm_s))


def window_or_run(frames: DataFrame, warm_s: int, end_s: int) -> DataFrame:
    """Each camera's rates between two snapshots, and over its whole run where it wasn't seen after the warm-up."""
    run, window = totals(frames, span()), warm_window(frames, warm_s, end_s)
    met = run.join(window.select("camera", *[F.col(c).alias(f"w_{c}") for c in ("frames", "fps", "gbps")]), "camera", "left")
    seen = F.col("w_frames").isNotNull()
    return met.select("camera", seen.alias("windowed"), *[F.when(seen, F.col(f"w_{c}")).otherwise(F.col(c)).alias(c) for c in ("fps", "gbps")])


def intervals(frames: DataFrame, dark: Column) -> DataFrame:
    """Each camera's parts, how many are dark, and the least, most and mean seconds from one to the next."""
    gap = F.col("timestamp_s") - F.col("__last")
    met = with_previous(frames.select("camera", "arrival", "timestamp_s", dark.alias("dark")), "timestamp_s", "__last")
    return met.groupBy("camera").agg(F.count("*").alias("parts"), F.count_if("dark").alias("black"), F.min(gap).alias("least"), F.max(gap).alias("most"), F.avg(gap).alias("mean"))
