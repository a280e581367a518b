"""Frame statistics and a rate limiter with keyed state in a state store.

Frames of a camera are told apart by ranges of arrival, and each range has a state of its own: what its frames add up to,
with its first and last known numbers. So a task holds a range's frames of one batch, never a camera's, and the camera's
totals are folded from one row a range. Both need ``spark.sql.streaming.stateStore.providerClass`` to be RocksDB's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenframe.operators import telemetry

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frames of arrival that share a state.
RANGE = 100_000
NUMBERS = ("frames", "bytes", "gaps", "dropped", "first", "last", "counter_first", "counter")
STATE = ", ".join(f"{n} long" for n in NUMBERS)
RANGES = f"camera string, range long, {STATE}"
EMPTY = (0, 0, 0, 0, -1, -1, -1, -1)


def skipped(known: np.ndarray, before: int, jump: bool) -> tuple[int, int, int]:
    """(what is added, first, last) of known values in order after one that came before (-1: none).

    With ``jump`` numbers that were left out are counted, else what a counter grew by.
    """
    if not len(known):
        return 0, -1, before
    steps = np.diff(np.concatenate([[before], known]) if before >= 0 else known)
    return int(np.maximum(steps - jump, 0).sum()), int(known[0]), int(known[-1])


def advanced(state: tuple, frames: pd.DataFrame) -> tuple:
    """A range's state (NUMBERS; -1: unknown) after more of its frames, which came after those before."""
    n, size, gaps, dropped, first, last, counter_first, counter = state
    frames = frames.sort_values("arrival", kind="stable")
    number, count = frames["frame_number"].to_numpy(), frames["dropped"].to_numpy()
    more, one, last = skipped(number[number >= 0], last, True)
    grown, two, counter = skipped(count[count >= 0], counter, False)
    return (n + len(frames), size + int(frames["bytes"].sum()), gaps + more, dropped + grown, first if first >= 0 else one, last, counter_first if counter_first >= 0 else two, counter)


class FrameRanges(StatefulProcessor):
    """Keyed by camera and range: gives the state after each batch that had frames of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("range", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = advanced(tuple(self.state.get()) if self.state.exists() else EMPTY, pd.concat(list(rows)))
        self.state.update(state)
        yield pd.DataFrame([(*key, *state)], columns=["camera", "range", *NUMBERS])

    def close(self) -> None:
        pass


def range_states(frames: DataFrame, width: int = RANGE) -> DataFrame:
    """A stream of RANGES: the state of each camera's range of arrival, after each batch that had frames of it.

    Ids are null-free: frames without a camera are those of the camera ''. Without a watermark: frames count in order of
    arrival within a batch, and batches in their order.
    """
    known = [F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("frame_number", "dropped")]
    at = F.floor(F.col("arrival") / width).cast("long").alias("range")
    rows = frames.select(F.coalesce("camera", F.lit("")).alias("camera"), at, "arrival", *known, F.coalesce(telemetry.frame_bytes(), F.lit(0)).cast("long").alias("bytes"))
    return rows.groupBy("camera", "range").transformWithStateInPandas(FrameRanges(), RANGES, "Update", "None")


def folded(ranges: DataFrame) -> DataFrame:
    """Each camera's totals of the last states of its ranges, by a window over one row a range."""
    before = Window.partitionBy("camera").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    known = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("first", "last", "counter_first", "counter")}
    number, counter = (F.last(known[c], ignorenulls=True).over(before) for c in ("last", "counter"))
    met = ranges.withColumn("gap", F.greatest(F.lit(0), known["first"] - number - 1)).withColumn("growth", F.greatest(F.lit(0), known["counter_first"] - counter))
    out = met.groupBy("camera").agg(
        F.sum("frames").alias("frames"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.col("gaps") + F.coalesce("gap", F.lit(0))).alias("gaps"),
        F.sum(F.col("dropped") + F.coalesce("growth", F.lit(0))).alias("dropped_total"),
        F.min_by(known["first"], F.when(F.col("first") >= 0, F.col("range"))).alias("first_frame"),
        F.max_by(known["last"], F.when(F.col("last") >= 0, F.col("range"))).alias("last_frame"),
    )
    return out.fillna(-1, ["first_frame", "last_frame"])


def newest_ranges(rows: DataFrame) -> DataFrame:
    """The last state of each range, of RANGES rows of several batches with their ``batch``."""
    packed = rows.groupBy("camera", "range").agg(F.max_by(F.struct(*NUMBERS), "batch").alias("s"))
    return packed.select("camera", "range", "s.*")


class Limiter(StatefulProcessor):
    """Keyed by camera: frames pass that are ``least_ns`` or more after the last one that passed, in order of time.

    The state is when that was.
    """

    def __init__(self, least_ns: int) -> None:
        self.least_ns = least_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat([part[["time_ns", "arrival"]] for part in rows]).sort_values(["time_ns", "arrival"])
        t, kept = frames["time_ns"].to_numpy(), []
        i = int(np.searchsorted(t, self.last.get()[0] + self.least_ns)) if self.last.exists() else 0
        while i < len(t):
            kept.append(i)
            i = max(i + 1, int(np.searchsorted(t, t[i] + self.least_ns)))
        if kept:
            self.last.update((int(t[kept[-1]]),))
        yield pd.DataFrame({"camera": key[0], "arrival": frames["arrival"].to_numpy()[kept], "time_ns": t[kept]})

    def close(self) -> None:
        pass


def limited_stream(frames: DataFrame, least_ns: int) -> DataFrame:
    """A stream of the frames (camera, arrival, time_ns) that a limiter lets pass, whatever batches they come in.

    Only times and arrivals of a camera's batch are held. Frames without a time don't pass.
    """
    rows = frames.where(F.col("time_ns").isNotNull()).select("camera", F.col("arrival").cast("long").alias("arrival"), F.col("time_ns").cast("long").alias("time_ns"))
    return rows.groupBy("camera").transformWithStateInPandas(Limiter(least_ns), "camera string, arrival long, time_ns long", "Append", "None")
