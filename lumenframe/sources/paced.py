"""Emulated cameras as a streaming data source: frames come at each camera's own rate, up to a limit.

Frame i of a camera is due at ``start`` + i periods, whether anybody reads it or not; it shows the test pattern whose bar
moves by one step every PHASE frames. So a frame follows from its number alone: a stream that stopped goes on at its
offset, and a batch that runs again gives the same rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lumenframe.sources.blobs import packed

SCHEMA = "camera string, frame long, phase long, due_us long, data binary"
ARROW = pa.schema([("camera", pa.string()), ("frame", pa.int64()), ("phase", pa.int64()), ("due_us", pa.int64()), ("data", pa.binary())])
#: Frames that show the same picture, and the rate of a camera that tells none.
PHASE, USUAL_FPS = 8, 30.0
#: Frames that one task makes, frames of a batch that it hands over, and pictures that it remembers.
PART_FRAMES, BATCH_FRAMES, PICTURES = 10_000, 200, 4


def pattern(width: int, height: int, bits: int, phase: int) -> np.ndarray:
    """The samples of operators.imaging.test_frame, as lines."""
    top, bar = (1 << bits) - 1, phase * 16 % width
    y, x = np.indices((height, width))
    v = np.full((height, width), top // 3)
    v = np.where((x % 2 == 0) & (y % 2 == 0), x * top // width, v)
    v = np.where((x % 2 == 1) & (y % 2 == 1), y * top // height, v)
    return np.where((x >= bar) & (x <= bar + 31), top, v).astype(np.int32)


def payload(width: int, height: int, bits: int, phase: int) -> bytes:
    """The pattern as packed lines, each filled up to eight bytes."""
    lines = packed(pattern(width, height, bits, phase), bits)
    return np.pad(lines, ((0, 0), (0, -lines.shape[1] % 8))).tobytes()


@dataclass
class Camera:
    name: str
    period_us: int
    limit: int

    @classmethod
    def of(cls, told: dict) -> Camera:
        fps = float(told.get("fps") or 0)
        return cls(told["camera"], max(1, int(1e6 / (fps if fps > 0 else USUAL_FPS))), int(told.get("limit") or 0))

    def due(self, since_us: int) -> int:
        """How many frames are due so long after the start."""
        n = since_us // self.period_us + 1 if since_us >= 0 else 0
        return min(n, self.limit) if self.limit else n


@dataclass
class Span(InputPartition):
    camera: str
    period_us: int
    begin: int
    end: int


class PacedReader(DataSourceStreamReader):
    """The offset is the number of frames that each camera has sent."""

    def __init__(self, cameras: list[Camera], start_us: int, width: int, height: int, bits: int) -> None:
        self.cameras, self.start_us, self.shape = cameras, start_us, (width, height, bits)

    def initialOffset(self) -> dict:
        return {c.name: 0 for c in self.cameras}

    def latestOffset(self) -> dict:
        since = time.time_ns() // 1000 - self.start_us
        return {c.name: c.due(since) for c in self.cameras}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for c in self.cameras:
            first, last = start.get(c.name, 0), end.get(c.name, 0)
            out += [Span(c.name, c.period_us, i, min(i + PART_FRAMES, last)) for i in range(first, last, PART_FRAMES)]
        return out

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        drawn, content, known = -1, b"", {}
        for first in range(part.begin, part.end, BATCH_FRAMES):
            rows = []
            for i in range(first, min(first + BATCH_FRAMES, part.end)):
                if i // PHASE != drawn:
                    drawn = i // PHASE
                    bar = drawn * 16 % self.shape[0]  # all that the picture depends on
                    if bar not in known and len(known) == PICTURES:
                        known.pop(next(iter(known)))
                    content = known[bar] = known[bar] if bar in known else payload(*self.shape, drawn)
                rows.append((part.camera, i, drawn, self.start_us + i * part.period_us, content))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class PacedCameras(DataSource):
    """Options: ``cameras``, a JSON list of {camera, fps, limit} (limit 0: none); ``start``, when the first frame is due, in
    microseconds since 1970, which a stream that is started again must be given again; width, height and bits."""

    @classmethod
    def name(cls) -> str:
        return "paced_cameras"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PacedReader:
        cameras = [Camera.of(c) for c in json.loads(self.options["cameras"])]
        if len({c.name for c in cameras}) < len(cameras):
            raise ValueError("two cameras have the same name")
        if "start" not in self.options:
            raise ValueError("start is needed: a stream that goes on later keeps its pace by it")
        return PacedReader(cameras, int(self.options["start"]), *(int(self.options.get(k, v)) for k, v in (("width", 64), ("height", 16), ("bits", 12))))


def paced(spark: SparkSession, cameras: list[dict], start_us: int, width: int = 64, height: int = 16, bits: int = 12) -> DataFrame:
    """A stream of the cameras' frames (SCHEMA)."""
    spark.dataSource.register(PacedCameras)
    shape = {"width": width, "height": height, "bits": bits}
    return spark.readStream.format("paced_cameras").options(cameras=json.dumps(cameras), start=start_us, **shape).load()
