"""IVF files as a Spark data source: ``spark.read.format("ivf")`` and ``df.write.format("ivf")``.

Folders are URIs that pyarrow's file systems open (local, HDFS, S3, GCS); for other stores read the files by Spark's own
``binaryFile`` and split them by ``blobs.from_ivf``. Names that begin with ``_`` or ``.`` are passed over.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lumenframe.operators.ordering import segmented
from lumenframe.sources.blobs import IVF_FRAME, IVF_HEADER, IVF_MAGIC, SEGMENT

FRAMES = "file string, frame long, pts long, size long, data binary"
HEADERS = "file string, fourcc string, width int, height int, rate int, scale int, frames long, bytes long"
#: Bytes and frames of a batch that a reader hands over; bytes of a file that a writer holds in memory.
BATCH_BYTES, BATCH_FRAMES, HELD_BYTES = 8 << 20, 1_000, 32 << 20
#: The largest frame that the format can hold, and where its header has the number of frames.
LARGEST, COUNT_AT = (1 << 32) - 1, 24


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(folder)
    return files, base.rstrip("/")


def hidden(path: str, base: str) -> bool:
    return any(part[:1] in "_." for part in path[len(base) :].strip("/").split("/"))


@dataclass
class IvfFile(InputPartition):
    path: str
    name: str
    size: int


class IvfReader(DataSourceReader):
    """One partition for each file. Frames come in order; a file whose last frame is cut short ends before it, silently."""

    def __init__(self, folder: str, headers: bool) -> None:
        self.folder, self.headers = folder, headers

    def partitions(self) -> list[IvfFile]:
        files, base = opened(self.folder)
        told = files.get_file_info(base)
        if told.type == fs.FileType.NotFound:
            raise ValueError(f"{self.folder} isn't there")
        found = [told] if told.is_file else files.get_file_info(fs.FileSelector(base, recursive=True))
        top = base.rpartition("/")[0] if told.is_file else base
        named = [x for x in found if x.is_file and x.path.endswith(".ivf") and not hidden(x.path, top)]
        return [IvfFile(x.path, x.path[len(top) :].strip("/").removesuffix(".ivf"), x.size) for x in sorted(named, key=lambda x: x.path)]

    def read(self, part: IvfFile | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without files
            return
        files, _ = opened(self.folder)
        with files.open_input_stream(part.path) as stream:
            head = stream.read(IVF_HEADER.size)
            if len(head) < IVF_HEADER.size:
                raise ValueError(f"{part.path} is no IVF file: its header is cut short")
            magic, version, size, fourcc, width, height, rate, scale, count, _ = IVF_HEADER.unpack(head)
            if (magic, version, size) != (IVF_MAGIC, 0, IVF_HEADER.size):
                raise ValueError(f"{part.path} is no IVF file of version 0")
            if self.headers:
                cells = [part.name, fourcc.decode("latin-1"), width, height, rate, scale, count, part.size]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, HEADER_SCHEMA)], schema=HEADER_SCHEMA)
                return
            frame, held, total = 0, [], 0
            while len(head := stream.read(IVF_FRAME.size)) == IVF_FRAME.size:
                size, pts = IVF_FRAME.unpack(head)
                data = stream.read(size)
                if len(data) < size:
                    break
                held.append((part.name, frame, pts, size, data))
                frame, total = frame + 1, total + size
                if total >= BATCH_BYTES or len(held) >= BATCH_FRAMES:
                    yield batch_of(held)
                    held, total = [], 0
            if held:
                yield batch_of(held)


FRAME_SCHEMA = pa.schema([("file", pa.string()), ("frame", pa.int64()), ("pts", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
HEADER_SCHEMA = pa.schema([("file", pa.string()), ("fourcc", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rate", pa.int32()), ("scale", pa.int32()), ("frames", pa.int64()), ("bytes", pa.int64())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FRAME_SCHEMA)], schema=FRAME_SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they are, and their names."""

    files: list[tuple[str, str]]


class IvfWriter(DataSourceArrowWriter):
    """Writes rows (file, pts, data), those of a file being together and in order in one task.

    Each attempt of a task writes into a folder of its own below ``_writing-...``; the commit moves the files of the
    attempts that ended well to their names, and an abort deletes all of that folder. So neither a task that fails nor
    one that runs twice leaves a file. With mode append a name that is taken is an error; overwrite deletes the IVF files
    that were there.
    """

    def __init__(self, folder: str, overwrite: bool, fourcc: bytes, width: int, height: int, rate: int, scale: int) -> None:
        if len(fourcc) != 4:
            raise ValueError("fourcc has four bytes")
        self.folder, self.overwrite, self.job = folder, overwrite, f"_writing-{uuid.uuid4().hex}"
        self.kind = (fourcc, width, height, rate, scale)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, base = opened(self.folder)
        task, done, current = TaskContext.get(), [], None
        own = f"{base}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        files.create_dir(own, recursive=True)
        seen: set[str] = set()

        def close(name: str, spool: tempfile.SpooledTemporaryFile, count: int) -> None:
            spool.seek(COUNT_AT)
            spool.write(count.to_bytes(4, "little"))
            spool.seek(0)
            at = f"{own}/{len(done)}.ivf"
            with files.open_output_stream(at) as out:
                while piece := spool.read(BATCH_BYTES):
                    out.write(piece)
            spool.close()
            done.append((at, name))

        try:
            for batch in batches:
                for name, pts, data in zip(*(batch.column(c) for c in ("file", "pts", "data"))):
                    name, data = name.as_py(), data.as_buffer() if data.is_valid else b""
                    if current is None or current[0] != name:
                        if current:
                            close(*current)
                        if name in seen:
                            raise ValueError(f"the rows of {name} aren't together")
                        seen.add(name)
                        spool = tempfile.SpooledTemporaryFile(HELD_BYTES)
                        spool.write(IVF_HEADER.pack(IVF_MAGIC, 0, IVF_HEADER.size, *self.kind, 0, 0))
                        current = (name, spool, 0)
                    if len(data) > LARGEST:
                        raise ValueError(f"a frame of {name} is larger than the format holds")
                    current[1].write(IVF_FRAME.pack(len(data), pts.as_py()))
                    current[1].write(data)
                    current = (name, current[1], current[2] + 1)
            if current:
                close(*current)
        except BaseException:
            files.delete_dir(own)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = opened(self.folder)
        made = [x for m in messages if m for x in m.files]
        names = [n for _, n in made]
        if len(set(names)) < len(names):
            raise ValueError("two tasks wrote the same file: repartition by file")
        there = [x.path for x in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if x.is_file and x.path.endswith(".ivf") and not hidden(x.path, base)]
        taken = {f"{base}/{n}.ivf" for n in names} & set(there)
        if taken and not self.overwrite:
            raise ValueError(f"{min(taken)} is there already")
        for path in there if self.overwrite else []:
            files.delete_file(path)
        for at, name in made:
            target = f"{base}/{name}.ivf"
            files.create_dir(target.rpartition("/")[0], recursive=True)
            files.move(at, target)
        self.clean(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        self.clean(*opened(self.folder))

    def clean(self, files: fs.FileSystem, base: str) -> None:
        if files.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{self.job}")


class IvfFiles(DataSource):
    """Options for reading: ``rows``, frames (the default) or headers. For writing: fourcc, width, height, rate and scale."""

    @classmethod
    def name(cls) -> str:
        return "ivf"

    def schema(self) -> str:
        return HEADERS if self.headers() else FRAMES

    def headers(self) -> bool:
        rows = self.options.get("rows", "frames")
        if rows not in ("frames", "headers"):
            raise ValueError("rows are frames or headers")
        return rows == "headers"

    def reader(self, schema) -> IvfReader:
        return IvfReader(self.options["path"], self.headers())

    def writer(self, schema, overwrite: bool) -> IvfWriter:
        numbers = [int(self.options.get(k, v)) for k, v in (("width", 64), ("height", 64), ("rate", 30), ("scale", 1))]
        return IvfWriter(self.options["path"], overwrite, self.options.get("fourcc", "AV01").encode("latin-1"), *numbers)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(IvfFiles)
    return spark


def write_ivf(frames: DataFrame, folder: str, most: int = SEGMENT, mode: str = "append", **options: str) -> None:
    """Writes frames (stream, pts, data) as IVF files STREAM/SEGMENT.ivf of a folder; the payload is moved once."""
    registered(frames.sparkSession)
    named = segmented(frames, most).withColumn("file", F.format_string("%s/%08d", F.col("stream").cast("string"), "segment"))
    ordered = named.select("file", "pts", "data").repartition("file").sortWithinPartitions("file", "pts")
    ordered.write.format("ivf").options(**options).mode(mode).save(folder)


def read_ivf(spark: SparkSession, folder: str, rows: str = "frames") -> DataFrame:
    return registered(spark).read.format("ivf").option("rows", rows).load(folder)
