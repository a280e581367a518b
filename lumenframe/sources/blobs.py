"""Packed sensor lines, IVF containers and checksums of byte payloads."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.ordering import segmented

#: Frames that one IVF file holds, and frames that are unpacked at once to be summed up.
SEGMENT, SUMMED = 1_000, 256
# Magic, version and header size of an IVF file; its header and frame header.
IVF_MAGIC, IVF_HEADER, IVF_FRAME = b"DKIF", struct.Struct("<4sHH4sHHIIII"), struct.Struct("<IQ")

PGM_HEADER = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")


def jamcrc(content: Column) -> Column:
    """The complement of the CRC-32 of IEEE 802.3."""
    return F.crc32(content).bitwiseXOR(F.lit(0xFFFFFFFF))


def flat_flags(rows: DataFrame, column: str, least: int = 64, kinds: int = 4, samples: int = 4096) -> DataFrame:
    """The rows with a flag in place of their bytes: whether evenly spaced 32-bit words have at most ``kinds`` values.

    Bytes of less than ``least``, and null, aren't flat.
    """

    def flat(content: pa.Buffer | None) -> bool:
        if content is None or content.size < least:
            return False
        words = np.frombuffer(content, np.uint32, content.size // 4)
        words = words[:: max(1, len(words) // samples)]
        return len(np.unique(words[:64])) <= kinds and len(np.unique(words)) <= kinds

    return _lines(rows, column, "boolean", lambda values: pa.array([flat(v.as_buffer() if v.is_valid else None) for v in values], pa.bool_()))


def packed(lines: np.ndarray, bits: int) -> np.ndarray:
    """Lines of samples as bytes: high bits first, then the low bits of four (10) or two (12) samples in one byte."""
    if bits == 10:
        v = lines.reshape(len(lines), -1, 4)
        low = ((v & 3) << np.arange(0, 8, 2)).sum(axis=2, keepdims=True)
        return np.concatenate([v >> 2, low], axis=2).astype(np.uint8).reshape(len(lines), -1)
    v = lines.reshape(len(lines), -1, 2)
    low = (v[:, :, :1] & 15) | ((v[:, :, 1:] & 15) << 4)
    return np.concatenate([v >> 4, low], axis=2).astype(np.uint8).reshape(len(lines), -1)


def unpacked(data: np.ndarray, bits: int) -> np.ndarray:
    if bits == 10:
        b = data.reshape(len(data), -1, 5).astype(np.int32)
        return ((b[:, :, :4] << 2) | ((b[:, :, 4:] >> np.arange(0, 8, 2)) & 3)).reshape(len(data), -1)
    b = data.reshape(len(data), -1, 3).astype(np.int32)
    low = np.concatenate([b[:, :, 2:] & 15, b[:, :, 2:] >> 4], axis=2)
    return ((b[:, :, :2] << 4) | low).reshape(len(data), -1)


def _lines(rows: DataFrame, column: str, schema: str, fn) -> DataFrame:
    keys = [c for c in rows.columns if c != column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], fn(b.column(column))], [*keys, "out"])

    ddl = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, f"{ddl}out {schema}").withColumnRenamed("out", column)


def pack_lines(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Arrays of samples, all of one length, as packed bytes."""

    def fn(lines: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in packed(np.array(lines.to_pylist(), np.int32), bits)], pa.binary())

    return _lines(rows, column, "binary", fn)


def unpack_lines(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Packed bytes, all of one length, as arrays of samples."""

    def fn(lines: pa.Array) -> pa.Array:
        data = np.frombuffer(b"".join(lines.to_pylist()), np.uint8).reshape(len(lines), -1)
        return pa.array(list(unpacked(data, bits).astype(np.int32)), pa.list_(pa.int32()))

    return _lines(rows, column, "array<int>", fn)


def sample_sums(rows: DataFrame, column: str, bits: int, width: int) -> DataFrame:
    """Frames of one size in place of which stands the sum of their samples; each of their lines is filled up to eight bytes.

    A frame is a row before and after, so this goes for streams too, and nothing is moved.
    """
    line = width * bits // 8
    stride = (line + 7) // 8 * 8

    def fn(frames: pa.Array) -> pa.Array:
        sums = []
        for at in range(0, len(frames), SUMMED):
            some = frames.slice(at, SUMMED).to_pylist()
            data = np.frombuffer(b"".join(some), np.uint8).reshape(-1, stride)[:, :line]
            sums.append(unpacked(data, bits).reshape(len(some), -1).sum(axis=1, dtype=np.int64))
        return pa.array(np.concatenate(sums))

    return _lines(rows, column, "long", fn)


def unpack_depths(rows: DataFrame, column: str, depth: str, depths: tuple[int, ...]) -> DataFrame:
    """Packed bytes of lines, each of the bits that ``depth`` tells and of any length, as arrays of samples, in one pass."""
    keys = [c for c in rows.columns if c != column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = zip(b.column(column), b.column(depth).to_pylist())
            out = [unpacked(np.frombuffer(x.as_buffer(), np.uint8)[None], n)[0].astype(np.int32) for x, n in told]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(out, pa.list_(pa.int32()))], [*keys, "out"])

    ddl = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.where(F.col(depth).isin(*depths)).mapInArrow(run, f"{ddl}out array<int>").withColumnRenamed("out", column)


def ivf_bytes(frames: list[tuple[int, bytes]], fourcc: bytes, width: int, height: int) -> bytes:
    head = IVF_HEADER.pack(IVF_MAGIC, 0, IVF_HEADER.size, fourcc, width, height, 30, 1, len(frames), 0)
    return head + b"".join(IVF_FRAME.pack(len(d), p) + bytes(d) for p, d in frames)


def to_ivf(frames: DataFrame, fourcc: bytes = b"AV01", width: int = 64, height: int = 64) -> DataFrame:
    """(stream, segment, content): frames (stream, pts, data) as IVF files of SEGMENT frames at most.

    Segments are counted in order of pts; only (stream, pts) are numbered, and the payload is moved to its segment once.
    Frames of equal pts share a segment, which then may have more.
    """

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pts")
        return pd.DataFrame({"stream": [key[0]], "segment": [key[1]], "content": [ivf_bytes(list(zip(rows.pts, rows.data)), fourcc, width, height)]})

    return segmented(frames, SEGMENT).groupBy("stream", "segment").applyInPandas(write, "stream long, segment long, content binary")


def ivf_frames(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(frame, pts, data) of an IVF file; a frame cut short ends it, another magic or version is an error."""
    if len(content) < IVF_HEADER.size or content[:4] != IVF_MAGIC or content[4:6] != b"\0\0":
        raise ValueError("not an IVF file of version 0")
    at, frame = int.from_bytes(content[6:8], "little"), 0
    while at + IVF_FRAME.size <= len(content):
        size, pts = IVF_FRAME.unpack_from(content, at)
        at += IVF_FRAME.size
        if at + size > len(content):
            return
        yield frame, pts, content[at : at + size]
        at, frame = at + size, frame + 1


def from_ivf(files: DataFrame) -> DataFrame:
    """(stream, segment, frame, pts, size, data) of files with stream, segment and content."""

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            rows = [(s, g, i, p, len(d), d) for s, g, c in zip(part.stream, part.segment, part.content) for i, p, d in ivf_frames(bytes(c))]
            yield pd.DataFrame(rows, columns=["stream", "segment", "frame", "pts", "size", "data"])

    return files.mapInPandas(read, "stream long, segment long, frame long, pts long, size long, data binary")


def pgm_bytes(samples: np.ndarray, top: int) -> bytes:
    """A binary PGM image of one or two bytes a sample, high byte first."""
    kind = ">u2" if top > 255 else np.uint8
    return b"P5\n%d %d\n%d\n" % (samples.shape[1], samples.shape[0], top) + samples.astype(kind).tobytes()


def pgm_samples(content: bytes) -> tuple[np.ndarray, int]:
    """The samples of a binary PGM image and its largest value; a short file is an error."""
    found = PGM_HEADER.match(content)
    if not found:
        raise ValueError("not a binary PGM image")
    width, height, top = (int(x) for x in found.groups())
    kind = np.dtype(">u2" if top > 255 else np.uint8)
    if len(content) - found.end() < width * height * kind.itemsize:
        raise ValueError("the PGM image is cut short")
    return np.frombuffer(content, kind, width * height, found.end()).reshape(height, width), top


def to_pgm(lines: DataFrame, top: int) -> DataFrame:
    """(plane, content): planes given as lines (plane, y, px) as PGM images; a plane is one task's work."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = np.stack(rows.sort_values("y").px.to_numpy())
        return pd.DataFrame({"plane": [key[0]], "content": [pgm_bytes(image, top)]})

    return lines.groupBy("plane").applyInPandas(write, "plane long, content binary")


def from_pgm(files: DataFrame) -> DataFrame:
    """(plane, y, px) of PGM images (plane, content)."""

    def read(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for plane, content in zip(part.plane, part.content):
                image = pgm_samples(bytes(content))[0].astype(np.int64)
                yield pd.DataFrame({"plane": plane, "y": np.arange(len(image)), "px": list(image)})

    return files.mapInPandas(read, "plane long, y long, px array<long>")


def jpeg_parts(content: bytes) -> list[bytes]:
    """The images of a byte stream, each from FFD8 to the next FFD9; one that is cut short is left out."""
    out, at = [], 0
    while (start := content.find(b"\xff\xd8", at)) >= 0 and (end := content.find(b"\xff\xd9", start)) >= 0:
        out.append(content[start : end + 2])
        at = end + 2
    return out


def split_jpegs(streams: DataFrame) -> DataFrame:
    """(stream, part, size, data) of byte streams (stream, content)."""

    def read(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(s, i, len(d), d) for s, c in zip(p.stream, p.content) for i, d in enumerate(jpeg_parts(bytes(c)))]
            yield pd.DataFrame(rows, columns=["stream", "part", "size", "data"])

    return streams.mapInPandas(read, "stream long, part long, size long, data binary")


def json_objects(text: Column) -> Column:
    """The top-level objects of concatenated JSON, told by the depth of braces alone, also of those within strings."""
    marks = F.filter(F.split(F.regexp_replace(text, r"([{}])", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x == "{", 1).when((x == "}") & (acc["depth"] > 0), -1).otherwise(0)
        now = F.when((acc["depth"] > 0) | (x == "{"), F.concat(acc["now"], x)).otherwise(acc["now"])
        ends = (x == "}") & (acc["depth"] == 1)
        return F.struct(depth.alias("depth"), F.when(ends, "").otherwise(now).alias("now"), F.when(ends, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(marks, start, step, lambda acc: acc["done"])


PGX_HEADER = re.compile(rb"PG\s+(ML|LM)\s*([+-]?)\s*(\d+)\s+(\d+)\s+(\d+)\s")


def pgx_samples(content: bytes) -> np.ndarray:
    """The samples of a PGX image: the header tells byte order, sign and bits; another header or a short file is an error."""
    found = PGX_HEADER.match(content)
    if not found:
        raise ValueError("not a PGX image")
    bits, width, height = (int(x) for x in found.groups()[2:])
    kind = np.dtype(f"{'i' if found[2] == b'-' else 'u'}{1 if bits <= 8 else 2 if bits <= 16 else 4}").newbyteorder(">" if found[1] == b"ML" else "<")
    if len(content) - found.end() < width * height * kind.itemsize:
        raise ValueError("the PGX image is cut short")
    return np.frombuffer(content, kind, width * height, found.end()).reshape(height, width)


def from_pgx(files: DataFrame) -> DataFrame:
    """(plane, y, px) of PGX images (plane, content)."""

    def read(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for plane, content in zip(part.plane, part.content):
                image = pgx_samples(bytes(content)).astype(np.int64)
                yield pd.DataFrame({"plane": plane, "y": np.arange(len(image)), "px": list(image)})

    return files.mapInPandas(read, "plane long, y long, px array<long>")


PNG_MARK = b"\x89PNG\r\n\x1a\n"


def png_bytes(samples: np.ndarray, top: int) -> bytes:
    """A grey PNG image of one or two bytes a sample; its lines aren't filtered."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    kind = np.dtype(">u2" if top > 255 else np.uint8)
    head = struct.pack(">IIBBBBB", samples.shape[1], samples.shape[0], 8 * kind.itemsize, 0, 0, 0, 0)
    lines = b"".join(b"\0" + line.tobytes() for line in samples.astype(kind))
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_samples(content: bytes) -> np.ndarray:
    """The samples of an image as png_bytes() writes it; a wrong checksum is an error."""
    at, parts = len(PNG_MARK), {}
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        data = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise ValueError("a checksum of the PNG image is wrong")
        parts[kind], at = data, at + 12 + size
    width, height, bits = struct.unpack(">IIB", parts[b"IHDR"][:9])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, -1)[:, 1:]
    return np.frombuffer(lines.tobytes(), ">u2" if bits == 16 else np.uint8).reshape(height, width)


def to_png(lines: DataFrame, top: int) -> DataFrame:
    """(plane, content): planes given as lines (plane, y, px) as PNG images; a plane is one task's work."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = np.stack(rows.sort_values("y").px.to_numpy())
        return pd.DataFrame({"plane": [key[0]], "content": [png_bytes(image, top)]})

    return lines.groupBy("plane").applyInPandas(write, "plane long, content binary")


def from_png(files: DataFrame) -> DataFrame:
    """(plane, y, px) of PNG images (plane, content)."""

    def read(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for plane, content in zip(part.plane, part.content):
                image = png_samples(bytes(content)).astype(np.int64)
                yield pd.DataFrame({"plane": plane, "y": np.arange(len(image)), "px": list(image)})

    return files.mapInPandas(read, "plane long, y long, px array<long>")
