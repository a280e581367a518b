"""Texts of Arrow batches as byte buffers, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a slice holds, unless one text is longer.
SLICE_BYTES = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that the texts of each part have ``limit`` bytes at most."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each starts with the end last. A null text is empty."""
    column = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


#: Bytes of white space as words are split by: space, tab to carriage return.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Odd numbers that bytes and hashes are mixed with.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        return x ^ (x >> np.uint64(31))


#: A number for each pair of a byte and its place in a word. Longer words are hashed by BLAKE2b.
PLACES = 64
BYTE_AT = mixed(np.arange(1, 256 * PLACES + 1, dtype=np.uint64) * MIX[0]).reshape(PLACES, 256)


@dataclass
class Words:
    """Words of some texts in order: a 64-bit hash, the text, the first byte and the length of each."""

    hash: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    size: np.ndarray


def hashed_words(data: np.ndarray, starts: np.ndarray, gap: np.ndarray = SPACE) -> Words:
    """Runs of bytes that aren't gaps. Equal words have equal hashes, everywhere and always."""
    if not len(data):
        return Words(*(np.zeros(0, kind) for kind in (np.uint64, np.int64, np.int64, np.int64)))
    solid = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]])))
    end = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))) + 1
    size = end - begin
    at = np.flatnonzero(solid)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        parts = BYTE_AT[place % PLACES, data[at]]
        total = mixed(np.add.reduceat(parts, np.cumsum(size) - size)) if len(size) else np.zeros(0, np.uint64)
    for i in np.flatnonzero(size > PLACES).tolist():
        total[i] = int.from_bytes(blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return Words(total, np.searchsorted(starts, begin, "right") - 1, begin, size)


def fresh(name: str, columns: Iterable[str]) -> str:
    """A name that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def kept_schema(rows: DataFrame, columns: list[str]) -> str:
    """DDL of some columns, with a comma after each."""
    return "".join(f"`{c.replace('`', '``')}` {rows.schema[c].dataType.simpleString()}, " for c in columns)


def with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Some columns, and the text under a name of its own."""
    return rows.select(*[F.col(f"`{c.replace('`', '``')}`") for c in columns], F.col("text").cast("string").alias(text))


def crc_fold(docs: DataFrame, folds: int) -> Column:
    """CRC-32 of doc_id as text, modulo folds. A null doc_id counts as an empty text."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(0)) % folds


def sampled(rows: DataFrame, key: list[str], group: str, most: int) -> DataFrame:
    """About ``most`` rows of each group, chosen by a hash of the key's columns, which is the same on every run.

    Groups are labels or languages, so few. Rows that repeat the whole key are drawn or left together.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("group_rows"))
    share = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(sizes), group).where(share * F.col("group_rows") < most).drop("group_rows")
