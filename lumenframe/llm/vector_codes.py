"""Product-quantiser codes of vectors by Lloyd's rounds with Elkan's bounds.

A vector's components become integers floor(SCALE * x) and its parts, equal consecutive slices, are coded one by one. For
each part the state holds its entry, an upper bound of the distance to it and a lower bound of the distance to each entry.
An entry is passed over only if its lower bound, or half the distance from the part's entry to it, is strictly above the
upper bound; what is left is compared by exact integer squared distances, ties going to the lower index. After an update
the bounds move by how far the entries moved. Bounds are rounded outwards: upper bounds up to a float, lower bounds down
to the upper half of a float's bits. So they never decide a tie, and the codes are those of comparing all.

The state is a stored table, written anew each round by tasks that see a batch at a time, without a shuffle; a table that
the next one replaces is deleted. What is collected are the codebooks' sums: parts * entries * components numbers.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are rows of
another length than the kept vector of smallest id has, or of a length that parts don't divide. Integers are held within
+-LARGEST, so that squared distances fit 64 bits. Entries start as the kept rows of smallest id (null ids last; equal ids
by vector); with fewer rows there are fewer entries. Rows may repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.llm.joins import left_join_hot

SCALE = 4096
#: Largest integer that a component becomes.
LARGEST = 1 << 26
STATE = "vec_id bigint, label string, vector array<int>, code binary, upper binary, lower binary, error bigint"


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of all components, held within +-LARGEST; null unless all components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    return F.when(fine, F.transform(vector, whole))


@dataclass
class Books:
    """Codebooks, as parts x entries x components, and how far each entry moved when they were made; work: distances counted."""

    entries: np.ndarray
    moved: np.ndarray | None = None
    half: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        apart = squared(self.entries[:, :, None, :], self.entries[:, None, :, :])
        self.half = down(np.sqrt(apart.astype(np.float64)) / 2)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.reshape(-1)).encode()).hexdigest()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=-1)


def up(x: np.ndarray) -> np.ndarray:
    """Floats that are no less than doubles which may be off by some roundings."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """Floats that are no more than doubles which may be off by some roundings, nor less than 0."""
    return np.maximum(np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def halves(x: np.ndarray) -> np.ndarray:
    """The upper 16 bits of floats of 0 or more: these floats, rounded down."""
    return (x.view(np.uint32) >> 16).astype(np.uint16)


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, part: int, books: Books, exact: bool) -> tuple[np.ndarray, ...]:
    """New (code, upper, lower, squared distance, distances counted) of one part's rows x; the distances only if exact."""
    c, half, n = books.entries[part], books.half[part], len(x)
    if books.moved is not None:
        upper = up(upper.astype(np.float64) + books.moved[part][code])
        lower = down(lower.astype(np.float64) - books.moved[part])
    code, lower, counted = code.copy(), lower.copy(), 0
    nearest, others = half.copy(), np.full(n, np.int64(-1))
    np.fill_diagonal(nearest, np.inf)
    open_ = np.arange(n) if exact else np.flatnonzero(upper >= nearest.min(axis=1)[code])
    if len(open_):
        others[open_] = squared(x[open_], c[code[open_]])
        counted += len(open_)
        root = np.sqrt(others[open_].astype(np.float64))
        upper = upper.copy()
        upper[open_] = up(root)
        lower[open_, code[open_]] = down(root)
    for j in range(len(c)):
        at = open_[(code[open_] != j) & (upper[open_] >= lower[open_, j]) & (upper[open_] >= half[code[open_], j])]
        if not len(at):
            continue
        d = squared(x[at], c[j])
        counted += len(at)
        root = np.sqrt(d.astype(np.float64))
        lower[at, j] = down(root)
        better = (d < others[at]) | ((d == others[at]) & (j < code[at]))
        at, d, root = at[better], d[better], root[better]
        code[at], others[at], upper[at] = j, d, up(root)
    return code, upper, lower, others, counted


def advanced(state: DataFrame, books: Books, parts: int, exact: bool = False) -> DataFrame:
    """The state (STATE) after every part was assigned anew; error is null unless exact."""
    shared, k = state.sparkSession.sparkContext.broadcast(books), books.entries.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = vectors(batch, parts)
            known = not batch.column("code").null_count
            of = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind)
            code = of("code", np.uint8).reshape(n, parts).astype(np.int64) if known else np.zeros((n, parts), np.int64)
            upper = of("upper", np.float32).reshape(n, parts) if known else np.full((n, parts), np.float32(np.inf))
            lower = (of("lower", np.uint16).astype(np.uint32) << 16).view(np.float32).reshape(n, parts, k) if known else np.zeros((n, parts, k), np.float32)
            made = [assign(x[:, p], code[:, p], upper[:, p], lower[:, p], p, b, exact or not known) for p in range(parts)]
            code, upper, lower, error = (np.stack([m[i] for m in made], axis=1) for i in range(4))
            new = {
                "code": pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()),
                "upper": pa.array([r.tobytes() for r in upper.astype(np.float32)], pa.binary()),
                "lower": pa.array([r.tobytes() for r in halves(np.ascontiguousarray(lower))], pa.binary()),
                "error": pa.array(error.sum(axis=1), pa.int64()) if exact else pa.nulls(n, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([new.get(c, None) if c in new else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return state.mapInArrow(run, STATE)


def vectors(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """A batch's vectors as rows x parts x components."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def moved(state: DataFrame, books: Books, parts: int) -> Books:
    """The codebooks after each entry was replaced by its parts' componentwise floor(sum / count); unused ones stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = vectors(batch, parts), np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            used = [(p, j, code[:, p] == j) for p in range(parts) for j in np.unique(code[:, p]).tolist()]
            sums = np.array([x[at, p].sum(axis=0) for p, _, at in used])
            d = sums.shape[1]
            cells = [np.repeat([u[0] for u in used], d), np.repeat([u[1] for u in used], d), np.tile(np.arange(d), len(used)), sums.reshape(-1), np.repeat([int(u[2].sum()) for u in used], d)]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cells], ["part", "entry", "at", "total", "rows"])

    sums = state.select("vector", "code").mapInArrow(run, "part bigint, entry bigint, at bigint, total bigint, rows bigint")
    entries = books.entries.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("rows").alias("rows")).collect():
        entries[r.part, r.entry, r["at"]] = int(r.total) // r.rows
    return Books(entries, np.sqrt(squared(entries, books.entries).astype(np.float64)))


def encode(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vector: str = "embedding") -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error) of the kept rows, and the last codebooks. code has a byte for each part; label is text."""
    if not 1 <= entries <= 256:
        raise ValueError("a code's byte holds 256 entries at most")
    spark, since = rows.sparkSession, storage.mark()
    ints = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), integers(F.col(vector), SCALE).alias("vector"))
    ints = ints.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = ints.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    size = len(first[0].vector) if first else parts
    ints = ints.where(F.size("vector") == size)
    least = ints.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    start = np.array([r.vector for r in least], np.int64).reshape(len(least), parts, size // parts)
    books = Books(np.ascontiguousarray(start.transpose(1, 0, 2)))
    state = ints.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("code", "upper", "lower")], F.lit(None).cast("bigint").alias("error"))
    if not least:
        return state.select("vec_id", "label", "code", "error"), books
    for _ in range(rounds):
        state = storage.stored(advanced(state, books, parts), "vector-codes")
        storage.discard(spark, since, keep=1)
        books = moved(state, books, parts)
    state = storage.stored(advanced(state, books, parts, exact=True).select("vec_id", "label", "code", "error"), "vector-codes")
    storage.discard(spark, since, keep=1)
    return state, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error of all rows of equal label, nulls together."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")).cast("binary")
    rows = coded.withColumn("label_key", key)
    totals = rows.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("label_rows"))
    return left_join_hot(rows, totals, "label_key", "label_rows").drop("label_key", "label_rows")
