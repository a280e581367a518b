"""Runs of periodic words, by Main and Lorentz's divide and conquer over interned word ids.

A run is a stretch of words with smallest period q, at least LEAST words and EXPONENT periods long, that no neighbouring
word extends. A stretch of a document is halved; every run in it that crosses the midpoint has two periods or more on one
side of it, so the Z-function of that side, read away from the midpoint, shows its period as a square that begins there.
Such squares are extended both ways. An interval that goes on beyond the stretch is left to the larger stretch that holds
all of it; intervals are kept once, with their smallest period; halves are treated alike.

Each word of a run occurs EXPONENT times in it at least, so stretches are cut at words that are rarer within them before
they are halved. That loses no run and leaves little of ordinary text.

Defined cases: words are what lies between white space (space, tab to carriage return); a null or empty text has no word
and no run, and an empty collapsed text; ids may be null or repeat, each row counts for itself; an empty table gives an
empty result. Texts are taken whole; one text's word ids are one task's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.text import fresh, kept_schema, slices, with_text

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A run has so many words and so many periods at least.
LEAST, EXPONENT = 6, 4
#: Stretches of so many words are searched for rare words before they are halved.
WORTH_CUTTING = 96
#: Words of longer texts are taken one by one, as a list of all of them would be large.
LONG_BYTES = 1 << 22
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_DDL = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Interned(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def z_values(s: Sequence[int], most: int) -> list[int]:
    """How far s agrees with itself moved by 0, 1, ... most words."""
    n, z, left, right = len(s), [len(s)], 0, 0
    for i in range(1, most + 1):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z.append(k)
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if k:
            left, right = i, i + k
        z.append(k)
    return z


def squares(s: Sequence[int], exponent: int) -> list[tuple[int, int]]:
    """(period, words beyond the first period that agree) of the squares that s begins with, of roots that are no powers."""
    found: list[tuple[int, int]] = []
    z = z_values(s, len(s) * 2 // exponent)
    for q in range(1, len(z)):
        if z[q] >= q and not any(q % p == 0 and p + e >= 2 * q for p, e in found):
            found.append((q, z[q]))
    return found


def stretches(ids: np.ndarray, start: int, least: int, exponent: int) -> list[tuple[int, int]]:
    """What is left of ids between words that occur less than ``exponent`` times, as (from, to) moved by start."""
    rare = np.bincount(ids)[ids] < exponent
    if not rare.any():
        return [(start, start + len(ids))]
    out, edges = [], np.flatnonzero(np.diff(np.concatenate([[True], rare, [True]]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a >= least:
            out += stretches(np.unique(ids[a:b], return_inverse=True)[1], start + a, least, exponent)
    return out


def runs(words: Sequence[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. Words are numbers from 0. exponent is 4 or more."""
    if exponent < 4:
        raise ValueError("runs of less than four periods may have less than two on either side of a midpoint")
    w, numbers, n = list(words), np.asarray(words, np.int64), len(words)
    todo, found = [(0, n, True)], {}
    while todo:
        low, high, cut = todo.pop()
        if high - low < least:
            continue
        if cut:
            todo += [(a, b, False) for a, b in stretches(np.unique(numbers[low:high], return_inverse=True)[1], low, least, exponent)]
            continue
        middle = (low + high) // 2
        for q, e in squares(w[middle:high], exponent):
            a, b = middle, middle + q + e
            while a > low and w[a - 1] == w[a - 1 + q]:
                a -= 1
            if b - a >= max(least, exponent * q) and not (a == low > 0 and w[a - 1] == w[a - 1 + q]) and not (b == high < n and w[b] == w[b - q]):
                found[a, b] = min(q, found.get((a, b), q))
        for q, e in squares(w[low:middle][::-1], exponent):
            a, b = middle - q - e, middle
            while b < high and w[b] == w[b - q]:
                b += 1
            if b - a >= max(least, exponent * q) and not (a == low > 0 and w[a - 1] == w[a - 1 + q]) and not (b == high < n and w[b] == w[b - q]):
                found[a, b] = min(q, found.get((a, b), q))
        todo += [(a, b, b - a >= WORTH_CUTTING) for a, b in ((low, middle), (middle, high))]
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(n: int, found: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when all of a run but its first period goes."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def read(text: bytes, least: int, exponent: int) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """The number of words, the runs, and the words that stay joined by one space."""
    known = Interned()
    words = WORD.findall(text) if len(text) < LONG_BYTES else (m[0] for m in WORD.finditer(text))
    ids = np.fromiter(map(known.__getitem__, words), np.int32)
    found = runs(ids, least, exponent)
    kept = ids[collapsed(len(ids), found)] if found else ids
    return len(ids), found, b" ".join(map(list(known).__getitem__, kept.tolist()))


def find(docs: DataFrame, keep: Sequence[str] = ("doc_id",), least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The columns to keep, n_words, runs (start, length, period; by start and period) and collapsed, of every row of docs.

    Names that are taken by kept columns get an underscore before them.
    """
    text, count, spans, rest = (fresh(x, keep) for x in ("text", "n_words", "runs", "collapsed"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            told = [read(t.as_buffer().to_pybytes() if t.is_valid else b"", least, exponent) for t in part.column(text)]
            found = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x[1]] for x in told], pa.list_(RUN))
            left = pa.array([x[2] for x in told], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array([x[0] for x in told], pa.int64()), found, left], [*keep, count, spans, rest])

    return with_text(docs, list(keep), text).mapInArrow(run, f"{kept_schema(docs, list(keep))}{count} bigint, {spans} {RUN_DDL}, {rest} string")


def longest(spans: Column) -> Column:
    """The longest run of an array of runs, of equal ones the one with the smallest start, then period; null without any."""
    best = F.array_max(F.transform(spans, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def repeated_from_within(docs: DataFrame) -> DataFrame:
    """doc_id and text of all rows; about a tenth of the texts get a periodic tail, as a hash of doc_id decides.

    With h the CRC-32 of doc_id as text, g = h div 10 and n words: if h % 10 = 0, each word from number a = g % n on
    becomes word a + (i - a) % p of the text, where p = 1 + (n - a) div (3 + g % 8). Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", h)
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, split)).withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)"))).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    tail = F.expr("array_join(transform(w, (x, i) -> IF(i < a, x, w[a + (i - a) % p])), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))
