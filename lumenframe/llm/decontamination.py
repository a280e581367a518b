"""Benchmark decontamination by greedy string tiling.

Texts are compared as words: runs of letters and digits in lower case. Seeds are runs of LEAST words that a document
shares with a benchmark item. Tiles that cover enough of an item hold a certain number of its seeds, so one of its rarest
is among them: documents meet items by those alone, and a run that all items have brings no pair about. Where the words
that all shared seeds touch could cover enough of the item, its words are tiled: the longest run that document and item
share among unmarked words is found by Karp-Rabin hashes of all runs of a length, marked in both, and so on down to LEAST
words. Words are compared by hash, and those of the tiles then by their bytes. A document is contaminated by an item of
which its tiles cover at least the share THRESHOLD. Tiles may come in any order, so passages whose sentences were moved
are caught too.

The distinct texts of the benchmark are cut into blocks of bounded size, each broadcast and held against all documents in
a pass of its own.

Defined cases: null and empty texts have no words; items of fewer than LEAST words are never found; equally long runs
are marked in the item's order, each at the document's first free place; repeated rows and items are told each; a tile of
different words with equal hashes is none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.text import MIX, Words, buffers, hashed_words, mixed, slices

LEAST, THRESHOLD = 4, 0.5
#: Bytes of benchmark text in a block, about.
BLOCK_BYTES = 8_000_000
#: All ASCII bytes that aren't letters or digits part words.
GAP = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])
#: Places of an item's seeds that are looked at in one go.
CHUNK = 1 << 20
#: Bits of the table that tells most places without a seed.
BITS = 24


def worded(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """All words, where each text's begin with the end last, and the bytes that they are in."""
    data, starts = buffers(pc.utf8_lower(pc.cast(pc.fill_null(texts, ""), pa.large_string())))
    found = hashed_words(data, starts, GAP)
    return found, np.searchsorted(found.text, np.arange(len(texts) + 1)), data


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin with the end last."""
    found, starts, _ = worded(texts)
    return found.hash, starts


def spelled(found: Words, data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The bytes of some words."""
    return [data[b : b + n].tobytes() for b, n in zip(found.begin[at].tolist(), found.size[at].tolist())]


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the run of ``length`` words at each place, as far as it fits: a rolling polynomial, then mixed."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            out = out * MIX[0] + hashes[i : len(hashes) - length + 1 + i]
    return mixed(out)


class Rolling:
    """Karp-Rabin hashes of runs of any length, from those of all beginnings."""

    def __init__(self, hashes: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), MIX[0])]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.power[:-1])])

    def at(self, length: int, longest: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose run of ``length`` words is free, and the runs' hashes, brought to a common power."""
        busy = np.concatenate([[0], np.cumsum(~free)])
        place = np.flatnonzero(busy[length:] == busy[:-length]) if len(free) >= length else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            return place, (self.sums[place + length] - self.sums[place]) * self.power[longest - place]


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, words) of each tile, the longest first."""
    longest = len(doc) + len(item)
    pad = np.zeros(longest, np.uint64)
    left, right = Rolling(np.concatenate([doc, pad[: longest - len(doc)]])), Rolling(np.concatenate([item, pad[: longest - len(item)]]))
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out, top = [], min(len(doc), len(item))

    def shared(length: int) -> bool:
        return bool(np.isin(right.at(length, longest, free_item)[1], left.at(length, longest, free_doc)[1]).any())

    def pairs(length: int) -> Iterator[tuple[int, int]]:
        a, ha = left.at(length, longest, free_doc)
        b, hb = right.at(length, longest, free_item)
        order = np.argsort(ha, kind="stable")
        first, last = np.searchsorted(ha[order], hb), np.searchsorted(ha[order], hb, "right")
        for j, f, e in zip(b.tolist(), first.tolist(), last.tolist()):
            for k in range(f, e):
                if not free_item[j : j + length].all():
                    break
                yield int(a[order[k]]), j

    while top >= least:
        low, high = least - 1, top  # runs of low words are shared for sure, of more than high aren't
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        if low < least:
            break
        for i, j in pairs(low):
            if free_doc[i : i + low].all() and (doc[i : i + low] == item[j : j + low]).all():
                free_doc[i : i + low] = free_item[j : j + low] = False
                out.append((i, j, low))
        top = low - 1
    return out


@dataclass
class Block:
    """Words of some benchmark texts, and the rarest of their seeds sorted by hash with the text of each.

    ``keys`` has the SHA-256 of each text.
    """

    keys: list[str]
    found: Words
    data: np.ndarray
    starts: np.ndarray
    seeds: np.ndarray
    rare: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, texts: list[str], least: int = LEAST, threshold: float = THRESHOLD) -> Block:
        found, starts, data = worded(pa.array(texts, pa.string()))
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        seeds = runs(found.hash, least)
        whole = np.flatnonzero(owner[: len(seeds)] == owner[least - 1 :]) if len(seeds) else np.zeros(0, np.int64)
        kinds, at, often = np.unique(seeds[whole], return_inverse=True, return_counts=True)
        order = np.lexsort([at, often[at], owner[whole]])  # the rarest seeds of each text first
        text = owner[whole][order]
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        size = np.diff(starts)
        # tiles of at least ``least`` words that cover the share hold this many seeds or more
        needed = np.maximum(1, np.ceil(threshold * size / least)).astype(np.int64)
        first = rank <= (np.bincount(text, minlength=len(texts)) - needed)[text]
        rare, text = seeds[whole][order][first], text[first]
        order = np.lexsort([text, rare])
        return cls([sha256(t.encode()).hexdigest() for t in texts], found, data, starts, seeds, rare[order], text[order])

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, bool)
        out[self.rare >> np.uint64(64 - BITS)] = True
        return out

    def met(self, seeds: np.ndarray) -> np.ndarray:
        """The items that have one of some distinct seeds among their rarest."""
        first, last = np.searchsorted(self.rare, seeds), np.searchsorted(self.rare, seeds, "right")
        first, count = first[last > first], (last - first)[last > first]
        items = np.zeros(0, np.int64)
        for cut in np.array_split(np.arange(len(first)), int(count.sum()) // CHUNK + 1):
            n = count[cut]
            at = np.repeat(first[cut] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            items = np.union1d(items, self.owner[at])
        return items


def found_in(texts: pa.Array, block: Block, table: np.ndarray, least: int, threshold: float) -> Iterator[tuple[int, int, int, list]]:
    """(text, item, words covered, tiles) of each text that an item contaminates; tiles by place in the whole text."""
    found, starts, data = worded(texts)
    seeds = runs(found.hash, least)
    maybe = np.flatnonzero(table[seeds >> np.uint64(64 - BITS)])
    maybe = maybe[maybe + least <= starts[np.searchsorted(starts, maybe, "right")]]
    if len(maybe) and len(block.rare):
        maybe = maybe[block.rare[np.minimum(np.searchsorted(block.rare, seeds[maybe]), len(block.rare) - 1)] == seeds[maybe]]
    text = np.searchsorted(starts, maybe, "right") - 1
    for t in np.unique(text).tolist():
        begin, end = int(starts[t]), int(starts[t + 1])
        own = seeds[begin : end - least + 1]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        for i in block.met(np.unique(seeds[maybe[text == t]])).tolist():
            at, size = int(block.starts[i]), int(block.starts[i + 1] - block.starts[i])
            wanted = block.seeds[at : at + size - least + 1]
            first, last = np.searchsorted(ranked, wanted), np.searchsorted(ranked, wanted, "right")
            reach = np.zeros(size, bool)
            for step in range(least):
                reach[np.flatnonzero(last > first) + step] = True
            if reach.sum() < threshold * size:
                continue
            spans = np.unique(np.stack([first, last], axis=1)[last > first], axis=0)
            n = spans[:, 1] - spans[:, 0]
            hits = order[np.repeat(spans[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            spot = np.unique((hits[:, None] + np.arange(least)).ravel())
            # words that no seed touches are left out; a word that no text has stands for each gap
            gaps = np.flatnonzero(np.diff(spot) > 1) + 1
            near = np.insert(found.hash[begin + spot], gaps, np.uint64(0))
            spot = np.insert(spot, gaps, -1)
            laid = [(int(spot[a]), b, n) for a, b, n in tiles(near, block.found.hash[at : at + size], least)]
            laid = [x for x in laid if spelled(found, data, begin + x[0] + np.arange(x[2])) == spelled(block.found, block.data, at + x[1] + np.arange(x[2]))]
            covered = sum(n for _, _, n in laid)
            if laid and covered >= threshold * size:
                yield t, i, covered, laid


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, least: int = LEAST, threshold: float = THRESHOLD) -> Iterator[Block]:
    """The benchmark's distinct texts in blocks of about ``block_bytes``, dealt by a hash of the text."""
    texts = benchmark.where(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text")).distinct()
    n = int((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    for b in range(n):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).orderBy("text").collect()
        if rows:
            yield Block.of([r.text for r in rows], least, threshold)


TILES = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that contaminates it.

    item_words and covered_words of the item, coverage, and tiles with their place in the document's words, their place
    in the item's, and their length.
    """
    told = "item_words long, covered_words long, coverage double, tiles array<struct<doc_word:long,item_word:long,words:long>>"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_key string, {told}"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, block_bytes, least, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, table = shared.value, shared.value.table()
            for part in slices(batches):
                hits = list(found_in(part.column("text"), own, table, least, threshold))
                if not hits:
                    continue
                sizes = [int(own.starts[i + 1] - own.starts[i]) for _, i, _, _ in hits]
                tiled = [[{"doc_word": a, "item_word": b, "words": n} for a, b, n in laid] for *_, laid in hits]
                columns = [
                    part.column("doc_id").take(pa.array([t for t, *_ in hits])),
                    pa.array([own.keys[i] for _, i, _, _ in hits], pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array([c for _, _, c, _ in hits], pa.int64()),
                    pa.array([c / s for (_, _, c, _), s in zip(hits, sizes)], pa.float64()),
                    pa.array(tiled, TILES),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_key", "item_words", "covered_words", "coverage", "tiles"])

        out = out.unionByName(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema))
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", F.sha2(F.col("text").cast("string"), 256).alias("item_key"))
    return out.join(items, "item_key").select("doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    for block in blocks(benchmark, block_bytes, least, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, table = shared.value, shared.value.table()
            for part in slices(batches):
                clean = np.ones(part.num_rows, bool)
                clean[[t for t, *_ in found_in(part.column("text"), own, table, least, threshold)]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
