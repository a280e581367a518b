"""Near-duplicates by a MinHash LSH forest, confirmed on full sets.

A document is the set of its word shingles; documents with equal sets form a class, and one row of each class goes on.
The forest has TREES orders of the classes, each sorted by DEPTH MinHash values of its own. Neighbours in an order are
those with the longest common prefixes: a class is compared with up to WINDOW others on each side that share at least
LEAST_DEPTH values with it. Where a region of an order is sparse, these reach down to short prefixes; where it is dense,
only long ones come so near, so the depth adapts to each region without a setting. Compared are sketches of all MinHash
values; of those that could reach the similarity, each class names its best by the whole sketch and the best by halves
of it that differ from tree to tree, so that one neighbour that looks closer than it is doesn't hide another. Named pairs
are linked if their full sets reach the similarity. They are looked at best first, in rounds, and a pair within one
component is not looked at; in the end every named pair has been looked at or lies within a component, so none of their
links is lost.

An order is cut into ranges of rows, so hot regions spread over tasks. Windows, names and cuts bound what the orders show,
not what is found: a class whose window or list of names was full, or whose region a cut runs through, is noted with its
region (the rows of a tree that share LEAST_DEPTH values). After the rounds the noted classes of each region that lie in
different components are compared in blocks, all with all, and confirmed on full sets. In a crowded region, where a class
would meet more than CROWD others, that would grow with the square of its classes. There a class meets only those that
share one of its rarest shingles with it, of which similar sets must share one: where a fifth of a text's shingles is its
own, what a template gives all texts is not among its rarest, so these groups stay small while the region grows. Classes
with less of their own share even their rarest shingles with a crowd; those are compared in blocks after all, among
themselves. So every pair that shares LEAST_DEPTH values in some tree and whose sketches could reach the similarity is
linked if its sets reach it, however dense the region.

What no tree and no sketch shows can still be missed. With ``exact`` it is found too: all classes meet by their rarest
shingles, and are compared in blocks on full sets without a sketch.

Defined cases: null texts and texts without words have an empty set and no links; a text with fewer words than a
shingle is one shingle; equal sets are linked whatever the ids; a null doc_id takes part but is never a component's id
unless all its ids are null; repeated rows are linked to each other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.components import components
from lumenframe.llm.joins import FEW_IDS, left_join_hot
from lumenframe.llm.text import MIX, buffers, hashed_words, mixed, slices
from lumenframe.storage import stored

SHINGLE, PERCENT = 5, 80
TREES, DEPTH, LEAST_DEPTH, WINDOW = 16, 8, 2, 32
#: MinHash values that two sketches must share, by this many standard deviations less than expected.
DEVIATIONS = 4.0
#: Neighbours that a class names in each order by the whole sketch, and by each of some halves of it.
NAMED, NAMED_BY_HALF, HALF_SKETCHES = 6, 1, 2
#: How many times as many of a class's named pairs the next round looks at. Each round reads all pairs that are left.
GROWTH = 16
#: Classes of a region that are compared with as many others in one task.
BLOCK = 512
#: Classes of other components that a class may meet in a region, on average, before its classes meet by rare shingles instead.
CROWD = 8 * BLOCK
#: Shingles of two blocks that are counted at once.
COLUMNS = 8_192

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
ADDENDS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
#: For each tree, the halves of the sketch that further names go by, as columns of ones and zeros.
HALVES = (np.argsort(_rng.random((TREES, TREES * DEPTH, HALF_SKETCHES)), axis=1) % 2).astype(np.float32)


def least_shared(percent: int) -> int:
    j = percent / 100
    return int(np.floor(TREES * DEPTH * j - DEVIATIONS * np.sqrt(TREES * DEPTH * j * (1 - j))))


def shingle_sets(data: np.ndarray, starts: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, and where each text's begin with the end last.

    Words are runs of bytes other than ASCII white space, with A to Z in lower case.
    """
    upper = (data >= 65) & (data <= 90)
    words = hashed_words(np.where(upper, data + np.uint8(32), data), starts)
    n = len(starts) - 1
    count = np.bincount(words.text, minlength=n)
    first = np.cumsum(count) - count
    size = np.minimum(count, shingle)  # words in one of the text's shingles
    many = np.where(count > 0, count - size + 1, 0)
    text = np.repeat(np.arange(n), many)
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(shingle):
            has = i < size[text]
            out = np.where(has, out * MIX[0] + words.hash[np.minimum(at + i, max(len(words.hash) - 1, 0))] + np.uint64(1), out)
        out = mixed(out ^ (size[text].astype(np.uint64) * MIX[1]))
    order = np.lexsort([out, text])
    out, text = out[order], text[order]
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (text[1:] != text[:-1])]) if len(out) else np.zeros(0, bool)
    return out[new], np.searchsorted(text[new], np.arange(n + 1))


def set_keys(hashes: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """Sixteen bytes of BLAKE2b over each set's sorted hashes; none for an empty one."""
    return [blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if a < b else None for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def minhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of MinHash values for each set; rows of empty sets mean nothing."""
    filled = np.flatnonzero(starts[1:] > starts[:-1])
    out = np.zeros((len(starts) - 1, TREES * DEPTH), np.uint32)
    if len(filled):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for j in range(TREES * DEPTH):
            out[filled, j] = np.minimum.reduceat((x ^ ADDENDS[j]) * FACTORS[j], starts[:-1][filled])
    return out


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, orders and sketch of every row.

    ``orders`` has DEPTH values of two bytes for each tree, ``sketch`` one byte of each value.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, starts = shingle_sets(*buffers(part.column("text")), shingle)
            values = minhashes(hashes, starts)
            orders, sketch = (values >> np.uint32(8)).astype(">u2"), values.astype(np.uint8)
            full = starts[1:] > starts[:-1]
            held = [[x[i].tobytes() if full[i] else None for i in range(len(full))] for x in (orders, sketch)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(np.diff(starts), pa.int64()), pa.array(set_keys(hashes, starts), pa.binary()), *[pa.array(x, pa.binary()) for x in held]],
                ["doc_id", "text_key", "n_shingles", "set_key", "orders", "sketch"],
            )

    texts = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, set_key binary, orders binary, sketch binary")


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def tree_rows(classes: DataFrame) -> DataFrame:
    """A row of each class for each tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            orders = fixed(b.column("orders"), TREES * DEPTH * 2).reshape(b.num_rows, TREES, DEPTH * 2)
            for t in range(TREES):
                prefix = [orders[i, t].tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array([t] * b.num_rows, pa.int32()), pa.array(prefix, pa.binary()), b.column("set_key"), b.column("sketch")], ["tree", "prefix", "set_key", "sketch"])

    return classes.select("set_key", "orders", "sketch").mapInArrow(run, "tree int, prefix binary, set_key binary, sketch binary")


def named_by(row: np.ndarray, pair: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` entries of each row with the highest value; of equal ones the earlier pair."""
    order = np.lexsort([pair, -value[pair], row])
    rows = row[order]
    return order[np.arange(len(order)) - np.searchsorted(rows, rows) < most]


def named_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, region): the pairs that classes name in the orders, a naming b, with the MinHash values they share.

    Rows with a region instead of b note a class that may have more neighbours in that region than the order shows.
    """
    least = least_shared(percent)

    def noted(key: np.ndarray, region: np.ndarray) -> pa.RecordBatch:
        held = [pa.array([x.tobytes() for x in at], pa.binary()) for at in (key, region)]
        return pa.RecordBatch.from_arrays([held[0], pa.nulls(len(key), pa.binary()), pa.nulls(len(key), pa.int32()), held[1]], ["a", "b", "shared", "region"])

    def region_of(tree: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return np.concatenate([tree[:, None].astype(np.uint8), prefix[:, : 2 * LEAST_DEPTH]], axis=1)

    def look(held: list[tuple], carry: int) -> Iterator[pa.RecordBatch]:
        tree, prefix, key, sketch = (np.concatenate(x) for x in zip(*held))
        n = len(tree)
        region, full = region_of(tree, prefix), np.zeros(len(tree), bool)
        if n > WINDOW + 1:
            beyond = (region[WINDOW + 1 :] == region[: -WINDOW - 1]).all(axis=1)
            full[: -WINDOW - 1] |= beyond
            full[WINDOW + 1 :] |= beyond
        left, right, whole, half = [], [], [], []
        for gap in range(1, min(WINDOW, n - 1) + 1):
            near = np.flatnonzero((region[gap:] == region[:-gap]).all(axis=1))
            if not len(near):
                break
            near = near[near + gap >= carry]  # pairs within the rows carried over were looked at before
            for some in np.array_split(near, len(near) // 20_000 + 1):
                same = sketch[some] == sketch[some + gap]
                shared = same.sum(axis=1)
                some, same, shared = some[shared >= least], same[shared >= least], shared[shared >= least]
                left.append(some)
                right.append(some + gap)
                whole.append(shared)
                half.append(np.einsum("ij,ijk->ik", same.astype(np.float32), HALVES[tree[some]]))
        if left:
            left, right, whole, half = (np.concatenate(x) for x in (left, right, whole, half))
            row, other, pair = np.concatenate([left, right]), np.concatenate([right, left]), np.tile(np.arange(len(left)), 2)
            full |= np.bincount(row, minlength=n) > NAMED
            by_half = [named_by(row, pair, half[:, k], NAMED_BY_HALF) for k in range(HALF_SKETCHES)]
            named = np.unique(np.concatenate([named_by(row, pair, whole, NAMED), *by_half]))
            ends = [pa.array([x.tobytes() for x in key[at[named]]], pa.binary()) for at in (row, other)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(whole[pair[named]].astype(np.int32)), pa.nulls(len(named), pa.binary())], ["a", "b", "shared", "region"])
        if full.any():
            yield noted(key[full], region[full])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, seen = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            now = (b.column("tree").to_numpy(), fixed(b.column("prefix"), 2 * DEPTH), fixed(b.column("set_key"), 16), fixed(b.column("sketch"), TREES * DEPTH))
            yield from look([last, now] if last else [now], len(last[0]) if last else 0)
            if seen <= WINDOW:  # the region that the range's start may cut
                head = region_of(now[0][: WINDOW + 1 - seen], now[1][: WINDOW + 1 - seen])
                first = head[0] if first is None else first
                cut = (head == first).all(axis=1)
                yield noted(now[2][: len(head)][cut], head[cut])
            seen += b.num_rows
            last = tuple(np.concatenate([x, y])[-WINDOW - 1 :] for x, y in zip(last, now)) if last else tuple(x[-WINDOW - 1 :] for x in now)
        if last:  # and that at its end
            tail = region_of(last[0], last[1])
            cut = (tail == tail[-1]).all(axis=1)
            yield noted(last[2][cut], tail[cut])

    return rows.mapInArrow(run, "a binary, b binary, shared int, region binary").groupBy("a", "b", "region").agg(F.max("shared").alias("shared"))


def rows_of(docs: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents with rows told by doc_id (null or not) and text_key; a broadcast while these are few."""
    named = wanted.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__key"))
    return docs.join(F.broadcast(named) if named.count() <= FEW_IDS else named, same, how)


def class_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(set_key, set) of the classes that ``wanted`` has, with the doc_id and text_key of a row of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, starts = shingle_sets(*buffers(part.column("text")), shingle)
            sets = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(hashes, starts), pa.binary()), sets], ["set_key", "set"])

    some = rows_of(docs.select("doc_id", F.col("text").cast("string").alias("text")), wanted, "left_semi").select("text")
    found = some.mapInArrow(run, "set_key binary, set array<long>")
    return found.join(wanted.select("set_key").distinct(), "set_key", "left_semi").dropDuplicates(["set_key"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    met = pairs.join(sets.select(F.col("set_key").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("set_key").alias("a"), F.col("set").alias("x")), "a")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, place): each pair that either end names, once; place is its rank, from 1, among the names of the end that ranks it higher."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return pairs.select(*ends, place.alias("place")).groupBy("a", "b").agg(F.min("place").alias("place"))


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that don't lie within one component."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_a <> root_b").select("a", "b", "place")


def with_roots(noted: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The noted classes with their components, the classes of each component in each region, and the regions to compare.

    A region whose noted classes are of one component isn't to be compared. ``others`` is how many classes of other
    components a class has in its region, on average.
    """
    if roots is not None:
        met = noted.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    else:
        met = noted.withColumn("root", F.col("set_key"))
    met = stored(met.select("set_key", "region", "root"), "noted")
    per = stored(met.groupBy("region", "root").agg(F.count("*").alias("rows")), "noted-roots")
    mixed = F.sum(F.when(F.col("rows") <= BLOCK, F.col("rows")).otherwise(0)).alias("mixed")
    others = (F.sum("rows") - F.sum(F.col("rows").cast("double") ** 2) / F.sum("rows")).alias("others")
    regions = per.groupBy("region").agg(F.count("*").alias("roots"), F.sum("rows").alias("members"), mixed, others)
    return met, per, stored(regions.where("roots > 1"), "regions")


def between_blocks(rows: DataFrame, met: DataFrame, per: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, x, y, block, set_key, root, n_shingles, heads, sketch): noted classes, dealt to the pairs x, y of blocks to compare.

    ``met``, ``per`` and ``regions`` are with_roots()'. A component with more than BLOCK classes in a region has blocks of
    its own there, which aren't compared with each other.
    """
    heads = F.concat(*[F.substring("orders", 2 * DEPTH * t + 1, 2 * LEAST_DEPTH) for t in range(TREES)])
    large = per.where(F.col("rows") > BLOCK).select("region", "root", F.col("rows").alias("own"))
    placed = left_join_hot(met, regions.select("region", "members", "mixed"), "region", "members").where("members IS NOT NULL")
    placed = placed.join(F.broadcast(large) if large.count() <= FEW_IDS else large, ["region", "root"], "left")
    placed = placed.join(rows.select("set_key", "n_shingles", heads.alias("heads"), "sketch"), "set_key")
    pure = F.when(F.col("own").isNotNull(), F.hex("root")).otherwise("")
    place = F.pmod(F.xxhash64("set_key"), F.ceil(F.coalesce("own", "mixed") / BLOCK))
    placed = stored(placed.select("region", pure.alias("pure"), F.concat_ws("-", pure, place).alias("block"), "set_key", "root", "n_shingles", "heads", "sketch"), "placed")
    blocks = stored(placed.select("region", "pure", "block").distinct(), "blocks")
    other = blocks.select("region", F.col("pure").alias("pure_y"), F.col("block").alias("y"))
    cells = blocks.withColumnRenamed("block", "x").join(other, "region").where("x <= y AND (pure = '' OR pure <> pure_y)")
    sides = F.explode(F.array_distinct(F.array("x", "y"))).alias("block")
    return cells.select("region", "x", "y", sides).join(placed.drop("pure"), ["region", "block"])


def sides_of(table: pa.Table, x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    block = np.array(table.column("block").to_pylist(), object)
    return np.flatnonzero(block == x), np.flatnonzero(block == y)


def apart(table: pa.Table, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows are of different components and their numbers of shingles let them reach the similarity."""
    root = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)[1]
    n = table.column("n_shingles").to_numpy()
    a, b = n[left][:, None], n[right][None]
    return (root[left][:, None] != root[right][None]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each left set has in common with each right one."""
    owner = [np.repeat(np.arange(len(at)), [len(sets[i]) for i in at]) for at in (left, right)]
    held = [np.concatenate([sets[i] for i in at]) for at in (left, right)]
    common = np.intersect1d(*held)
    column = [np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0)) for h in held]
    met = [common[c] == h if len(common) else np.zeros(len(h), bool) for c, h in zip(column, held)]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(common), COLUMNS):
        grid = []
        for at, o, c, m in zip((left, right), owner, column, met):
            some = m & (c >= start) & (c < start + COLUMNS)
            one = np.zeros((len(at), min(COLUMNS, len(common) - start)), np.float32)
            one[o[some], c[some] - start] = 1
            grid.append(one)
        out += grid[0] @ grid[1].T
    return out.astype(np.int64)


def rare_shingles(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(set_key, region) of the classes and their rarest shingles: so many that sets that reach the similarity share one.

    Shingles that the same classes have among their rarest are one region.
    """
    each = stored(class_sets(docs, classes, shingle).select("set_key", F.size("set").alias("n"), F.explode("set").alias("g")), "shingles")
    often = stored(each.groupBy("g").agg(F.count("*").alias("sets")), "often")
    rank = F.row_number().over(Window.partitionBy("set_key").orderBy("sets", "g"))
    met = left_join_hot(each, often, "g", "sets").withColumn("rank", rank)
    first = met.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("sets") > 1))
    first = stored(first.select("set_key", "g"), "rarest")
    digest = F.concat(*[F.lpad(F.hex(F.bit_xor(F.xxhash64("set_key", F.lit(salt)))), 16, "0") for salt in (0, 1)])
    same = stored(first.groupBy("g").agg(F.count("*").alias("held"), F.unhex(digest).alias("region")).where("held > 1"), "same-classes")
    return left_join_hot(first, same, "g", "held").where("region IS NOT NULL").select("set_key", "region").distinct()


def links_in_regions(docs: DataFrame, classes: DataFrame, met: DataFrame, per: DataFrame, regions: DataFrame, shingle: int, percent: int, trees: bool = True, sketched: bool = True) -> DataFrame:
    """(u, v): links that join the components of classes noted in one region, enough of them to connect all that pairs link.

    With ``trees``, regions are of trees, and a pair is looked at in the first tree in which it shares a region; if it wasn't
    noted there, the order showed it. Without ``sketched``, all pairs within a region are compared on full sets.
    """
    least, cell = least_shared(percent), ("region", "x", "y")
    kept = ("block", "set_key", "root", "n_shingles")

    def screen(key: tuple, table: pa.Table) -> pa.Table:
        if not sketched:
            return table.select([*cell, *kept])
        left, right = sides_of(table, key[1].as_py(), key[2].as_py())
        open_pairs = apart(table, left, right, percent)
        heads = np.frombuffer(b"".join(table.column("heads").to_pylist()), np.dtype(f"V{2 * LEAST_DEPTH}")).reshape(-1, TREES)
        for t in range(key[0].as_py()[0] if trees else 0):
            open_pairs &= heads[left, t][:, None] != heads[right, t][None]
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)
        wanted = np.zeros(table.num_rows, bool)
        for i in np.flatnonzero(open_pairs.any(axis=1)):
            others = right[open_pairs[i]]
            near = others[(sketch[others] == sketch[left[i]]).sum(axis=1) >= least]
            wanted[near] = True
            wanted[left[i]] |= len(near) > 0
        return table.select([*cell, *kept]).filter(pa.array(wanted))

    def confirm(key: tuple, table: pa.Table) -> pa.Table:
        left, right = sides_of(table, key[1].as_py(), key[2].as_py())
        u, v = [], []
        if len(left) and len(right):
            sets = [np.asarray(x.values, np.int64) for x in table.column("set").combine_chunks()]
            both, n = overlaps(sets, left, right), table.column("n_shingles").to_numpy()
            reach = apart(table, left, right, percent) & (100 * both >= percent * (n[left][:, None] + n[right][None] - both))
            names, parent = table.column("set_key").to_pylist(), list(range(table.num_rows))

            def top(i: int) -> int:
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            for i, j in zip(*np.nonzero(reach)):
                a, b = int(left[i]), int(right[j])
                if top(a) != top(b):
                    parent[top(a)] = top(b)
                    u.append(names[a])
                    v.append(names[b])
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    dealt = between_blocks(classes, met, per, regions)
    schema = "region binary, x string, y string, block string, set_key binary, root binary, n_shingles long"
    wanted = stored(dealt.groupBy(*cell).applyInArrow(screen, schema), "block-pairs")
    ends = stored(classes.select("set_key", "doc_id", "text_key").join(wanted.select("set_key").distinct(), "set_key", "left_semi"), "ends")
    sets = stored(class_sets(docs, ends, shingle), "sets")
    return wanted.join(sets, "set_key").groupBy(*cell).applyInArrow(confirm, "u binary, v binary")


def forest_roots(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, exact: bool = False) -> DataFrame:
    """(node, root) of every class that a link joins to another.

    In round r, the pairs that are among the GROWTH**r best of an end are looked at if they lie between components; what lies
    within one is dropped. A class names a bounded number of others, so the rounds end. Then come the noted classes.
    """
    ordered = tree_rows(classes).repartitionByRange("tree", "prefix", "set_key").sortWithinPartitions("tree", "prefix", "set_key")
    seen = stored(named_pairs(ordered, percent), "named")
    noted = seen.where("b IS NULL").select(F.col("a").alias("set_key"), "region")
    rest = stored(ranked_pairs(seen.where("b IS NOT NULL").select("a", "b", "shared")), "pairs")
    ends = rest.select(F.col("a").alias("set_key")).unionByName(rest.select(F.col("b").alias("set_key"))).distinct()
    sets = stored(class_sets(docs, stored(classes.select("set_key", "doc_id", "text_key").join(ends, "set_key", "left_semi"), "ends"), shingle), "sets")
    roots, most = None, 1

    def joined(found: DataFrame) -> DataFrame | None:
        if found.isEmpty():
            return roots
        stars = found if roots is None else found.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        return stored(components(stars), "roots")

    while not rest.isEmpty():
        if roots is not None:
            rest = stored(between(rest, roots), "pairs")
        roots = joined(stored(linked(rest.where(F.col("place") <= most), sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), "links"))
        rest, most = rest.where(F.col("place") > most), GROWTH * most
    def rare(some: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        return with_roots(rare_shingles(docs, some.select("set_key", "doc_id", "text_key"), shingle, percent), roots)

    def links(*noted: DataFrame, trees: bool = True, sketched: bool = True) -> DataFrame:
        return stored(links_in_regions(docs, classes, *noted, shingle, percent, trees, sketched), "links")

    def members(met: DataFrame, regions: DataFrame) -> DataFrame:
        return left_join_hot(met, regions.select("region", "members"), "region", "members").where("members IS NOT NULL").select("set_key", "region")

    if not noted.isEmpty():
        met, per, regions = with_roots(noted, roots)
        crowded = F.col("others") > CROWD
        roots = joined(links(met, per, regions.where(~crowded)))
        if not regions.where(crowded).isEmpty():
            dense = stored(members(met, regions.where(crowded)), "crowded")
            met, per, regions = rare(classes.join(dense.select("set_key").distinct(), "set_key", "left_semi"))
            roots = joined(links(met, per, regions.where(~crowded), trees=False))
            left = members(met, regions.where(crowded)).select("set_key").distinct()
            roots = joined(links(*with_roots(dense.join(left, "set_key", "left_semi"), roots)))
    if exact:
        roots = joined(links(*rare(classes), trees=False, sketched=False))
    return docs.sparkSession.createDataFrame([], "node binary, root binary") if roots is None else roots


def labelled_rows(docs: DataFrame, shingle: int, percent: int, exact: bool = False) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every row."""
    signed = stored(signatures(docs, shingle), "signatures")
    filled = signed.where("set_key IS NOT NULL")
    sizes = stored(filled.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "classes")
    roots = forest_roots(docs, stored(filled.dropDuplicates(["set_key"]), "class-rows"), shingle, percent, exact)
    named = sizes.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "least-ids")
    table = stored(left_join_hot(named, least, "root", "classes").select("set_key", "component_id", "rows"), "components")
    met = left_join_hot(signed.select("doc_id", "text_key", "n_shingles", "set_key"), table, "set_key", "rows")
    own = F.coalesce("component_id", "doc_id")
    return met.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    component_id is the smallest doc_id that links reach, kept is whether that is the row's own. Rows that share it are
    all kept. With ``exact`` no link is missed, at the cost of more comparisons.
    """
    return labelled_rows(docs, shingle, percent, exact).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without those that near_groups() doesn't keep, with all their columns."""
    out = labelled_rows(docs, shingle, percent).where("NOT kept")
    return rows_of(docs, stored(out.select("doc_id", "text_key"), "near-copies"), "left_anti")
