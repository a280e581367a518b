"""Exact top-k by inner product, with MaxScore over blocks of vectors.

Components become integers floor(SCALE * x). A dimension and a sign are a term; a query's terms are its components, each
with the sign that adds to the score. A block of vectors is a shard. For each term it has the rows whose component has
that sign (its postings, as bits) and the largest such component. A query's bound of a term is its own component times
that one, and no row gets more from it.

With k scores known, the terms of smallest bounds whose sum stays below the k-th score are non-essential: a row in no
essential term's postings can't reach it. So the rows of the essential postings are scored, term by term from the
largest bound down, and a row is left as soon as its score so far and the bounds to come stay below the k-th score.
Rows that could still tie are kept. A query knows k scores from its own block before it meets the others, so each block
gives few rows; these are merged to the k best.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part. Ids that
repeat: each such row is a query of its own and is compared with all rows of other ids. Of vectors of several lengths the
shorter ones have zeros at the end. Integers are held within +-LARGEST of vector_codes. With k candidates or fewer all are
given, whatever their scores. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.vector_codes import integers
from lumenframe.storage import stored

SCALE = 256
#: Vectors of a block, and components of a block unless a single vector has more.
BLOCK, COMPONENTS = 8_192, 1 << 22
#: Terms that are scored between two looks at the bounds.
STEP = 8
INDEX = "shard int, n int, width int, ids binary, vectors binary, postings binary, top binary, asked int, query_ids binary, queries binary, reach binary"
FOUND = "query_group bigint, query_at int, query_id bigint, vec_id bigint, score bigint"
#: Stands for no known k-th score.
NONE = np.iinfo(np.int64).min
#: Integers below it are exact as doubles.
EXACT = 1 << 53


class Block:
    """Vectors as columns, the postings of each term as bits, and the largest component of each term."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, postings: np.ndarray | None = None, top: np.ndarray | None = None) -> None:
        self.ids, self.columns = ids, columns
        self.postings = np.packbits(np.stack([columns > 0, columns < 0]), axis=2) if postings is None else postings
        self.top = np.stack([columns.max(axis=1), (-columns).max(axis=1)]).clip(0) if top is None else top
        self.doubles, self.peak = columns.astype(np.float64), int(self.top.max())

    def best(self, query: np.ndarray, own: int, k: int, reach: int = NONE) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those of id own, best first; rows below reach may be left out."""
        query = query[: len(self.columns)]
        side = (query < 0).astype(np.int64)
        bounds = np.abs(query) * self.top[side, np.arange(len(query))]
        order = np.argsort(-bounds, kind="stable")
        rest = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])  # what the terms from each place on add at most
        essential = int(np.count_nonzero(rest[:-1] >= reach)) if reach > 0 else len(order) + 1
        if essential > len(order):  # a row without any posting may do
            rows = np.arange(len(self.ids))
        else:
            terms = order[:essential]
            hit = np.bitwise_or.reduce(self.postings[side[terms], terms], axis=0) if essential else np.zeros(0, np.uint8)
            rows = np.flatnonzero(np.unpackbits(hit, count=len(self.ids))) if essential else np.zeros(0, np.int64)
        rows = rows[self.ids[rows] != own]
        if int(np.abs(query).sum()) * self.peak < EXACT:  # all sums are whole numbers that doubles hold
            columns, query = self.doubles, query.astype(np.float64)
        else:
            columns = self.columns
        score = np.zeros(len(rows), columns.dtype)
        for i in range(0, len(order), STEP):
            if not len(rows):
                break
            terms = order[i : i + STEP]
            score += query[terms] @ columns[np.ix_(terms, rows)] if len(rows) < len(self.ids) // 2 else (query[terms] @ columns[terms])[rows]
            if reach != NONE:
                open_ = score + rest[min(i + STEP, len(order))] >= reach
                rows, score = rows[open_], score[open_]
        if len(rows) > k:
            at = np.argpartition(-score, k - 1)[:k]
            at = np.flatnonzero(score >= score[at].min())
            rows, score = rows[at], score[at]
        at = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[at]], score[at].astype(np.int64)


def indexed(rows: DataFrame, shards: int, block: int, asks: int, k: int) -> DataFrame:
    """The blocks (INDEX) of rows (vec_id, vector), with the queries among them and the k-th score each has in its block.

    Rows are dealt evenly over the shards, whatever their ids; a shard has one block, or few.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()

        def made(table: pa.Table) -> pa.RecordBatch:
            vectors, ids = table.column("vector").combine_chunks(), table.column("vec_id").to_numpy()
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            width = max(1, int(sizes.max()))
            filled = np.zeros((len(ids), width), np.int64)
            filled[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
            b, asked = Block(ids, np.ascontiguousarray(filled.T)), np.flatnonzero(ids % asks == 0)
            told = [b.best(filled[i], int(ids[i]), k)[1] for i in asked.tolist()]
            reach = np.array([int(x[-1]) if len(x) == k else NONE for x in told], np.int64)
            numbers = [pa.array([x], pa.int32()) for x in (shard, len(ids), width, len(asked))]
            held = [pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for x, kind in ((ids, np.int64), (b.columns, np.int32), (b.postings, np.uint8), (b.top, np.int64), (ids[asked], np.int64), (filled[asked], np.int32), (reach, np.int64))]
            return pa.RecordBatch.from_arrays([*numbers[:3], *held[:4], numbers[3], *held[4:]], INDEX.replace(",", "").split()[::2])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                if sum(x.num_rows for x in held) >= block:
                    whole = pa.Table.from_batches(held)
                    yield made(whole.slice(0, block))
                    held = whole.slice(block).to_batches()
        if sum(x.num_rows for x in held):
            yield made(pa.Table.from_batches(held))

    return rows.repartition(shards).mapInArrow(pack, INDEX)


def searched(met: DataFrame, k: int) -> DataFrame:
    """FOUND: what each block has for each query of the groups that are sent to its shard, k rows at most.

    ``met`` has the rows of a shard together, its blocks before the groups.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = None, []
        for r in (r for batch in batches for r in batch.to_pylist()):
            of = lambda c, kind: np.frombuffer(r[c], kind)  # noqa: B023, E731
            if at != r["shard"]:
                at, blocks = r["shard"], []
            if r["query_group"] is None:
                n, width = r["n"], r["width"]
                blocks.append(Block(of("ids", np.int64), of("vectors", np.int32).reshape(width, n).astype(np.int64), of("postings", np.uint8).reshape(2, width, -1), of("top", np.int64).reshape(2, width)))
                continue
            ids, reach = of("query_ids", np.int64), of("reach", np.int64)
            queries = of("queries", np.int32).reshape(len(ids), -1).astype(np.int64)
            for b in blocks:
                told = [b.best(q, i, k, t) for q, i, t in zip(queries, ids.tolist(), reach.tolist())]
                sizes = [len(x[0]) for x in told]
                cells = [np.full(sum(sizes), r["query_group"]), np.repeat(np.arange(len(ids)), sizes).astype(np.int32), np.repeat(ids, sizes), *(np.concatenate([x[i] for x in told]) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], FOUND.replace(",", "").split()[::2])

    return met.mapInArrow(run, FOUND)


def search(rows: DataFrame, k: int = 5, asks: int = 50, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each row whose id ``asks`` divides.

    The given query set meets all rows in blocks: the queries of each block, as one row, are sent to every shard, where
    they stream past the shard's block. Blocks are moved once.
    """
    ints = rows.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col(vector), SCALE).alias("vector"))
    ints = ints.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    told = ints.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    block = max(1, min(block, COMPONENTS // max(told.width or 1, 1)))
    shards = max(1, -(-told.n // block))
    index = stored(indexed(ints, shards, block, asks, k), "top-index")
    group = F.when(F.col("asked") > 0, F.xxhash64("shard", "query_ids", "queries"))
    blocks = index.select("shard", F.lit(None).cast("long").alias("query_group"), "n", "width", "ids", "vectors", "postings", "top", *[F.lit(None).cast("binary").alias(c) for c in ("query_ids", "queries", "reach")])
    groups = index.where("asked > 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), group.alias("query_group"), *[F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("width", "int"), ("ids", "binary"), ("vectors", "binary"), ("postings", "binary"), ("top", "binary"))], "query_ids", "queries", "reach")
    met = blocks.unionByName(groups).repartition(shards, "shard").sortWithinPartitions("shard", F.col("query_group").asc_nulls_first())
    best = Window.partitionBy("query_group", "query_at").orderBy(F.desc("score"), "vec_id")
    ranked = searched(met, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
