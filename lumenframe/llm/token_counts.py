"""Exact length histogram of encoded documents.

Every text is encoded whole by a public byte-level BPE vocabulary and counted by its length in tokens. Suffix sums over
the histogram then answer, for every context limit at once, the total, the quantiles and the total after truncation.

Defined cases: null and empty texts have length 0; an empty table gives an empty histogram; repeated rows count each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.text import slices
from lumenframe.storage import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths that one block of the suffix sums covers.
BLOCK = 256


def encoding(ranks: bytes) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row. The vocabulary is read by the driver and broadcast, under 1 MB."""
    ranks = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks.value)
        for part in slices(batches):
            found = encoder.encode_ordinary_batch(part.column("text").fill_null("").to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in found], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """One row for each length that occurs.

    docs and tokens at that length; docs_ge and tokens_ge at it or longer; docs_le, up to it; share_le = docs_le over all
    docs; truncated_tokens, the corpus's tokens when every document is cut to that length. The suffix sums run within
    blocks of lengths and then over block totals, so no task needs all lengths.
    """
    flat = stored(counted.groupBy("n_tokens").agg(F.count("*").alias("docs")), "lengths")  # texts are encoded once
    flat = flat.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("block"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = flat.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    rest = [F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"]
    whole = [F.sum(c).over(Window.partitionBy()).alias(name) for c, name in (("d", "all_docs"), ("t", "all_tokens"))]
    blocks = blocks.select("block", *rest, *whole)
    summed = flat.withColumn("d", F.sum("docs").over(inside)).withColumn("t", F.sum("tokens").over(inside))
    met = summed.join(blocks, "block")
    met = met.withColumn("docs_ge", F.col("d") + F.col("d_above")).withColumn("tokens_ge", F.col("t") + F.col("t_above"))
    met = met.withColumn("docs_le", F.col("all_docs") - F.col("docs_ge") + F.col("docs"))
    cut = F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")
    return met.select("n_tokens", "docs", "tokens", "docs_ge", "tokens_ge", "docs_le", (F.col("docs_le") / F.col("all_docs")).alias("share_le"), cut.alias("truncated_tokens"))


def total(hist: DataFrame) -> DataFrame:
    """(docs, tokens) of the corpus."""
    return hist.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def quantiles(hist: DataFrame, at: list[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least the share q of the documents doesn't exceed."""
    asked = hist.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at])))
    return asked.where("share_le >= q").groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))


def truncated(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context, truncated_tokens, docs_cut): tokens left and documents cut at each context limit."""
    each = hist.withColumn("context", F.explode(F.array(*[F.lit(int(x)) for x in limits]))).groupBy("context")
    return each.agg(F.sum(F.least("n_tokens", "context") * F.col("docs")).alias("truncated_tokens"), F.coalesce(F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("docs"))), F.lit(0)).alias("docs_cut"))
