"""Language identification by prediction by partial matching (PPM, escape method C with exclusion).

Each language has a context tree over bytes: how often each byte followed each context of 0 to ORDER bytes. A byte's
code length is that of the longest known context that has seen it, plus the escapes out of longer ones; bytes that a
longer context has seen are excluded from shorter ones, and the order below 0 is uniform over what is left. The counts
are frozen before scoring, so a byte's code length depends on it and the ORDER bytes before it alone, and texts are
scored as sums over their (ORDER + 1)-grams. The language with the shortest code wins.

Defined cases: a null text or one without a letter gets ``und`` and score 0; equally short codes go to the language that
sorts first; without labelled rows everything is ``und``; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.text import buffers, fresh, kept_schema, sampled, slices, with_text

ORDER = 4
#: Rows of a language that the counts are taken from, about.
FIT_ROWS = 400
LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, starts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, it and the order bytes before it as one number; zeros stand before a text's first byte."""
    codes = data.astype(np.int64)
    first = starts[:-1]
    for back in range(1, min(order, len(data)) + 1):
        before = np.zeros(len(data), np.int64)
        before[back:] = data[:-back]
        for at in range(back):
            before[np.minimum(first + at, len(data) - 1)[first + at < len(data)]] = 0
        codes |= before << (8 * back)
    return codes


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over the texts of docs, which has lang and text."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for part in slices(batches):
            langs = part.column("lang").to_numpy(zero_copy_only=False)
            data, starts = buffers(part.column("text"))
            codes, owner = grams(data, starts, order), np.repeat(np.arange(len(langs)), np.diff(starts))
            for lang in sorted(set(langs)):
                kinds, n = np.unique(codes[(langs == lang)[owner]], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(kinds), pa.string()), "gram": kinds, "n": n})

    found = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTree:
    """Frozen statistics of one language: code lengths in bits of (order + 1)-grams."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, order: int = ORDER):
        self.order, self.levels = order, []
        for d in range(order + 1):
            keys, at = np.unique(gram & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
            counts = np.bincount(at, weights=n)
            contexts, owner = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(owner, weights=counts), np.bincount(owner)
            level = {"keys": keys, "counts": counts, "contexts": contexts, "total": total, "kinds": kinds}
            if d:  # what its shorter context keeps once the bytes seen here are excluded
                up = self.levels[-1]
                shorter = np.searchsorted(up["contexts"], contexts & ((1 << (8 * (d - 1))) - 1))
                same = np.searchsorted(up["keys"], keys & ((1 << (8 * d)) - 1))
                left = up["total"][shorter] - np.bincount(owner, weights=up["counts"][same])
                more = up["kinds"][shorter] - kinds
                level |= {"norm": np.log2(np.maximum(left + more, 1)), "escape": np.where(more > 0, np.log2(np.maximum(left + more, 1)) - np.log2(np.maximum(more, 1)), 0.0)}
            self.levels.append(level)
        self.rest = 256 - (self.levels[0]["kinds"][0] if len(gram) else 0)

    @staticmethod
    def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return at, sorted_keys[at] == wanted

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after its other bytes."""
        out, done = np.zeros(len(codes)), np.zeros(len(codes), bool)
        begun = np.zeros(len(codes), bool)  # a known context was left by an escape
        norm = np.zeros(len(codes))
        for d in range(self.order, -1, -1):
            level = self.levels[d]
            context, known = self._find(level["contexts"], (codes & ((1 << (8 * (d + 1))) - 1)) >> 8)
            key, seen = self._find(level["keys"], codes & ((1 << (8 * (d + 1))) - 1))
            fresh = known & ~begun & ~done
            first = np.log2(level["total"][context] + level["kinds"][context])
            hit = seen & known & ~done
            out = np.where(hit, out + np.where(begun, norm, first) - np.log2(level["counts"][key]), out)
            done |= hit
            out = np.where(fresh & ~done, out + first - np.log2(level["kinds"][context]), out)
            if d:
                go = known & ~done
                # the escape out of the next shorter context counts only if that one hasn't seen the byte either
                _, next_seen = self._find(self.levels[d - 1]["keys"], codes & ((1 << (8 * d)) - 1))
                out = np.where(go & ~next_seen, out + level["escape"][context], out)
                norm = np.where(go, level["norm"][context], norm)
            begun |= known
        return np.where(done, out, out + np.log2(max(self.rest, 1)))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, order: int = ORDER) -> dict[str, ContextTree]:
    """A context tree for each lang of docs, from about ``fit_rows`` whole texts of each."""
    text = F.col("text").cast("string")
    usable = docs.where(F.col("lang").isNotNull() & (F.octet_length(text) > 0)).select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"))
    counts = gram_counts(sampled(usable, ["doc_id", "text"], "lang", fit_rows), order).toPandas()
    return {lang: ContextTree(own.gram.to_numpy(), own.n.to_numpy(), order) for lang, own in sorted(counts.groupby("lang"))}


def code_lengths(trees: list[ContextTree], data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each text (rows) under each tree (columns)."""
    sums = np.zeros((len(starts) - 1, len(trees)))
    if not len(data):
        return sums
    kinds, at = np.unique(grams(data, starts, trees[0].order), return_inverse=True)
    for j, tree in enumerate(trees):
        ends = np.concatenate([[0.0], np.cumsum(tree.bits(kinds)[at])])
        sums[:, j] = ends[starts[1:]] - ends[starts[:-1]]
    return sums


def predict(docs: DataFrame, trees: dict[str, ContextTree], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score, the winner's share of 2 to the power of minus the code length.

    The last two have underscores in front while a kept column has such a name.
    """
    spark, langs, keep = docs.sparkSession, list(trees), list(keep)
    shared = spark.sparkContext.broadcast([trees[x] for x in langs])
    at, names = fresh("text", keep), [fresh(c, keep) for c in ("lang_pred", "score")]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            texts = part.column(at)
            worded = np.array([bool(LETTER.search(t)) for t in texts.fill_null("").to_pylist()], bool)
            pred, share = np.full(len(texts), "und", object), np.zeros(len(texts))
            if langs:
                bits = code_lengths(shared.value, *buffers(texts))
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                pred = np.where(worded, np.array(langs, object)[best], "und")
                share = np.where(worded, share, 0.0)
            kept = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(share)], [*keep, *names])

    return with_text(docs, keep, at).mapInArrow(score, f"{kept_schema(docs, keep)}{names[0]} string, {names[1]} double")
