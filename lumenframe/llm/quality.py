"""Quality classifier by positive-unlabelled learning with the non-negative risk.

The classifier is linear in features of a text's bytes and words, hashed byte trigrams and words among them. It is fitted
to trusted positives and to all texts as unlabelled ones; negative labels are never used. With the class prior p and the
logistic loss l, the risk is p E+[l(g)] + max(0, E[l(-g)] - p E+[l(-g)]): the second part is the risk of negatives, which can't be below 0 for any true
classifier. While it is above, Newton steps go down the whole risk; where a step makes it negative, the fit begins to tell
trusted positives from unlabelled ones, the clip acts, and the next step goes up its second part instead. The weights of
the least clipped risk are kept. The prior is estimated first: a classifier fitted under an even prior orders the texts,
and the share of all texts above a threshold over that of the positives bounds the prior from above; of these bounds the
one is taken that is least when chance is allowed for.

Every step is a pass over the stored features of all documents that ends in sums of a fixed number of cells.

Defined cases: null and empty texts are scored as texts without words; without trusted positives all scores are 0.5;
a doc_id with both labels isn't trusted; repeated rows count and are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.joins import FEW_IDS
from lumenframe.llm.text import buffers, crc_fold, fresh, hashed_words, kept_schema, mixed, slices, with_text
from lumenframe.storage import stored

THRESHOLD = 0.3
FOLDS = 5
STEPS, RIDGE, BINS = 10, 1e-2, 400
#: Probability that the estimated prior is allowed to be off by more than chance.
CHANCE = 0.1
#: Cells of hashed byte trigrams, and of hashed words.
TRIGRAMS, WORDS = 32, 32
#: Added to the standard deviations that features are divided by: a mark in a few texts should not weigh much.
SCALE = 0.03


def byte_class(value: int) -> int:
    """Each ASCII mark and white space is its own class; letters by case, digits, controls and other bytes share one."""
    char = chr(value)
    if value >= 128:
        return 0
    if char.isalpha():
        return 1 if char.islower() else 2
    if char.isdigit():
        return 3
    return 4 + value - 32 if 32 <= value < 48 else 20 + value - 58 if 58 <= value < 65 else 27 + value - 91 if 91 <= value < 97 else 33 + value - 123 if 123 <= value < 127 else 37 if char == "\n" else 38


CLASSES = np.array([byte_class(x) for x in range(256)], np.int64)
N_CLASSES = 39
#: Byte classes, six features of the words, hashed trigrams and words.
N_PLAIN = N_CLASSES + 6
WIDTH = N_PLAIN + TRIGRAMS + WORDS


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of each text: roots of shares of byte classes, how long, cased, ended and repeated its words are, and roots of
    shares of trigrams and words by a hash."""
    n = len(starts) - 1
    out = np.zeros((n, WIDTH))
    if not len(data):
        return out
    owner = np.repeat(np.arange(n), np.diff(starts))
    shares = np.bincount(owner * N_CLASSES + CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(shares / np.maximum(np.diff(starts), 1)[:, None])
    if len(data) > 2:
        low = data.astype(np.uint64)
        gram = mixed((low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]) % np.uint64(TRIGRAMS)
        whole = owner[:-2] == owner[2:]
        out[:, N_PLAIN : N_PLAIN + TRIGRAMS] = hashed_shares(gram[whole], owner[:-2][whole], n, TRIGRAMS)
    found = hashed_words(data, starts)
    word, text, begin, size = found.hash, found.text, found.begin, found.size
    if not len(begin):
        return out
    words = np.maximum(np.bincount(text, minlength=n), 1)
    upper = np.add.reduceat((CLASSES[data] == 2).astype(np.int64), begin)
    end = begin + size - 1
    marked = ~np.isin(CLASSES[data[end]], [0, 1, 2, 3]) & ~np.isin(data[end], np.frombuffer(b".,", np.uint8))
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (text[1:] == text[:-1])])
    order = np.lexsort([word, text])
    new = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (text[order][1:] != text[order][:-1])])
    share = lambda x: np.bincount(text, weights=x, minlength=n) / words
    distinct = np.bincount(text[order][new], minlength=n) / words
    extra = [np.log1p(words), share(size) / 10, share((upper == size) & (size > 1)), share(marked), share(again), distinct]
    out[:, N_CLASSES:N_PLAIN] = np.stack(extra, axis=1)
    out[np.bincount(text, minlength=n) == 0, N_CLASSES:N_PLAIN] = 0
    out[:, N_PLAIN + TRIGRAMS :] = hashed_shares(word % np.uint64(WORDS), text, n, WORDS)
    return out


def hashed_shares(cell: np.ndarray, owner: np.ndarray, n: int, cells: int) -> np.ndarray:
    """Root of the share of each of some cells in each text."""
    times = np.bincount(owner * cells + cell.astype(np.int64), minlength=n * cells).reshape(n, cells)
    return np.sqrt(times / np.maximum(times.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(design(x, self.mean, self.scale) @ self.weights)


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(g / 2)


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)


def feature_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, trusted): the features of every row, and whether its label is a positive one of the learning folds."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = features(*buffers(part.column("text"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.FixedSizeListArray.from_arrays(x.ravel(), WIDTH).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {kind}, x array<float>")
    trusted = labels.where(F.col("quality").isNotNull() & (crc_fold(labels, FOLDS) != 0)).groupBy("doc_id").agg((F.min("quality") == 1).alias("trusted"))
    trusted = stored(trusted.where("trusted"), "trusted")
    met = found.join(F.broadcast(trusted) if trusted.count() <= FEW_IDS else trusted, "doc_id", "left")
    return stored(met.select("x", F.coalesce("trusted", F.lit(False)).alias("trusted")), "quality")


def sums(table: DataFrame, cells: int, fn) -> np.ndarray:
    """Adds up fn(x, trusted), an array of ``cells`` numbers for each batch, over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, WIDTH).astype(np.float64)
                total += fn(x, b.column("trusted").to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "value"])

    out = np.zeros(cells)
    for row in table.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[row.cell] = row.value
    return out


def newton(table: DataFrame, mean: np.ndarray, scale: np.ndarray, prior: float, weights: np.ndarray, positives: float, rows: float) -> np.ndarray:
    """Weights of the least non-negative risk under a prior."""
    d = WIDTH + 1

    def look(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
        """The clipped risk, its second part before the clip, the slopes of the whole and of that part, and the curvature."""

        def part(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
            z = design(x, mean, scale)
            g = z @ w
            p = sigmoid(g)
            own = z[trusted]
            losses = [np.logaddexp(0, g).sum(), np.logaddexp(0, -g[trusted]).sum(), np.logaddexp(0, g[trusted]).sum()]
            return np.concatenate([losses, p @ z, own.sum(axis=0), p[trusted] @ own, ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        s = sums(table, 3 + 3 * d + d * d, part)
        negative = s[0] / rows - prior * s[2] / positives
        ridge = np.append(np.full(WIDTH, RIDGE), 0.0)
        risk = prior * s[1] / positives + max(0.0, negative) + 0.5 * (ridge * w * w).sum()
        gradient = s[3 : 3 + d] / rows - prior * s[3 + d : 3 + 2 * d] / positives + ridge * w
        up = s[3 : 3 + d] / rows - prior * s[3 + 2 * d : 3 + 3 * d] / positives
        return risk, negative, gradient, up, s[3 + 3 * d :].reshape(d, d) / rows + np.diag(ridge + 1e-9)

    least, best, size = np.inf, weights, 1.0
    for _ in range(STEPS):
        risk, negative, gradient, up, curve = look(weights)
        gain = least - risk
        if gain > 0:
            least, best, size = risk, weights, 1.0
        else:
            size /= 2
        if abs(gain) < 1e-5 or size < 0.1:
            break
        if gain <= 0:
            weights = (best + weights) / 2  # the step went too far
        elif negative >= 0:
            weights = weights - np.linalg.solve(curve, gradient)
        else:
            weights = weights + size * np.linalg.solve(curve, up)  # clipped: raise the second part
    return best


def estimated_prior(table: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, positives: float, rows: float) -> float:
    """The share of all texts over that of the positives above a threshold: an upper bound of the prior.

    The threshold is the one with the least bound once what chance may add to either share is added.
    """

    def part(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        at = np.minimum((sigmoid(design(x, mean, scale) @ weights) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[trusted], minlength=BINS)]).astype(float)

    s = sums(table, 2 * BINS, part)
    above, own = s[:BINS][::-1].cumsum() / rows, s[BINS:][::-1].cumsum() / positives
    chance = np.sqrt(np.log(4 / CHANCE) / 2) * (1 / np.sqrt(rows) + 1 / np.sqrt(positives))
    best = np.argmin((above + chance) / np.maximum(own, 1e-9))
    return float(np.clip(above[best] / max(own[best], 1e-9), 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    table = feature_table(docs, labels)

    def moments(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x), trusted.sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    s = sums(table, 2 + 2 * WIDTH, moments)
    rows, positives = s[:2]
    mean = s[2 : 2 + WIDTH] / max(rows, 1)
    scale = np.sqrt(np.maximum(s[2 + WIDTH :] / max(rows, 1) - mean**2, 0)) + SCALE
    weights = np.zeros(WIDTH + 1)
    if not positives:
        return Model(mean, scale, weights, 0.5)
    weights = newton(table, mean, scale, 0.5, weights, positives, rows)
    prior = estimated_prior(table, mean, scale, weights, positives, rows)
    return Model(mean, scale, newton(table, mean, scale, prior, weights, positives, rows), prior)


def score(docs: DataFrame, model: Model, keep: list[str], least: float | None = None) -> DataFrame:
    """The kept columns of every row and then its score; with ``least``, only rows that score so much.

    The score's column is quality_score, with underscores in front while a kept column has that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, name = fresh("text", keep), fresh("quality_score", keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = shared.value.scores(features(*buffers(part.column(text))))
            out = pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found)], [*keep, name])
            yield out if least is None else out.filter(pa.array(found >= least))

    return with_text(docs, keep, text).mapInArrow(run, f"{kept_schema(docs, keep)}{name} double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    found = score(docs, model, docs.columns, threshold)
    return found.drop(found.columns[-1])
