"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words adds up, over all strings of three characters, the products of the weights with which the string
occurs in both as a subsequence: DECAY to the power of the characters that an occurrence spans, up to SPAN of them. A
character put into an insult, or left out, thus costs some weight but not the match. Kernels are normalised. Words are
compared after case folding; marks inside a word go, and single letters in a row count as one word. A sentence ends at a
mark or a line break, or after LENGTH words; its value under a machine is that of its highest word.

The machine is trained on labelled sentences, by the hinge loss of their values. All sentences of clean documents are
clean, so all their words must be low. Toxic are sentences of toxic documents with words that surely go with these, and
one sentence of each: at first that with the most typical word, later the one that the machine puts highest, unless its
word is in clean sentences too or stands for one document alone. Their highest words must be high. The
landmarks are words of either side's sentences, the Nyström map makes a word a vector of its kernels with them, and a
linear machine is trained on these vectors; words that come out high in clean sentences join and it is trained again.
As a kernel is a sum over strings, the machine folds into one weight for each string, and scoring needs no landmarks. A
text's score is a logistic function, fitted to labelled documents, of its highest sentences and of how many different words are positive.

Defined cases: null texts and texts without letters score as if all their sentences were as low as any; without labels of
both kinds all scores are 0; a doc_id with both labels counts as toxic; repeated rows are scored alike; of a word longer
than LONGEST the part that the machine puts highest counts; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.text import crc_fold, fresh, kept_schema, sampled, slices, with_text
from lumenframe.storage import stored

THRESHOLD = 0.5
FOLDS = 5
DECAY, SPAN = 0.6, 6
#: Documents of each label that the machine is fitted to, about; landmarks and training sentences of each side.
FIT_DOCS, LANDMARKS, TRAINING = 6_000, 96, 3_000
ROUNDS, COST = 3, 10.0
#: Likelihood-ratio statistic from which a word surely goes with toxic documents.
EVIDENCE = 30.0
#: Characters of a word that are compared at once; longer words are cut into overlapping parts.
LONGEST, OVERLAP = 24, 12
#: Words of a sentence at most; longer ones are cut.
LENGTH = 24
#: Bits of a character's number.
CHARACTER = 21
#: Places of three characters within a span, the first being 0.
PLACES = [(0, j, k) for j, k in combinations(range(1, SPAN), 2)]
NOT_LETTER = regex.compile(r"[^\p{L}]+")
#: Marks that end a sentence.
ENDS = tuple(".!?…;:。！？")
#: Bytes of tokens and words with values that a task remembers between slices, and those of one besides its characters, about.
HELD_BYTES, TOKEN_BYTES = 96 << 20, 160
#: Words whose strings are held at once.
CHUNK = 4_096
#: Highest sentences that a text's score looks at, and the value of a missing one and of a token without letters.
HIGHEST, MISSING = 4, -1.0


def parts_of(token: str) -> list[str]:
    """The letters of a token as words to compare: none if they are few, overlapping parts if they are many."""
    word = token if token.isalpha() else NOT_LETTER.sub("", token)
    if len(word) <= LONGEST:
        return [word] if len(word) > 2 else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - OVERLAP, OVERLAP)]


def tokens_of(text: str) -> list[str]:
    return text.casefold().replace("\n", " . ").split()


def occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, string, weight) of each subsequence of three characters, those of one word and string added up."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    width = max(map(len, words), default=0)
    if width < 3:
        return none
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, s = np.unique(flat, return_inverse=True)  # the characters of these words, numbered
    s, n, blank = s.reshape(len(words), width).astype(np.int64), len(kinds), int(kinds[0] == 0)
    rows, strings, weights = [], [], []
    for _, j, k in PLACES:
        if k >= width:
            continue
        a, b, c = s[:, : width - k], s[:, j : width - k + j], s[:, k:]
        row, at = np.nonzero(c >= blank)
        rows.append(row)
        strings.append((a[row, at] * n + b[row, at]) * n + c[row, at])
        weights.append(np.full(len(row), DECAY ** (k + 1)))
    key = np.concatenate(rows) * n**3 + np.concatenate(strings)
    if not len(key):
        return none
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.concatenate(weights)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    held, code = key[first] % n**3, kinds.astype(np.int64)
    string = (code[held // n**2] << 2 * CHARACTER) | (code[held // n % n] << CHARACTER) | code[held % n]
    return key[first] // n**3, string, np.add.reduceat(weight, first)


def norms(row: np.ndarray, weight: np.ndarray, words: int) -> np.ndarray:
    return np.maximum(np.sqrt(np.bincount(row, weights=weight**2, minlength=words)), 1e-12)


def kernels(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels of words (rows) with landmarks (columns), some words at a time."""
    out = np.zeros((len(words), len(landmarks)))
    row, string, weight = occurrences(landmarks)
    if not len(string):
        return out
    kinds, at = np.unique(string, return_inverse=True)
    held = np.zeros((len(kinds), len(landmarks)))
    held[at, row] = weight / norms(row, weight, len(landmarks))[row]
    for first in range(0, len(words), 256):
        some = words[first : first + 256]
        row, string, weight = occurrences(some)
        place = np.minimum(np.searchsorted(kinds, string), len(kinds) - 1)
        known = kinds[place] == string
        dense = np.zeros((len(some), len(kinds)))
        dense[row[known], place[known]] = (weight / norms(row, weight, len(some))[row])[known]
        out[first : first + 256] = dense @ held
    return out


def word_scores(words: list[str], strings: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The machine's value of each word, its strings' weights over its norm; CHUNK words of about one length at a time."""
    out, order = np.zeros(len(words)), np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for first in range(0, len(words), CHUNK):
        at = order[first : first + CHUNK]
        row, string, weight = occurrences([words[i] for i in at.tolist()])
        if len(string) and len(strings):
            place = np.minimum(np.searchsorted(strings, string), len(strings) - 1)
            value = np.where(strings[place] == string, weights[place], 0.0)
            out[at] = np.bincount(row, weights=weight * value, minlength=len(at)) / norms(row, weight, len(at))
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear machine of squared hinge loss by Newton steps; y is 1 or -1, both sides weighing the same."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
    ridge = np.append(np.full(x.shape[1] - 1, 1 / (cost * 100)), 1e-8)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        short = np.maximum(0, 1 - y * (x @ w))
        on = (short > 0) * share
        gradient = ridge * w - x.T @ (on * y * short)
        if np.abs(gradient).max() < 1e-7:
            break
        w = w - np.linalg.solve((x * on[:, None]).T @ x + np.diag(ridge), gradient)
    return w[:-1], float(w[-1])


def nystrom(landmarks: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' vectors in the landmarks' space, and the map from a word's kernels to its vector."""
    value, axis = np.linalg.eigh(kernels(landmarks, landmarks))
    mapped = axis * np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)
    return kernels(words, landmarks) @ mapped, mapped


def folded(landmarks: list[str], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings in order, and one weight for each: the landmarks' normalised weights times alpha, added up."""
    row, string, weight = occurrences(landmarks)
    kinds, at = np.unique(string, return_inverse=True)
    return kinds, np.bincount(at, weights=weight * (alpha / norms(row, weight, len(landmarks)))[row], minlength=len(kinds))


class Reader:
    """Values the sentences of slices of texts by ``value``, which tells the values of words.

    Tokens and words are remembered within HELD_BYTES; all are forgotten after a slice that goes beyond. Only if ``named``
    are the highest words and sentences told.
    """

    def __init__(self, value: Callable[[list[str]], np.ndarray], named: bool = True):
        self.value, self.named = value, named
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.values: dict[str, float] = {}
        self.bytes = 0
        self.held = [np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)]  # value, whether it ends a sentence, whether it is one letter

    def learn(self, tokens: set[str]) -> None:
        new = list(tokens.difference(self.known))
        split = [parts_of(t) for t in new]
        words = list({p for parts in split for p in parts}.difference(self.values))
        if words:
            self.values.update(zip(words, self.value(words).tolist()))
        self.bytes += sum(TOKEN_BYTES + 4 * len(x) for x in (*new, *words))
        value = np.array([max([MISSING, *[self.values[p] for p in parts]]) for parts in split])
        lone = [len(t) < 4 and sum(c.isalpha() for c in t) == 1 for t in new]
        for t in new:
            self.known[t] = len(self.known)
        now = [value, np.array([t.endswith(ENDS) for t in new], bool), np.array(lone, bool)]
        self.held = [np.concatenate(x) for x in zip(self.held, now)]

    def forget(self) -> None:
        if self.bytes > HELD_BYTES:
            self.clear()

    def read(self, texts: list[str]) -> list[tuple[float, str, str, list[float]]]:
        """For each text its highest value, the word and the sentence that have it, and the features.

        These are the highest values of sentences, and how many different words are positive, in all and for each word.
        """
        split = [tokens_of(t) for t in texts]
        self.learn({t for tokens in split for t in tokens})
        flat = [t for tokens in split for t in tokens]
        out = [(MISSING, "", "", [MISSING] * HIGHEST + [0.0, 0.0])] * len(texts)
        if not flat:
            return out
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        value, ends, lone = (x[at] for x in self.held)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        begins = np.concatenate([[True], text[1:] != text[:-1]])
        spelled = spelled_out(flat, lone, begins)
        if spelled:
            self.learn(set(spelled.values()))
            for (a, b), word in spelled.items():  # the first of the letters stands for all
                value[a:b], ends[a : b - 1] = MISSING, False
                value[a] = self.held[0][self.known[word]]
        begins[1:] |= ends[:-1]
        first = np.flatnonzero(begins)
        begins |= (np.arange(len(flat)) - np.repeat(first, np.diff(np.append(first, len(flat))))) % LENGTH == 0
        first = np.flatnonzero(begins)
        highs, owner, last = np.maximum.reduceat(value, first), text[first], np.append(first[1:], len(flat))
        order = np.lexsort([first, -highs, owner])
        start = np.searchsorted(owner, np.arange(len(texts) + 1))
        words, high = np.bincount(text, minlength=len(texts)), np.flatnonzero(value > 0)
        kinds = np.unique(np.stack([text[high], at[high]]), axis=1)[0]  # a word that comes again counts once
        hits = np.bincount(kinds, minlength=len(texts))
        word = sentence = ""
        for t in np.unique(owner).tolist():
            own = order[start[t] : start[t + 1]]
            high = highs[own[:HIGHEST]].tolist()
            a, b = int(first[own[0]]), int(last[own[0]])
            top = a + int(value[a:b].argmax())
            if self.named:
                parts = parts_of(next((w for (x, _), w in spelled.items() if x == top), flat[top]))
                word, sentence = max(parts, key=self.values.__getitem__, default=""), " ".join(flat[a:b])
            out[t] = high[0], word, sentence, [*(high + [MISSING] * HIGHEST)[:HIGHEST], math.log1p(hits[t]), math.log1p(100 * hits[t] / words[t])]
        self.forget()
        return out

    def above(self, texts: list[str], least: float) -> dict[str, float]:
        """The words of the texts' sentences that are above ``least``, with their values."""
        tokens = {t for text in texts for t in tokens_of(text)}
        self.learn(tokens)
        words = {w for t in tokens if self.held[0][self.known[t]] > least for w in parts_of(t)}
        found = {w: self.values[w] for w in sorted(words) if self.values[w] > least}
        self.forget()
        return found


def spelled_out(tokens: list[str], lone: np.ndarray, begins: np.ndarray) -> dict[tuple[int, int], str]:
    """The words that three or more single letters in a row make, by where these begin and end. A text's end parts them."""
    out = {}
    edge = np.flatnonzero(np.diff(np.concatenate([[0], lone.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        cut = [a, *[i for i in range(a + 1, b) if begins[i]], b]
        out |= {(x, y): "".join(c for t in tokens[x:y] for c in t if c.isalpha()) for x, y in zip(cut, cut[1:]) if y - x > 2}
    return out


def words_of(sentence: str) -> list[str]:
    """The words of a sentence, as they are compared."""
    tokens = tokens_of(sentence)
    lone = np.array([len(t) < 4 and sum(c.isalpha() for c in t) == 1 for t in tokens], bool)
    spelled = spelled_out(tokens, lone, np.zeros(len(tokens), bool))
    return sorted({w for t in [*tokens, *spelled.values()] for w in parts_of(t)})


@dataclass
class Model:
    strings: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: np.ndarray


def word_table(docs: DataFrame) -> DataFrame:
    """(word, toxic_docs, clean_docs) over labelled documents."""

    def split(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(w, t) for text, t in zip(frame.text, frame.toxic) for w in {p for x in set(tokens_of(text)) for p in parts_of(x)}]
            yield pd.DataFrame(found, columns=["word", "toxic"])

    each = docs.select("text", "toxic").mapInPandas(split, "word string, toxic int")
    return each.groupBy("word").agg(F.sum("toxic").alias("toxic_docs"), F.sum(1 - F.col("toxic")).alias("clean_docs"))


#: Columns that read_docs() adds.
READ = ("top", "top_word", "top_sentence", "features")


Value = tuple[np.ndarray, np.ndarray, float] | dict[str, float]


def reader_of(value: Value, named: bool = True) -> Reader:
    """``value`` has strings, the machine's weights of them and its bias, or the values of some words, others having MISSING."""
    if isinstance(value, dict):
        return Reader(lambda words: np.array([value.get(w, MISSING) for w in words]), named)
    return Reader(lambda words: word_scores(words, *value[:2]) + value[2], named)


def read_docs(docs: DataFrame, value: Value, keep: list[str], named: bool = True) -> DataFrame:
    """The kept columns, then the highest value of a row's sentences, the word and the sentence that have it, and the features.

    Word and sentence are empty unless ``named``. The columns are named READ, with underscores in front while a kept column has such a name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(value)
    at, names = fresh("text", keep), [fresh(c, keep) for c in READ]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shared.value, named)
        for part in slices(batches, at):
            found = list(zip(*reader.read(part.column(at).fill_null("").to_pylist()))) or [()] * len(names)
            kinds = pa.float64(), pa.string(), pa.string(), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(x, k) for x, k in zip(found, kinds)]], [*keep, *names])

    schema = f"{kept_schema(docs, keep)}{names[0]} double, {names[1]} string, {names[2]} string, {names[3]} array<double>"
    return with_text(docs, keep, at).mapInArrow(run, schema)


def violations(clean: DataFrame, value: Value, least: float = -0.9) -> list[str]:
    """The words of clean sentences that are not low: TRAINING at most, the highest ones."""
    shared = clean.sparkSession.sparkContext.broadcast(value)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shared.value)
        for part in slices(batches):
            found = reader.above(part.column("text").fill_null("").to_pylist(), least)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], ["word", "top"])

    found = clean.select("text").mapInArrow(run, "word string, top double").groupBy("word").agg(F.max("top").alias("top"))
    return [r.word for r in found.orderBy(F.desc("top"), "word").limit(TRAINING).collect()]


def highest(docs: DataFrame, value: Value, least: float) -> list[tuple[str, str]]:
    """(sentence, word): of each document the highest sentence and its highest word, if above ``least``; TRAINING at most."""
    found = read_docs(docs, value, []).where((F.col("top") > least) & (F.col("top_word") != ""))
    best = found.groupBy("top_sentence", "top_word").agg(F.max("top").alias("top")).orderBy(F.desc("top"), "top_sentence").limit(TRAINING)
    return [(r.top_sentence, r.top_word) for r in best.collect()]


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """A machine fitted to about ``fit_docs`` documents of each label in the learning folds."""
    known = labels.where(F.col("toxic").isNotNull() & (crc_fold(labels, FOLDS) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = stored(texts.join(F.broadcast(sampled(known, ["doc_id"], "toxic", fit_docs)), "doc_id"), "toxic-docs")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    rate = (F.col("toxic_docs") + 0.5) / n[1] / ((F.col("clean_docs") + 0.5) / n[0])
    table = stored(word_table(rows).withColumn("rate", rate), "toxic-words")
    total = float(n[0] + n[1])
    expected = (F.col("toxic_docs") + F.col("clean_docs")) / total
    told = [F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (expected * n[k]))).otherwise(0.0) for c, k in (("toxic_docs", 1), ("clean_docs", 0))]
    evidence = 2 * (told[0] + told[1])
    sure = table.where("rate > 4").withColumn("evidence", evidence).orderBy(F.desc("evidence"), "word").limit(TRAINING).collect()
    typical = table.where("rate > 2").select("word", (F.col("toxic_docs") * F.log("rate")).alias("value"))
    typical = {r.word: r.value for r in typical.orderBy(F.desc("value"), "word").limit(10 * TRAINING).collect()}
    usual = [r.word for r in table.where("rate < 4").orderBy(F.desc("clean_docs"), "word").limit(LANDMARKS).collect()]
    landmarks = list(dict.fromkeys([*[r.word for r in sure][:LANDMARKS], *usual]))
    sure = Counter({r.word: r.toxic_docs for r in sure if r.evidence > EVIDENCE})
    positive, negative = highest(toxic, typical, MISSING), highest(clean, {w: 0.0 for w in usual}, MISSING)
    low = {w for x, _ in negative for w in words_of(x)}
    for last in [False] * ROUNDS + [True]:
        often = Counter(w for _, w in positive if w not in low)
        high = sure | Counter({w: n for w, n in often.items() if n > 1 or not sure and max(often.values()) == 1})
        training = sorted(low.difference(high))
        if not high or not training:
            return None
        landmarks = list(dict.fromkeys([*landmarks, *[w for w, _ in high.most_common(LANDMARKS)]]))
        x, mapped = nystrom(landmarks, [*high, *training])
        w, bias = svm(x, np.append(np.ones(len(high)), -np.ones(len(training))))
        value = *folded(landmarks, mapped @ w), bias
        if not last:
            hard = violations(clean, value)
            low |= set(hard)
            landmarks = list(dict.fromkeys([*landmarks, *hard[: LANDMARKS // 2]]))
            positive = highest(toxic, value, -1.0) or positive
    scored = read_docs(rows.select("toxic", "text"), value, ["toxic"], named=False).select("toxic", "features").toPandas()
    return Model(*value, logistic(np.stack(scored.features), scored.toxic.to_numpy()))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes, the offset last, of the logistic function that fits the labels, by Newton steps."""
    x, w = np.concatenate([x, np.ones((len(x), 1))], axis=1), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.full(x.shape[1] - 1, 1e-2), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The kept columns and then the score, 0 to 1.

    The score's column is toxic_score, with underscores in front while a kept column has that name.
    """
    name = fresh("toxic_score", keep)
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in keep]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias(name))
    found = read_docs(docs, (model.strings, model.weights, model.bias), keep, named=False)
    told = F.col(f"`{found.columns[-1]}`")
    value = sum((F.lit(float(m)) * told[i] for i, m in enumerate(model.slopes[:-1])), F.lit(float(model.slopes[-1])))
    return found.select(*kept, (1 / (1 + F.exp(-value))).alias(name))
