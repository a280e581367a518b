"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes one string of marked words: a mark in front, each space a mark. No piece of the vocabulary has a mark
after another character, so the best segmentation of a text is that of its words (marks, then other characters), one by
one. The distinct words of a slice of texts are sorted, which lays them out as a trie in depth-first order; the forward
states of the prefix that a word shares with the one before are reused, and only the rest is computed.

What a forward state is depends on the kind of vocabulary. For a unigram one it is the largest sum of scores of a
segmentation of the prefix, a character outside the vocabulary costing UNKNOWN below the smallest score. For one
trained by merging (as piece_bpe_32k), the largest sum isn't what merging leaves, so the paths are restricted: two
pieces may follow each other only if merging their characters alone leaves these two. One path to each prefix is left,
and it is the one that merging the whole prefix gives; should there be none, the word is merged as a whole. Characters outside the vocabulary are written as UTF-8 bytes.

Defined cases: null and empty texts have no pieces and decode to an empty text; a mark in a text decodes to a space; of
equal sums the longest last piece wins; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumenframe.llm.text import slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: The penalty of an unknown character, and the kinds of piece that a model file marks.
UNKNOWN = 10.0
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNIGRAM, MERGES = 1, 2
#: Numbers of tokens that aren't pieces: the start of a word, and characters outside the vocabulary.
START, UNKNOWN_FROM = (1 << 24) - 1, 1 << 20
WORD = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Pairs of pieces that a task remembers between slices, and bytes of words with their ids; longer words aren't remembered.
REMEMBERED, HELD_BYTES, LONGEST = 400_000, 96 << 20, 64
#: Bytes that a remembered word takes besides its characters and ids, about.
WORD_BYTES = 240


class NoPath(Exception):
    """No restricted path leads to a prefix; the word is merged as a whole."""


class Pieces:
    """Scores and ids of a vocabulary, read from the bytes of a model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        self.ids = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on past the end of a word")
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if len(self.bytes) < 256:
            raise ValueError("a vocabulary with byte pieces is needed")
        self.longest = max(map(len, self.ids), default=1)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("a unigram or a merge vocabulary is needed")
        self.unknown = min((s for _, s in self.ids.values()), default=0.0) - UNKNOWN
        #: All ends of pieces: what isn't one can't become a piece by adding characters in front.
        self.ends = {p[i:] for p in self.ids for i in range(len(p))}
        self.number = {p: i for p, (i, _) in self.ids.items()}
        self.name = {i: p for p, i in self.number.items()}
        self.pairs: dict[int, bool] = {}
        out = [b""] * len(proto.pieces)
        for piece, (i, _) in self.ids.items():
            out[i] = piece.replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            out[i] = bytes([value])
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(out), np.uint8)

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a short text: the best-scored pair of neighbours first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max((self.ids[a + b][1], -i) if a + b in self.ids else (-np.inf, -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if score == -np.inf:
                break
            parts[-at : -at + 2] = [parts[-at] + parts[-at + 1]]
        return parts

    def follows(self, pair: int) -> bool:
        """Whether merging leaves two tokens side by side. A pair is the first one's number, shifted, and the second's."""
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        a, b = (self.name.get(x) or ("" if x == START else chr(x - UNKNOWN_FROM)) for x in (pair >> 24, pair & 0xFFFFFF))
        known = self.pairs[pair] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def best_sum(self, word: str, end: int, best: list[float]) -> tuple[float, int]:
        """The largest sum for the first end characters, and where the last piece begins."""
        top, begin = -np.inf, end - 1
        for at in range(max(0, end - self.longest), end):
            hit = self.ids.get(word[at:end])
            if hit is not None and best[at] + hit[1] > top:
                top, begin = best[at] + hit[1], at
        if word[end - 1] not in self.ids and best[end - 1] + self.unknown > top:
            top, begin = best[end - 1] + self.unknown, end - 1
        return top, begin

    def last_merged(self, word: str, end: int, tokens: list[int]) -> tuple[int, int]:
        """The last token of what merging leaves of the first end characters, and where it begins."""
        number, pairs, ends = self.number, self.pairs, self.ends
        at = end - 1
        token = number.get(word[at])
        if token is None:
            token = UNKNOWN_FROM + ord(word[at])
        while True:
            if token is not None:
                pair = tokens[at] << 24 | token
                known = pairs.get(pair)
                if self.follows(pair) if known is None else known:
                    return token, at
            at -= 1
            piece = word[at:end]
            if at < 0 or piece not in ends:
                raise NoPath
            token = number.get(piece)

    def segment(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of the words, which are sorted and distinct.

        state[k] and last[k] are the forward state after k characters: the largest sum or the last token, and where the
        last piece begins. Both are kept as far as the next word begins alike.
        """
        merges, number = self.kind == MERGES, self.number
        state, last, before = [START if merges else 0.0], [0], ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del state[shared + 1 :], last[shared + 1 :]
            try:
                for end in range(shared + 1, len(word) + 1):
                    now, begin = self.last_merged(word, end, state) if merges else self.best_sum(word, end, state)
                    state.append(now)
                    last.append(begin)
            except NoPath:
                before = word[: len(state) - 1]
                yield [i for piece in self.merged(word) for i in self.ids_of(piece)]
                continue
            before, pieces, end = word, [], len(word)
            while end:
                pieces.append(word[last[end] : end])
                end = last[end]
            out = []
            for piece in reversed(pieces):
                hit = number.get(piece)
                if hit is not None:
                    out.append(hit)
                else:
                    out += self.ids_of(piece)
            yield out

    def ids_of(self, piece: str) -> list[int]:
        """The id of a piece, or those of its bytes."""
        return [self.number[piece]] if piece in self.number else [self.bytes[x] for x in piece.encode()]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The text of each run of ids; the space of the first mark goes."""
        begin, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        flat = self.flat[ragged(begin, size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[starts]
        return [flat[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(ends[:-1], ends[1:])]


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] numbers, then the same from begin[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def marked_words(text: str) -> list[str]:
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return WORD.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


class Encoder:
    """Encodes slices of texts, remembering the words of earlier ones within HELD_BYTES.

    Words longer than LONGEST seldom come again and are forgotten with their slice.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.known, self.words, self.held = pieces, {}, [], 0

    def forget(self, long: list[str]) -> None:
        """Forgets the last words of all, which are the slice's long ones, and everything once that is too much."""
        for word in long:
            del self.known[word]
        del self.words[len(self.words) - len(long) :]
        if self.held > HELD_BYTES:
            self.known, self.words, self.held = {}, [], 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin with the end last."""
        split = [marked_words(t) for t in texts]
        fresh = sorted({w for words in split for w in words}.difference(self.known))
        found = sorted(zip(fresh, self.pieces.segment(fresh)), key=lambda x: len(x[0]) > LONGEST)
        for word, ids in found:
            self.known[word] = len(self.words)
            self.words.append(ids)
        long = [w for w, _ in found if len(w) > LONGEST]
        self.held += sum(WORD_BYTES + 4 * len(w) + 8 * len(ids) for w, ids in found[: len(found) - len(long)])
        at = np.fromiter((self.known[w] for words in split for w in words), np.int64)
        used, at = np.unique(at, return_inverse=True)
        used = used.tolist()
        sizes = np.array([len(self.words[i]) for i in used], np.int64)
        flat = np.fromiter(chain.from_iterable(self.words[i] for i in used), np.int32)
        each = sizes[at]
        ids = flat[ragged((np.cumsum(sizes) - sizes)[at], each)]
        words = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
        self.forget(long)
        return ids, np.concatenate([[0], np.cumsum(each)])[words]


@lru_cache(maxsize=1)
def encoder_of(model: bytes) -> Encoder:
    """A Python worker's encoder, which keeps the words that it remembers from task to task."""
    return Encoder(Pieces(model))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, decoded: bool = False) -> DataFrame:
    """doc_id, ids and n_pieces of every row's whole text, and round_trip, whether decoding gives the text back.

    With ``decoded``, the decoded text too. The vocabulary is read by the driver and broadcast, about 0.5 MB.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_pieces long, round_trip boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for part in slices(batches):
            texts = part.column("text").fill_null("").to_pylist()
            ids, starts = encoder.encode(texts)
            back = encoder.pieces.decode(ids, starts)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            out = [part.column("doc_id"), lists, pa.array(np.diff(starts)), pa.array([a == b for a, b in zip(texts, back)])]
            names = ["doc_id", "ids", "n_pieces", "round_trip"]
            if decoded:
                out, names = [*out, pa.array(back, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows with ids. A null list gives an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder_of(model.value).pieces
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = pieces.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), starts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
