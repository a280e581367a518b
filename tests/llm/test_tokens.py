"""SentencePiece coding against the library, and length histograms against brute force."""

from pathlib import Path

import numpy as np
import pytest
from cases import awkward, frame, row
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import queries, sentencepieces, token_counts

MODEL = Path(sentencepieces.VOCABULARY).read_bytes()


def unigram_model() -> bytes:
    """The same pieces as a unigram vocabulary, without scores too low for single precision."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(MODEL)
    proto.trainer_spec.model_type = sentencepieces.UNIGRAM
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)
    return proto.SerializeToString()


def library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


MODELS = {"merges": MODEL, "unigram": unigram_model()}
PIECES = {k: sentencepieces.Pieces(m) for k, m in MODELS.items()}
LIBRARY = {k: library(m) for k, m in MODELS.items()}


def coded(kind, texts):
    ids, starts = sentencepieces.Encoder(PIECES[kind]).encode(texts)
    assert [t.replace("▁", " ") for t in texts] == PIECES[kind].decode(ids, starts)
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]


@pytest.mark.parametrize("kind", list(MODELS))
def test_same_as_the_library(kind, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", " ", "  a  b ", "\n\n x", "日本語のテキスト 😀 é", "<s> <0x0A> </s>", "q" * 80, "1234 ..... ====", "a\tb\r\n", "    deep"]
    assert coded(kind, texts) == LIBRARY[kind].encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" abcdeinorst,.\n"), st.characters(exclude_categories=["Cs"], exclude_characters="▁\0")), max_size=30), min_size=1, max_size=4))
@pytest.mark.parametrize("kind", ["merges"])
def test_any_text(kind, texts):
    assert coded(kind, texts) == LIBRARY[kind].encode(texts)


def test_very_long_words(spark):
    texts = ["x" * 120_000, "ab" * 60_000, "日本" * 20_000, "-=" * 50_000]
    assert coded("merges", texts) == LIBRARY["merges"].encode(texts)
    docs = frame(spark, [row(i, t) for i, t in enumerate(texts)])
    encoder = token_counts.encoding(Path(token_counts.VOCABULARY).read_bytes())
    assert {r.doc_id: r.n_tokens for r in token_counts.lengths(docs).collect()} == {i: len(encoder.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_words_without_a_path_are_merged_whole(monkeypatch):
    pieces = sentencepieces.Pieces(MODEL)
    monkeypatch.setattr(pieces, "follows", lambda pair: False)
    texts = ["the other theory", "", "日本語 é 😀", "a" * 40]
    ids, starts = sentencepieces.Encoder(pieces).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == LIBRARY["merges"].encode(texts)


def test_shared_prefixes_change_nothing():
    words = sorted({"▁" + w for w in "the there them then these thesis theme a ab abc abcd abd b".split()})
    pieces = PIECES["merges"]
    assert list(pieces.segment(words)) == [next(pieces.segment([w])) for w in words]


def test_forgetting_changes_nothing(monkeypatch):
    texts = ["the cat sat on the mat", "the cats sit", "a mat"] * 3
    want = coded("merges", texts)
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 2)
    monkeypatch.setattr(sentencepieces, "HELD_BYTES", 600)
    monkeypatch.setattr(sentencepieces, "LONGEST", 3)
    encoder = sentencepieces.Encoder(sentencepieces.Pieces(MODEL))
    got = [encoder.encode([t])[0].tolist() for t in texts]
    assert got == want


def test_memory_of_words_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(sentencepieces, "HELD_BYTES", 100_000)
    encoder, most = sentencepieces.Encoder(PIECES["merges"]), 0
    for i in range(60):
        some = [f"w{i}x{j}" for j in range(10)]
        long = f"{i}" + "ab" * 5000
        ids, starts = encoder.encode([long, " ".join(some)])
        assert encoder.pieces.decode(ids, starts) == [long, " ".join(some)]
        assert max(map(len, encoder.known), default=0) <= sentencepieces.LONGEST
        assert sorted(encoder.known.values()) == list(range(len(encoder.words)))
        most = max(most, sum(4 * len(w) + 8 * len(encoder.words[at]) + sentencepieces.WORD_BYTES for w, at in encoder.known.items()))
        assert encoder.held <= 100_000
    assert 50_000 < most <= 100_000


def test_awkward_rows(spark):
    rows = awkward()
    got = sentencepieces.encode(frame(spark, rows), decoded=True)
    back = got.collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in back)
    assert sorted(r.text for r in sentencepieces.decode(got).collect()) == sorted(r[1] or "" for r in rows)
    assert sentencepieces.encode(frame(spark, [])).count() == 0


def test_histogram_is_exact(spark, sf_dir):
    counted = token_counts.lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = np.array([r.n_tokens for r in counted.collect()])
    encoder = token_counts.encoding(Path(token_counts.VOCABULARY).read_bytes())
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(n) == sorted(len(encoder.encode_ordinary(t)) for t in texts)
    hist = queries.op9_token_counts(spark, sf_dir)
    for r in hist.collect():
        assert (r.docs, r.docs_ge, r.docs_le) == ((n == r.n_tokens).sum(), (n >= r.n_tokens).sum(), (n <= r.n_tokens).sum())
        assert (r.tokens, r.tokens_ge, r.truncated_tokens) == (n[n == r.n_tokens].sum(), n[n >= r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())
    assert tuple(token_counts.total(hist).first()) == (len(n), n.sum())
    want = {q: int(np.sort(n)[max(0, int(np.ceil(q * len(n))) - 1)]) for q in (0.1, 0.5, 0.99, 1.0)}
    assert {r.q: r.n_tokens for r in token_counts.quantiles(hist, list(want)).collect()} == want
    cuts = {r.context: (r.truncated_tokens, r.docs_cut) for r in token_counts.truncated(hist, [1, 512, 10**6]).collect()}
    assert cuts == {c: (np.minimum(n, c).sum(), (n > c).sum()) for c in (1, 512, 10**6)}


def test_histogram_of_awkward_rows(spark):
    rows = [*awkward(), row(77, "z")]
    hist = token_counts.histogram(token_counts.lengths(frame(spark, rows)))
    assert token_counts.total(hist).first().docs == len(rows)
    assert hist.where("n_tokens = 0").first().docs == sum(not r[1] for r in rows)
    assert token_counts.histogram(token_counts.lengths(frame(spark, []))).count() == 0
