"""The pipeline against a plain version of each stage, document by document."""

import numpy as np
import pytest
import sentencepiece
from cases import sentence
from test_near_dedup import brute
from test_pages_and_benchmark import brute_tiles, words
from test_text_models import brute_features

import corpus_pipeline
from lumenframe.llm import decontamination, near_dedup, quality, sentencepieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad texts, exact and near copies, nulls, and texts with a benchmark passage in order and out of it."""
    passages = [sentence(500 + i, 24) for i in range(3)]
    texts = [sentence(i, 40) for i in range(30)] + ["!!! ?? " * (5 + i % 9) for i in range(10)]
    texts += [sentence(3, 40), sentence(4, 40), sentence(4, 40), None, "", sentence(7, 40).replace("7", "7", 1) + " more", " ".join(["new", *sentence(8, 40).split()[1:]])]
    moved = passages[1].split()
    texts += [f"{sentence(60, 20)} {passages[0]} {sentence(61, 10)}", " ".join([*sentence(62, 15).split(), *moved[12:], *sentence(63, 9).split(), *moved[:12]]), f"{sentence(64, 20)} {' '.join(passages[2].split()[:8])}"]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {i: t or "" for i, t in enumerate(texts)}, passages


def test_same_as_a_plain_version(spark, folder):
    path, docs, passages = folder
    model = quality.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    g = {i: quality.design(brute_features(t)[None].astype(np.float32).astype(float), model.mean, model.scale)[0] @ model.weights for i, t in docs.items()}
    good = {i: docs[i] for i in docs if 1 / (1 + np.exp(-g[i])) >= quality.THRESHOLD}
    assert 30 <= len(good) < len(docs) and not any(docs[i].startswith("!!!") for i in good)
    last = {t: max(i for i in good if good[i] == t) for t in good.values()}
    single = {i: good[i] for i in sorted(last.values())}
    assert len(single) < len(good)
    apart = {int(c) for i, n, c in brute(list(single.items()), near_dedup.SHINGLE)}
    alone = {i: t for i, t in single.items() if i in apart}
    assert len(alone) < len(single)

    def leaks(text):
        held = [(len(words(p)), sum(n for *_, n in brute_tiles(words(text), words(p), decontamination.LEAST))) for p in passages]
        return any(n >= decontamination.THRESHOLD * size for size, n in held)

    clean = {i: t for i, t in alone.items() if not leaks(t)}
    assert len(clean) < len(alone)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.VOCABULARY)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {i: library.encode(t) for i, t in clean.items()}
