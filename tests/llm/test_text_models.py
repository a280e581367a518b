"""Quality, toxicity and language models: features and code lengths by brute force, held-out accuracy, awkward rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, frame, row, sentence

from lumenframe.llm import language, quality, queries, text, toxicity

BIG = "/root/testdata/sf0.01"


def held(doc_id, folds, fold):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def test_slices_cover_all_rows_within_the_limit():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "b" * 50, "", "c" * 9, "d"]})
    parts = list(text.slices([batch], limit=10))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 10 for p in parts)


def test_hashed_words_tell_words_apart():
    texts = ["aa bb aa", None, " bb\tcc ", "", "x" * 300 + " " + "x" * 301, "é bb"]
    data, starts = text.buffers(pa.array(texts))
    words = text.hashed_words(data, starts)
    want = [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    assert words.text.tolist() == [i for i, _ in want]
    names = defaultdict(set)
    for h, (_, w) in zip(words.hash.tolist(), want):
        names[h].add(w)
    assert all(len(x) == 1 for x in names.values()) and len(names) == len({w for _, w in want})


# Language


def brute_bits(train: bytes, target: bytes, order: int) -> float:
    """PPM with escape method C and exclusion, symbol by symbol."""
    counts = defaultdict(Counter)
    padded = b"\0" * order + train
    for i in range(order, len(padded)):
        for d in range(order + 1):
            counts[padded[i - d : i]][padded[i]] += 1
    total, padded = 0.0, b"\0" * order + target
    for i in range(order, len(padded)):
        out: set[int] = set()
        for d in range(order, -1, -1):
            seen = counts.get(padded[i - d : i])
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in out}
            if not left:
                continue
            all_ = sum(left.values()) + len(left)
            if padded[i] in left:
                total -= np.log2(left[padded[i]] / all_)
                break
            total -= np.log2(len(left) / all_)
            out |= set(left)
        else:
            total += np.log2(256 - len(out))
    return total


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_code_lengths_are_exact(order):
    train = b"the cat sat on the mat, the other cat sat too. " * 3 + "été à côté".encode()
    targets = [b"the cat", b"a", b"xyz the", "côté".encode(), b"the other mat sat on 12 cats", b"t"]
    codes = language.grams(*text.buffers(pa.array([train])), order)
    tree = language.ContextTree(*np.unique(codes, return_counts=True), order)
    got = language.code_lengths([tree], *text.buffers(pa.array(targets)))[:, 0]
    assert got == pytest.approx([brute_bits(train, t, order) for t in targets])


def test_predictions_by_brute_force(spark):
    """Language and score of each text, its code lengths symbol by symbol."""
    learnt = {"en": "the cat sat on the mat and the dog ran to the house ", "fr": "le chat est sur la table et le chien va à la maison ", "de": "die katze liegt auf dem tisch und der hund läuft zum haus "}
    rows = [row(i, t * 3, k) for i, (k, t) in enumerate(learnt.items())]
    tests = ["the dog", "la maison est", "der tisch", "", None, "123 456", "haus house", "é", "zzz"]
    trees = language.fit(frame(spark, rows))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame(spark, [row(i, t, None) for i, t in enumerate(tests)]), trees).collect()}
    for i, t in enumerate(tests):
        bits = {k: brute_bits((x * 3).encode(), (t or "").encode(), language.ORDER) for k, x in sorted(learnt.items())}
        best = min(bits, key=bits.get)
        want = (best, 1 / sum(2 ** (bits[best] - b) for b in bits.values())) if any(c.isalpha() for c in t or "") else ("und", 0.0)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1])


def test_languages_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    got = queries.op3_language(spark, BIG).collect()
    assert len(got) == len(lang) and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97


def test_language_of_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(rows)
    und = Counter(str(r.doc_id) for r in got if r.lang_pred == "und")
    assert und == Counter(str(r[0]) for r in rows if not any(c.isalpha() for c in r[1] or ""))
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}
    kept = language.predict(docs.withColumnRenamed("sha", "lang_pred"), language.fit(docs), docs.columns[:-1] + ["lang_pred"])
    assert kept.columns[-3:] == ["lang_pred", "_lang_pred", "_score"] and kept.count() == len(rows)
    assert language.fit(frame(spark, [])) == {} and language.predict(frame(spark, []), {}).count() == 0


# Quality


def brute_features(t: str) -> np.ndarray:
    raw = t.encode()
    words = raw.split()
    out = np.zeros(quality.WIDTH)
    for b in raw:
        out[quality.byte_class(b)] += 1
    out[: quality.N_CLASSES] = np.sqrt(out[: quality.N_CLASSES] / max(1, len(raw)))
    if words:
        upper = [all(65 <= c <= 90 for c in w) and len(w) > 1 for w in words]
        marked = [w[-1] < 128 and not chr(w[-1]).isalnum() and w[-1] not in b".," for w in words]
        again = [a == b for a, b in zip(words, words[1:])]
        out[quality.N_CLASSES : quality.N_PLAIN] = [np.log1p(len(words)), np.mean([len(w) for w in words]) / 10, np.mean(upper), np.mean(marked), sum(again) / len(words), len(set(words)) / len(words)]
    cells = quality.N_PLAIN, quality.N_PLAIN + quality.TRIGRAMS
    grams = [int.from_bytes(raw[i : i + 3], "big") for i in range(len(raw) - 2)]
    for g in grams:
        out[cells[0] + int(text.mixed(np.array([g], np.uint64))[0]) % quality.TRIGRAMS] += 1 / len(grams)
    for w in words:
        out[cells[1] + int(text.hashed_words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash[0]) % quality.WORDS] += 1 / len(words)
    out[quality.N_PLAIN :] = np.sqrt(out[quality.N_PLAIN :])
    return out


def test_features_by_brute_force():
    texts = ["", "a", "AB ab!! ab ab.\nX | y", "  ", "é É 12 %%% %%%", sentence(1, 50), "END"]
    got = quality.features(*text.buffers(pa.array(texts)))
    assert got == pytest.approx(np.stack([brute_features(t) for t in texts]))


@pytest.mark.parametrize(("query", "label", "least"), [("op1_quality", "quality", 0.95), ("op2_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(query, label, least, spark):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    got = queries.QUERIES[query](spark, BIG).collect()
    assert len(got) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) >= least


def test_negative_labels_of_quality_are_never_used(spark):
    docs = frame(spark, [row(i, sentence(i, 30) if i % 3 else "!!! " * 30) for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    a, b = quality.fit(docs, labels), quality.fit(docs, labels.where("quality = 1"))
    assert a.weights == pytest.approx(b.weights) and abs(a.prior - 2 / 3) < 0.1
    kept = {r.doc_id for r in quality.keep_good(docs, a).collect()}
    assert kept == {i for i in range(300) if i % 3}


def brute_risk(x, trusted, model, weights):
    g = np.array([quality.design(v[None], model.mean, model.scale)[0] @ weights for v in x])
    loss = lambda z: np.log1p(np.exp(-z))
    negative = loss(-g).mean() - model.prior * loss(-g[trusted]).mean()
    return model.prior * loss(g[trusted]).mean() + max(0.0, negative) + 0.5 * quality.RIDGE * (weights[:-1] ** 2).sum()


def test_scores_and_risk_by_brute_force(spark):
    """Scores text by text, and a clipped risk that no small change of the weights makes much less."""
    texts = [sentence(i, 30) if i % 3 else "!!! " * (5 + i % 20) for i in range(240)]
    docs = frame(spark, [row(i, t) for i, t in enumerate(texts)])
    model = quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(240) if i % 3], "doc_id long, quality int"))
    x = np.stack([brute_features(t) for t in texts]).astype(np.float32).astype(float)
    want = [1 / (1 + np.exp(-(quality.design(v[None], model.mean, model.scale)[0] @ model.weights))) for v in x]
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert [got[i] for i in range(240)] == pytest.approx(want, abs=1e-4)
    trusted = np.array([i % 3 > 0 and not held(i, 5, 0) for i in range(240)])
    here, rng = brute_risk(x, trusted, model, model.weights), np.random.default_rng(1)
    for _ in range(30):
        assert brute_risk(x, trusted, model, model.weights + rng.normal(0, 0.05, len(model.weights))) > here - 2e-3


def test_the_clip_acts(spark, monkeypatch):
    """Under a prior that is far too large the second part gets negative, and a step raises it again."""
    seen = []
    plain = quality.sums

    def spy(table, cells, fn):
        s = plain(table, cells, fn)
        if cells > 2 * quality.BINS:
            seen.append(s[0] / 200 - 0.9 * s[2] / 80)
        return s

    monkeypatch.setattr(quality, "sums", spy)
    docs = frame(spark, [row(i, sentence(i, 30) if i < 100 else "!!! " * (5 + i % 20)) for i in range(200)])
    table = quality.feature_table(docs, spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int"))
    n = table.where("trusted").count()
    x = np.array([r.x for r in table.collect()])
    quality.newton(table, x.mean(axis=0), x.std(axis=0) + quality.SCALE, 0.9, np.zeros(quality.WIDTH + 1), n, 200)
    assert min(seen) < 0 and any(a < 0 and b > a for a, b in zip(seen, seen[1:]))


def test_quality_of_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(8, 1), (9, 1), (9, 0), (None, 1), (10, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model, docs.columns)
    assert found.columns == [*docs.columns, "_quality_score"] and found.count() == len(rows)
    assert all(0 <= r._quality_score <= 1 for r in found.collect())
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns
    none = quality.fit(docs, labels.limit(0))
    assert {r._quality_score for r in quality.score(docs, none, docs.columns).collect()} == {0.5}
    assert quality.keep_good(frame(spark, []), quality.fit(frame(spark, []), labels)).count() == 0


# Toxicity


def brute_strings(w: str) -> Counter:
    out = Counter()
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            for k in range(j + 1, len(w)):
                if k - i < toxicity.SPAN:
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def brute_kernel(a: str, b: str) -> float:
    x, y = brute_strings(a), brute_strings(b)
    dot = lambda p, q: sum(n * q[k] for k, n in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_kernels_by_brute_force():
    words, landmarks = ["idiot", "idxiot", "idit", "banana", "aaaa", "été", "x", "дурак", "дурок", "日本語だ"], ["idiot", "banana", "stupid", "дурак", "ёлкапалка"]
    want = [[brute_kernel(a, b) for b in landmarks] for a in words]
    assert toxicity.kernels(words, landmarks) == pytest.approx(np.array(want))
    assert want[1][0] > 0.5 and want[2][0] > 0.5 and want[3][0] < 0.1


def test_folding_is_the_machine():
    landmarks, words = ["idiot", "stupid", "gentle", "morning"], ["idiots", "stupidity", "gently", "mornings"]
    x, mapped = toxicity.nystrom(landmarks, words)
    w, bias = toxicity.svm(x, np.array([1, 1, -1, -1]))
    got = toxicity.word_scores(words, *toxicity.folded(landmarks, mapped @ w))
    assert got == pytest.approx(x @ w)
    assert (np.sign(got + bias) == [1, 1, -1, -1]).all()


def test_words_of_spaced_and_marked_insults():
    found = toxicity.words_of("You i.d.i.o.t! S t u p i d, really; a B c")
    assert {"idiot", "stupid", "abc", "really", "you"} == set(found)
    assert not toxicity.words_of("") and all(len(w) <= toxicity.LONGEST for w in toxicity.words_of("z" * 500))


def brute_read(text: str, value) -> tuple[float, list[float]]:
    """Highest value and features of a text, sentence by sentence and word by word."""
    sentences, words = [[]], []
    for token in text.casefold().replace("\n", " . ").split():
        if len(sentences[-1]) == toxicity.LENGTH:
            sentences.append([])
        v = max([value(p) for p in toxicity.parts_of(token)], default=toxicity.MISSING)
        sentences[-1].append(v)
        words.append((token, v))
        if token.endswith(toxicity.ENDS):
            sentences.append([])
    tops = sorted((max(x) for x in sentences if x), reverse=True)
    hits = len({t for t, v in words if v > 0})
    low = [toxicity.MISSING] * toxicity.HIGHEST
    return tops[0] if tops else toxicity.MISSING, [*(tops + low)[: toxicity.HIGHEST], np.log1p(hits), np.log1p(100 * hits / max(1, len(words)))]


def test_sentences_are_read_as_by_brute_force():
    texts = ["", "one two. three four! five", "\n\n", sentence(1, 100) + ".", "idiot idiot idiot\nfine day", "x" * 90 + " idiot", "...", "no marks " * 40 + "idiots"]
    value = lambda words: np.array([brute_kernel(w, "idiot") - 0.4 for w in words])
    got = toxicity.Reader(value).read(texts)
    for text, (top, word, told, found) in zip(texts, got):
        want = brute_read(text, lambda w: value([w])[0])
        assert (top, found) == (pytest.approx(want[0]), pytest.approx(want[1]))
        assert not word or value([word])[0] == pytest.approx(top) and word in toxicity.words_of(told)


def test_memory_of_words_is_bounded_by_bytes(monkeypatch):
    value = lambda words: np.array([len(w) / 50 - 0.3 for w in words])
    letters = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    texts = [f"short {letters(i)} words. " + (letters(i) * 2000) * (i % 40 == 0) for i in range(120)]
    want = [toxicity.Reader(value).read([t])[0] for t in texts]
    monkeypatch.setattr(toxicity, "HELD_BYTES", 20_000)
    reader, most = toxicity.Reader(value), 0
    for text, one in zip(texts, want):
        assert reader.read([text])[0] == one
        assert reader.above([text], 0.0) == {w: v for w, v in toxicity.Reader(value).above([text], 0.0).items()}
        held = sum(toxicity.TOKEN_BYTES + 4 * len(x) for x in (*reader.known, *reader.values))
        assert held == reader.bytes <= 20_000
        most = max(most, held)
    assert most > 10_000


def test_scores_by_brute_force(spark):
    """The whole result of a small model, word by word."""
    rows = [r for r in awkward() if len(r[1] or "") < 3000] + [row(50, "You utter nitwit. Go away!"), row(51, "a n i t w i t")]
    strings = {k: i for i, k in enumerate(sorted(brute_strings("nitwit")))}
    code = lambda k: (ord(k[0]) << 2 * toxicity.CHARACTER) | (ord(k[1]) << toxicity.CHARACTER) | ord(k[2])
    weight = brute_strings("nitwit")
    names = sorted(strings, key=code)
    model = toxicity.Model(np.array([code(k) for k in names]), np.array([weight[k] for k in names]), -0.3, np.array([2.0, 0.5, 0.1, 0.1, 0.3, 0.2, -1.0]))
    norm = lambda w: np.sqrt(sum(n * n for n in brute_strings(w).values()))
    value = lambda w: sum(n * weight[k] for k, n in brute_strings(w).items()) / norm(w) - 0.3
    got = toxicity.score(frame(spark, rows), model, ["doc_id", "text", "score"])
    assert got.columns == ["doc_id", "text", "score", "toxic_score"]
    for r in got.collect():
        features = brute_read(r.text or "", value)[1]
        if r.doc_id == 51:  # seven letters, one word
            features = [value("anitwit"), *[toxicity.MISSING] * 3, np.log1p(1), np.log1p(100 / 7)]
        assert r.toxic_score == pytest.approx(1 / (1 + np.exp(-(np.dot(model.slopes[:-1], features) + model.slopes[-1]))))


def test_kept_columns_may_have_any_name(spark):
    names = ["top", "top_word", "top_sentence", "features", "toxic_score", "Text", "_text"]
    docs = spark.createDataFrame([(1, "some text", *["x"] * len(names[:5]), "y")], ["doc_id", "text", *names[:5], "_text"])
    model = toxicity.Model(np.array([1]), np.array([1.0]), 0.0, np.zeros(7))
    for m in (model, None):
        got = toxicity.score(docs, m, docs.columns)
        assert got.columns == [*docs.columns, "_toxic_score"] and got.first()._toxic_score == (0.5 if m else 0.0)


def test_inserted_characters_are_tolerated(spark):
    calm = [sentence(i, 25) for i in range(150)]
    rude = [f"{sentence(i + 200, 12)} scoundrel {sentence(i, 8)} nitwit" for i in range(60)]
    docs = frame(spark, [row(i, t) for i, t in enumerate(calm + rude)])
    labels = spark.createDataFrame([(i, int(i >= 150)) for i in range(210)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    tests = ["such a scoundrel and nitwit", "such a scoun-drel and a n i t w i t", "such a scoundxrel and nitwxit", "alpha12 beta33 gamma5"]
    got = {r.doc_id: r.toxic_score for r in toxicity.score(frame(spark, [row(i, t) for i, t in enumerate(tests)]), model, ["doc_id"]).collect()}
    assert [got[i] > 0.5 for i in range(4)] == [True, True, True, False]


def test_toxicity_of_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(8, 1), (9, 0), (9, 1), (5, 0), (None, 1), (10, None)], "doc_id long, toxic int")
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.limit(0)), None):
        got = toxicity.score(docs, model, ["doc_id"]).collect()
        assert len(got) == len(rows) and all(0 <= r.toxic_score <= 1 for r in got)
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), labels), ["doc_id"]).count() == 0
