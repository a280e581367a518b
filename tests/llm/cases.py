"""Small document tables with awkward rows."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, score string, quality_score double, set_key string, held_out string, sha string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), "k", "r", "x", 0.5, "s", "h", "z")


def awkward():
    """Nulls, empty, blank and very long texts, ties, repeated rows, marks and characters of several bytes."""
    long = sentence(3, 30_000)
    texts = [None, "", " \n\t ", "a", "one two", long, long, sentence(5, 40), sentence(5, 40), sentence(6, 40), "日本語 テキスト 😀 é", "x" * 5000, "of " * 400]
    rows = [row(i, t, None if i == 3 else "en", None if i == 4 else "s") for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], row(None, "null id"), row(None, None), row(20, sentence(5, 40))]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
