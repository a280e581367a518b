"""Runs of periodic words against comparing every period at every word."""

import random
import re
import zlib

import numpy as np
import pytest
from cases import awkward, frame, row

from lumenframe.llm import periodic_runs


def plain_runs(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(r, n, letters):
    w = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randint(0, 3) if n else 0):
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(3, 12)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        w[r.randrange(n)] = r.randrange(letters)
    return w


@pytest.mark.parametrize("letters", [1, 2, 3, 8, 40])
def test_runs_by_comparing_all(letters):
    r = random.Random(letters)
    for _ in range(700):
        w = periodic(r, r.randint(0, 130), letters)
        assert periodic_runs.runs(w) == plain_runs(w)
        assert periodic_runs.runs(w, 9, 5) == plain_runs(w, 9, 5)


def test_runs_of_long_texts():
    r = random.Random(9)
    for w in (periodic(r, 3000, 6), [i % 7 for i in range(2500)], [0] * 2000, ([1, 0] * 5 + [0] * 9) * 60):
        assert periodic_runs.runs(w) == plain_runs(w)


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.runs([1] * 9, 6, 3)


def test_cutting_at_rare_words_loses_no_run(monkeypatch):
    r = random.Random(4)
    for worth in (1, 10, 10**9):
        monkeypatch.setattr(periodic_runs, "WORTH_CUTTING", worth)
        for _ in range(200):
            w = periodic(r, 200, 12)
            assert periodic_runs.runs(w) == plain_runs(w)


def test_z_function():
    r = random.Random(2)
    for _ in range(300):
        s = periodic(r, r.randint(1, 40), 2)
        assert periodic_runs.z_values(s, len(s) - 1) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LONG_BYTES", 3000)
    rows = [*awkward(), row(50, "x " + "a b " * 9 + "c c c c c c"), row(51, "日 本 " * 4), row(52, "na na na " * 6)]
    got = periodic_runs.find(frame(spark, rows), keep=("doc_id", "text", "key")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words_of(r.text)
        runs = plain_runs(w) if len(w) < 5000 else periodic_runs.runs(np.unique(w, return_inverse=True)[1])
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == runs
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone) and r.key == "k"


def test_names_that_clash(spark):
    docs = spark.createDataFrame([("a a a a a a a", 1)], "text string, runs int")
    (got,) = periodic_runs.find(docs, keep=("runs",)).collect()
    assert got.asDict()["runs"] == 1 and [tuple(x) for x in got["_runs"]] == [(0, 7, 1)] and got.collapsed == "a"


def test_repeated_tails_by_their_rule(spark):
    rows = [row(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(400)] + [row(None, "x y z"), row(7, None)]
    got = periodic_runs.repeated_from_within(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    changed = 0
    for r in got:
        text = next(t for i, t in ((x[0], x[1]) for x in rows) if i == r.doc_id and (i != 7 or t == r.text or t is not None))
        w, h = words_of(text), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is None or h % 10 or not w or r.text is None:
            assert r.text in (text, None)
            continue
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.text == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        changed += r.text != text
    assert changed > 10


def test_longest_of_equal_runs(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b b b b b b"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.best for r in periodic_runs.find(docs).select("doc_id", periodic_runs.longest(periodic_runs.F.col("runs")).alias("best")).collect()}
    assert tuple(got[1]) == (0, 6, 1) and got[2] is None and got[3] is None
