"""Vector codes and top-k search against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from lumenframe.llm import queries, top_inner, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error double, rank string"


def awkward(n=150, size=16, seed=3):
    """Vectors with ties, repeated rows and ids, nulls, and values that aren't numbers."""
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(r.normal(size=size), 1)], int(i % 4) if i % 7 else None) for i in range(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(60)]  # a hot vector
    rows += [rows[5], rows[5], (500, None, 1), (501, [*rows[1][1][:-1], None], 1), (502, [*rows[1][1][:-1], math.nan], 2), (503, [*rows[1][1][:-1], math.inf], None), (504, [], 2)]
    rows += [(505, [0.5] * 7, 3), (505, [0.25] * size, 3), (-50, [-0.5] * size, None), (600, [1e30] * size, 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 0.5, "r") for r in rows], SCHEMA).repartition(5)


def whole(rows, scale):
    top = vector_codes.LARGEST
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [math.floor(min(max(float(np.float32(x)) * scale, -top), top)) for x in r[1]], r[2]) for r in ok]


def plain_codes(rows, parts, entries, rounds):
    kept = [r for r in whole(rows, vector_codes.SCALE) if r[1] and len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    d = len(kept[0][1]) // parts
    cut = [[r[1][p * d : p * d + d] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda j: (away(c[p], books[p][j]), j)) for p in range(parts)] for c in cut]
        for p in range(parts if turn < rounds else 0):
            for j in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, codes) if k[p] == j]
                books[p][j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else books[p][j]
    errors = [sum(away(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)]
    return sorted((str(r[0]), bytes(k), e, str(r[2])) for r, k, e in zip(kept, codes, errors)), books


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(8, 16, 6), (2, 5, 3), (4, 1, 2), (1, 250, 2)])
def test_codes_by_plain_lloyd(spark, parts, entries, rounds):
    rows = [r for r in awkward() if r[0] != 600]
    coded, books = vector_codes.encode(frame(spark, rows), parts, entries, rounds)
    want, plain = plain_codes(rows, parts, entries, rounds)
    got = vector_codes.with_label_errors(coded).collect()
    assert sorted((str(r.vec_id), bytes(r.code), r.error, str(r.label)) for r in got) == want
    assert books.entries.tolist() == plain
    by = {}
    for _, _, e, label in want:
        by[label] = by.get(label, 0) + e
    assert all(r.label_error == by[str(r.label)] for r in got)
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in plain for e in p for x in e).encode()).hexdigest()


def test_bounds_leave_distances_out():
    """The pruned rounds give the codes of comparing all, with fewer distances, whatever ties there are."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-3, 3, (300, 2)) * 4, r.integers(-2, 2, (600, 2)) + r.integers(0, 6, (600, 1)) * 1000])
    books = vector_codes.Books(x[None, r.permutation(len(x))[:12]].copy())
    state = (np.zeros(len(x), np.int64), np.full(len(x), np.float32(np.inf)), np.zeros((len(x), 12), np.float32))
    counts = []
    for turn in range(8):
        code, upper, lower, _, counted = vector_codes.assign(x, *state, 0, books, exact=turn == 0)
        lower = (vector_codes.halves(lower).astype(np.uint32) << 16).view(np.float32)
        d = vector_codes.squared(x[:, None, :], books.entries[0][None])
        assert code.tolist() == d.argmin(axis=1).tolist()
        assert (upper.astype(float) >= np.sqrt(d[np.arange(len(x)), code])).all() and (lower.astype(float) <= np.sqrt(d)).all()
        counts.append(counted)
        entries = books.entries.copy()
        for j in range(12):
            if (code == j).any():
                entries[0, j] = x[code == j].sum(axis=0) // (code == j).sum()
        books, state = vector_codes.Books(entries, np.sqrt(vector_codes.squared(entries, books.entries).astype(float))), (code, upper, lower)
    assert counts[-1] < counts[0] / 4 and counts[0] < 12 * len(x)


def test_rounded_outwards():
    x = np.array([0.0, 1.0, 1 / 3, 1e9 + 1 / 3, 2**29 + 0.5, 123456.789])
    assert (vector_codes.up(x).astype(float) >= x).all() and (vector_codes.down(x).astype(float) <= x).all()
    assert ((vector_codes.halves(vector_codes.down(x)).astype(np.uint32) << 16).view(np.float32).astype(float) <= x).all()


def plain_top(rows, k, asks):
    kept = [r for r in whole(rows, top_inner.SCALE) if r[0] is not None]
    out = []
    for q in kept:
        if q[0] % asks == 0:
            best = sorted((-sum(a * b for a, b in zip(q[1], c[1])), c[0]) for c in kept if c[0] != q[0])[:k]
            out += [(q[0], i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("block", "asks", "k"), [(8192, 50, 5), (16, 10, 3), (7, 5, 5), (100, 5, 400)])
def test_top_by_plain_search(spark, block, asks, k):
    rows = awkward()
    got = top_inner.search(frame(spark, rows), k, asks, block=block)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, k, asks)


def test_bound_leaves_rows_out_only_below_reach():
    r = np.random.default_rng(5)
    x = (r.normal(size=(400, 24)) ** 3 * 20).astype(np.int64)
    b = top_inner.Block(np.arange(400), np.ascontiguousarray(x.T))
    for q in x[:40]:
        scores = x @ q
        order = np.lexsort((np.arange(400), -scores))[:5]
        for reach in (top_inner.NONE, -(10**6), 0, int(scores[order[-1]]), int(scores[order[0]]) + 1):
            ids, got = b.best(q, -1, 5, reach)
            want = [i for i in order if scores[i] >= reach]
            assert ids.tolist()[: len(want)] == want and got.tolist()[: len(want)] == scores[want].tolist()


def test_large_components_are_exact():
    big = vector_codes.LARGEST
    x = np.array([[big, big - 1, 3], [big, big - 1, 4], [-big, 1, 1]], np.int64)
    ids, scores = top_inner.Block(np.arange(3), np.ascontiguousarray(x.T)).best(x[0], 9, 2)
    assert ids.tolist() == [1, 0] and scores.tolist() == [int(big) ** 2 + (big - 1) ** 2 + 12, int(big) ** 2 + (big - 1) ** 2 + 9]


def test_empty_tables(spark):
    none = frame(spark, awkward()[:1]).limit(0)
    coded, books = vector_codes.encode(none)
    assert vector_codes.with_label_errors(coded).count() == 0 and books.entries.size == 0
    assert top_inner.search(none).count() == 0
    alone = frame(spark, [(50, [1.0] * 8, 1), (51, None, 2)])
    assert top_inner.search(alone).count() == 0
    assert [bytes(r.code) for r in vector_codes.encode(alone)[0].collect()] == [bytes(8)]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_top_inner"])
def test_registered(name):
    assert name in queries.QUERIES and name in queries.ORACLES
