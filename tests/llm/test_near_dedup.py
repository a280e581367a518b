"""Near-duplicates against brute force on full sets."""

import math
from collections import defaultdict

import numpy as np
import pytest
from cases import awkward, frame, row, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import components, near_dedup, queries
from lumenframe.llm.text import hashed_words


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(k)])) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent=80):
    """(number of shingles, component) of each row; links by a prefix filter and full sets."""
    sets = [shingles(r[1], k) for r in rows]
    kinds = list(dict.fromkeys(s for s in sets if s))
    often = defaultdict(int)
    for s in kinds:
        for g in s:
            often[g] += 1
    parent = list(range(len(kinds)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = defaultdict(list)
    for i in sorted(range(len(kinds)), key=lambda i: len(kinds[i])):
        s = kinds[i]
        rare = sorted(s, key=lambda g: (often[g], g))[: len(s) - math.ceil(len(s) * percent / 100) + 1]
        for j in {j for g in rare for j in index[g]}:
            both = len(s & kinds[j])
            if 100 * both >= percent * (len(s) + len(kinds[j]) - both):
                parent[root(i)] = root(j)
        for g in rare:
            index[g].append(i)
    at, least = {s: i for i, s in enumerate(kinds)}, {}
    for r, s in zip(rows, sets):
        if s and r[0] is not None:
            c = root(at[s])
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted((str(r[0]), len(s), str(least.get(root(at[s])) if s else r[0])) for r, s in zip(rows, sets))


def variants(n, seed=0):
    """Texts with copies of which every so many words differ, around the similarity that links."""
    out = []
    for b in range(n):
        words = sentence(seed + b, 60 + b % 40).split()
        for step in (0, 50, 29, 23, 19, 17, 13):
            out.append(" ".join(f"x{b}{i}" if step and i % step == 5 else w for i, w in enumerate(words)))
    return out


@pytest.mark.parametrize("shingle", [2, 5])
def test_same_as_brute_force(spark, shingle):
    rows = [row(i, t) for i, t in enumerate(variants(25))] + [(900 + r[0] if r[0] is not None else None, *r[1:]) for r in awkward()]
    got = near_dedup.near_groups(frame(spark, rows), shingle).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, shingle)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_one_large_group(spark):
    base = sentence(1, 120).split()
    texts = [" ".join(f"y{k}" if i == (k * 13) % 120 else w for i, w in enumerate(base)) for k in range(400)]
    got = near_dedup.near_groups(frame(spark, [row(i, t) for i, t in enumerate(texts)]), 2).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def dense(n, own=14):
    """Texts around one template that are too far apart to be linked, and for every fourth one a near copy of its own.

    Of 150 words, ``own`` are a text's own.
    """
    base, out = sentence(1, 150).split(), []
    for k in range(n):
        words = [f"z{k}{i}" if (i + 11 * k) % 150 < own else w for i, w in enumerate(base)]
        out.append(" ".join(words))
        if k % 4 == 0:
            out.append(" ".join(f"q{k}{i}" if i in ((7 * k) % 150, (7 * k + 40) % 150) else w for i, w in enumerate(words)))
    return out


@pytest.mark.parametrize("crowd", [4096, 4])
def test_full_windows_and_lists_lose_no_link(spark, monkeypatch, crowd):
    """Named pairs are taken away, so that all links have to come from the regions noted as full, crowded ones included."""
    named = near_dedup.named_pairs
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "named_pairs", lambda rows, percent: named(rows, percent).where("b IS NULL"))
    rows = [row(i, t) for i, t in enumerate(dense(60))]
    got = near_dedup.near_groups(frame(spark, rows), 2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 2)
    assert not all(r.kept for r in got)


def in_one_region(rows, percent):
    """named_pairs() of a forest that shows no pair and notes all classes in one region of the first tree."""
    region = F.unhex(F.lit("00" * (1 + 2 * near_dedup.LEAST_DEPTH))).alias("region")
    return rows.select(F.col("set_key").alias("a"), F.lit(None).cast("binary").alias("b"), region, F.lit(None).cast("int").alias("shared")).distinct()


def test_crowded_regions_send_no_more_than_linearly_many_rows(spark, monkeypatch):
    """Rows sent to block comparisons, with texts of which more than a fifth is their own, and with twice as many."""
    blocks, sent = near_dedup.between_blocks, []

    def counted(*args):
        out = blocks(*args)
        sent[-1] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CROWD", 8)
    monkeypatch.setattr(near_dedup, "named_pairs", in_one_region)
    monkeypatch.setattr(near_dedup, "between_blocks", counted)
    for n in (60, 120):
        sent.append(0)
        rows = [row(i, t) for i, t in enumerate(dense(n, 45))]
        got = near_dedup.near_groups(frame(spark, rows), 2).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 2)
    assert 0 < sent[1] < 2.5 * sent[0]


def test_exact_links_without_the_forest(spark, monkeypatch):
    """Neither named pairs nor noted classes come from the forest, so that all links have to come from rare shingles."""
    named = near_dedup.named_pairs
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "named_pairs", lambda rows, percent: named(rows, percent).where("a IS NULL"))
    rows = [row(i, t) for i, t in enumerate(dense(60) + variants(6))]
    got = near_dedup.near_groups(frame(spark, rows), 2, exact=True).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 2)


def test_query_on_the_small_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op6_near_dedup(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 2)


def test_stage_drops_what_is_not_kept(spark):
    docs = frame(spark, [row(i, t) for i, t in enumerate(variants(6))] + awkward())
    labels = near_dedup.labelled_rows(docs, 5, 80).collect()
    got = near_dedup.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in labels if r.kept)


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    texts = variants(1)
    docs = frame(spark, [row(1, texts[0]), row(5, texts[1]), row(5, "something else that is quite alone here")])
    assert sorted((r.doc_id, r.text[:9]) for r in near_dedup.drop_near_copies(docs, 2).collect()) == sorted([(1, texts[0][:9]), (5, "something")])


def test_rows_without_ids_are_linked_too(spark):
    texts = variants(1)
    docs = frame(spark, [row(None, texts[0]), row(None, texts[1]), row(7, texts[0] + " more"), row(None, "quite alone here")])
    got = near_dedup.near_groups(docs, 2).collect()
    assert sorted(str(r.component_id) for r in got) == ["7", "7", "7", "None"]
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_copies(docs, 2).collect()) == ["7", "None"]


def test_long_words_are_told_apart(spark):
    a, b = "a" * 64, "b" * 64
    got = near_dedup.near_groups(frame(spark, [row(1, a + b * 2 + a), row(2, b + a * 2 + b)]), 2).collect()
    assert sorted(r.component_id for r in got) == [1, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**20), min_size=1, max_size=8), st.integers(1, 1000))
def test_different_words_have_different_hashes(changes, size):
    """Words that differ in some bytes, by their hashes of words and of one-word sets."""
    base = np.full(size, 97, np.uint8)
    other = base.copy()
    for c in changes:
        other[c % size] = 98 + c % 20
    data, starts = np.concatenate([base, [np.uint8(32)], other]), np.array([0, 2 * size + 1])
    found = hashed_words(data, starts)
    assert len(found.hash) == 2 and found.hash[0] != found.hash[1]


def test_empty_table(spark):
    assert near_dedup.near_groups(frame(spark, [])).count() == near_dedup.drop_near_copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 30)], [(i % 7, i) for i in range(40)] + [(50, 51), (51, 50), (52, 52)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
