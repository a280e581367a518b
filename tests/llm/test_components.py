"""Components by stars, over edges few enough to broadcast their nodes and over more."""

import random

import pytest

from lumenframe.llm import components as c


def graph(seed):
    """Chains, a hub, a cycle, repeated and reversed edges, a loop, and random edges."""
    r = random.Random(seed)
    names = list(range(400))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(60)] + [(names[100], names[i]) for i in range(101, 180)] + [(names[200 + i], names[200 + (i + 1) % 7]) for i in range(7)]
    edges += [(r.choice(names[220:]), r.choice(names[220:])) for _ in range(80)] + [(names[0], names[0])]
    return edges + [(b, a) for a, b in edges[:20]] + edges[30:40]


def roots(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {x: find(x) for x in top}


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_are_those_of_union_find(spark, few, monkeypatch):
    monkeypatch.setattr(c, "FEW_EDGES", few)
    edges = graph(few)
    got = c.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == roots(edges)


@pytest.mark.parametrize(("edges", "stars"), [([(2, 1), (3, 1), (5, 4)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False), ([], True)])
def test_stars(spark, edges, stars):
    assert c.are_stars(spark.createDataFrame(edges, "u long, v long")) is stars


def test_no_round_only_looks(spark, monkeypatch):
    """Stars take one round, of one stored table besides the edges."""
    names, real = [], c.stored
    monkeypatch.setattr(c, "stored", lambda df, name: names.append(name) or real(df, name))
    assert {tuple(r) for r in c.components(spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "u long, v long")).collect()} == {(2, 1), (3, 1), (1, 1), (5, 4), (4, 4)}
    assert names == ["edges", "edges"]
