"""As-of joins and overrides on small tables."""

import pytest

from lumenframe.operators import joins


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_asof_takes_the_first_mark_at_or_after(spark, width):
    marks = {3: 0.3, 10: 1.0, 11: 1.1, 40: 4.0}
    left = spark.createDataFrame([("a", k) for k in range(0, 60, 5)] + [("b", 1)], "g string, k long")
    right = spark.createDataFrame([("a", k, v) for k, v in marks.items()], "g string, m long, v double")
    got = {(r.g, r.k): r.v for r in joins.asof_forward(left, right, "g", "k", "m", "v", width).collect()}
    want = {("a", k): next((v for m, v in sorted(marks.items()) if m >= k), 4.0) for k in range(0, 60, 5)}
    assert got == want | {("b", 1): 0.0}


def test_override_order(spark):
    t = lambda rows: spark.createDataFrame(rows, "k string, value long")
    got = joins.overridden(t([("a", 1), ("b", 1), ("c", 1)]), t([("b", 2), ("c", 2), ("d", 2)]), t([("c", 3), ("e", 3)]), "k")
    assert {r.k: r.value for r in got.collect()} == {"a": 1, "b": 2, "c": 3, "d": 2, "e": 3}


def test_newest_row(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 3, "z"), (1, 2, "y"), (2, 0, "w")], "g long, o long, v string")
    assert {r.g: r.v for r in joins.newest(rows, "g", "o").collect()} == {1: "z", 2: "w"}
