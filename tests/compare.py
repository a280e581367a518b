"""Compares a Spark result with a DuckDB result, whatever the order of rows."""

from __future__ import annotations

import math
from decimal import Decimal


def normal(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, Decimal)):
        return "null" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(normal(r[i]) for i in order) for r in rows)


def assert_same(df, relation):
    columns = relation.columns
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, relation.fetchall())
