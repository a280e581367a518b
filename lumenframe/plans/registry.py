"""Name, query and DuckDB SQL of each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.plans import blobs, capture, codestream, coding, geometry, imaging, planning, streams, telemetry

GROUPS = (telemetry, planning, imaging, codestream, blobs, geometry, capture, streams, coding)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for g in GROUPS for k, v in g.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for g in GROUPS for k, v in g.ORACLES.items()}
