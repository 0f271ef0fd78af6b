"""All core queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pipeloom.plans import complete, design, polyline, reference_checks, relational, reports, search, sequential, spatial

MODULES = [reference_checks, search, polyline, relational, spatial, sequential, design, reports, complete]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return queries()["t05_hybrid_topk"](spark, root)
