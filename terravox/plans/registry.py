"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terravox.plans.pack import PACK

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in PACK.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PACK.items() if sql}
