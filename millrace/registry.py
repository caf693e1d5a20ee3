"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import basics, kernels, nexmark, streams, tpcc, tpch

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (tpch, nexmark, tpcc, kernels, basics, streams)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
