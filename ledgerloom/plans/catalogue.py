"""All named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import analysis, data_quality, front, ledger

MODULES = [data_quality, ledger, analysis, front]
FLAGSHIP = "q_grouped_metrics"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by the names of the queries it stands for."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
