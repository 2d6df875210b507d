"""Parquet scans of the named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; filters and column choices made on it reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
