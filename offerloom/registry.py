"""Register of named queries and their DuckDB counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with optional oracle SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers find this package where the driver found it."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{_ROOT}:{paths}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
