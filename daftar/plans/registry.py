"""Queries of the catalog engine and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import arabic, io_queries  # noqa: F401
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category counts of the catalog: one pass over a scan of narrow columns."""
    return QUERIES["category_counts_overlapping"](spark, sf_dir)
