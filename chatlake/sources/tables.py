"""Base-table scans.

``table(spark, sf_dir, name)`` is a plain parquet scan.  Callers select the
columns they need right after the scan so that Catalyst prunes the parquet
``ReadSchema`` and pushes filters into the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_all(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Full table scan (every column)."""
    return table(spark, sf_dir, name)
