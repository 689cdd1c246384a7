"""The merged panel on disk: Parquet partitioned by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_panel(spark: SparkSession, path: str) -> DataFrame:
    """Panel directory; a filter on ``year`` prunes partitions."""
    return spark.read.parquet(path)


def scan_recursive(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Every matching file below ``path``, whatever the folder names (no partition column is derived)."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(path)


def sql_over_parquet(spark: SparkSession, query: str, path: str) -> DataFrame:
    """SQL over a Parquet path, written as ``{table}`` in the query."""
    return spark.sql(query.replace("{table}", f"parquet.`{path}`"))
