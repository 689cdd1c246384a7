"""Bilateral trade flows: one CSV per year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom import schema as S
from tradeloom.functions.columns import rate_from_text, zfill


def scan_flows(spark: SparkSession, glob: str) -> DataFrame:
    """All yearly flow files as one table; a glob that matches nothing raises.

    Amounts may be padded text such as ``"  1.5"`` or ``NA``; they become NULL
    when they are no number. A file whose header names other columns, or the same in another order, raises.
    """
    raw = spark.read.schema(S.FLOWS_RAW).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(glob)
    return raw.withColumns({"v": rate_from_text("v"), "q": rate_from_text("q")})


def pad_countries(flows: DataFrame) -> DataFrame:
    """Three-digit country codes."""
    return flows.withColumns({"i": zfill(F.trim("i"), 3), "j": zfill(F.trim("j"), 3)})


def name_columns(flows: DataFrame) -> DataFrame:
    """Panel names: ``i`` is the exporter, ``j`` the importer."""
    return flows.select(
        F.col("t").cast("int").alias(S.YEAR),
        F.col("i").cast("string").alias(S.EXPORTER),
        F.col("j").cast("string").alias(S.IMPORTER),
        F.col("k").cast("string").alias(S.PRODUCT),
        F.col("v").cast("double").alias(S.VALUE),
        F.col("q").cast("double").alias(S.QUANTITY),
    )
