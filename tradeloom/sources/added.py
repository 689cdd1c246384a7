"""Added tariffs: monthly CSV lists, the action log and the exclusion list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom import schema as S
from tradeloom.session import small_table


def scan_added(spark: SparkSession, paths) -> DataFrame:
    """Added-tariff lists as one table; ``time`` such as ``2018m7`` becomes the first of that month."""
    raw = spark.read.schema(S.ADDED_RAW).option("header", True).option("enforceSchema", False).csv(paths)
    return raw.select(
        F.to_date(F.regexp_replace("time", "m", "-"), "yyyy-M").alias("effective_date"),
        F.expr("left(hs_code, length(hs_code) - 2)").alias(S.PRODUCT),
        F.col("tariff_add").alias("rate"),
    )


def scan_dated(spark: SparkSession, path, columns: dict[str, str], date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with date columns given by an explicit schema such as ``{"day": "date"}``."""
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
    return spark.read.schema(ddl).option("header", True).option("enforceSchema", False).option("dateFormat", date_format).csv(path)


def action_log(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Hand-kept tariff actions as a table; absent fields are NULL."""
    names = S.ACTION_LOG.fieldNames()
    return small_table(spark, [tuple(r.get(n) for n in names) for r in records], S.ACTION_LOG)


def set_where(df: DataFrame, column: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """Overwrite ``column`` where a condition holds; the last rule that holds wins."""
    value = F.col(column)
    for condition, new in rules:
        value = F.when(condition, F.lit(new)).otherwise(value)
    return df.withColumn(column, value)


EXCLUSIONS = T.MapType(
    T.StringType(),
    T.ArrayType(
        T.StructType(
            [
                T.StructField("date_of_exclusion_start", T.StringType()),
                T.StructField("chapter_99_code", T.StringType()),
                T.StructField("source_document_url", T.StringType()),
            ]
        )
    ),
)


def flatten_exclusions(df: DataFrame, column: str = "exclusions") -> DataFrame:
    """One row per product and exclusion from a map of code to list of details."""
    rows = df.select(F.explode(column).alias("hts_code", "details")).select("hts_code", F.explode("details").alias("d"))
    return rows.select("hts_code", F.to_date("d.date_of_exclusion_start").alias("date_of_exclusion_start"), "d.chapter_99_code", "d.source_document_url")
