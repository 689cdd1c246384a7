"""Unit values and global trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import schema as S
from tradeloom.functions.columns import ratio
from tradeloom.functions.joins import attach_summary

DETRENDED = {"value": "value_global_trend", "quantity": "quantity_global_trend", "unit_value": "price_global_trend"}


def add_unit_value(df: DataFrame) -> DataFrame:
    return df.withColumn("unit_value", ratio(S.VALUE, S.QUANTITY))


def global_trend(df: DataFrame, name: str = "product_global_trend") -> DataFrame:
    """World unit value per product and year; NULL where no quantity was traded."""
    return df.groupBy(S.PRODUCT, S.YEAR).agg(ratio(F.sum(S.VALUE), F.sum(S.QUANTITY)).alias(name))


def detrend(df: DataFrame, source: DataFrame | None = None, metrics: dict[str, str] | None = None) -> DataFrame:
    """Subtract the world unit value of the product and year from each metric.

    Value, quantity and unit value all get the same trend subtracted, although
    only the unit value shares its unit. Columns of an earlier run are dropped
    first, so running it twice gives the same result.
    """
    metrics = metrics or DETRENDED
    df = df.drop(*metrics.values(), *[f"{m}_detrended" for m in metrics])
    trend = global_trend(source or df, "_trend")
    out = attach_summary(df, trend, [S.PRODUCT, S.YEAR], tag="trend")
    added = {}
    for metric, trend_name in metrics.items():
        added[trend_name] = F.col("_trend")
        added[f"{metric}_detrended"] = F.col(metric) - F.col("_trend")
    return out.withColumns(added).select(*df.columns, *added)


def trend_lines(df: DataFrame, value: str) -> DataFrame:
    """Least-squares line on the year per product; NULL for a single year.

    The line through the rows with a value: the year moments leave out rows
    where the value is missing.
    """
    return df.groupBy(S.PRODUCT).agg(
        F.regr_slope(value, S.YEAR).alias("slope"), F.regr_intercept(value, S.YEAR).alias("intercept")
    )


def detrend_by_line(df: DataFrame, value: str, source: DataFrame | None = None, detrended: str = "detrended_value", line: str = "trend_line_value") -> DataFrame:
    """Subtract each product's own line on the year."""
    out = attach_summary(df, trend_lines(source or df, value), [S.PRODUCT], tag="lines")
    out = out.withColumn(line, F.col("slope") * F.col(S.YEAR) + F.col("intercept"))
    return out.withColumn(detrended, F.col(value) - F.col(line)).select(*df.columns, "slope", "intercept", line, detrended)
