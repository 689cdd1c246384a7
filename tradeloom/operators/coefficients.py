"""Tables made from fitted coefficients."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import presets
from tradeloom.session import small_table


def side_by_side(tables: list[DataFrame], value: str = "estimate") -> DataFrame:
    """One row per term and one column per model."""
    return reduce(DataFrame.unionByName, tables).groupBy("term").pivot("model").agg(F.first(value))


def with_name_parts(table: DataFrame, pattern: str = r"gamma_(\d+)_(\d{4})") -> DataFrame:
    """Country and year read from the term name, for tables that come without labels."""
    found = F.regexp_extract("term", pattern, 1)
    return table.withColumns({
        "country": F.when(found != "", found),
        "year": F.regexp_extract("term", pattern, 2).try_cast("int"),
    })


def elasticity(table: DataFrame) -> DataFrame:
    """Yearly effect in percent with its bounds as stored: lower from the upper bound and the reverse."""
    return table.filter(~F.col("dropped")).select(
        "model", "term", "year",
        (F.col("estimate") * 100).alias("elasticity"),
        (F.col("ci_high") * 100).alias("bound_low"),
        (F.col("ci_low") * 100).alias("bound_high"),
    )


def elasticity_of_models(tables: list[DataFrame]) -> DataFrame:
    """Several models: unscaled absolute effect, bounds negated and swapped."""
    return reduce(DataFrame.unionByName, tables).filter(~F.col("dropped")).select(
        "model", "term", "year",
        F.abs("estimate").alias("elasticity"),
        (-F.col("ci_high")).alias("bound_low"),
        (-F.col("ci_low")).alias("bound_high"),
    )


def weighted_average(table: DataFrame, outcome: str, weights: dict[int, float] | None = None) -> DataFrame:
    """Weighted sum over years of each country's coefficient, in percent.

    The error column is the same weighted sum of the standard errors. That adds
    them linearly, as if the yearly estimates were perfectly correlated.
    """
    scale = small_table(table.sparkSession, list((weights or presets.COEFFICIENT_WEIGHTS).items()), "year int, weight double")
    return table.filter(~F.col("dropped")).join(scale, "year").groupBy("country").agg(
        (F.sum(F.col("estimate") * F.col("weight")) * 100).alias(f"average_coefficient_{outcome}"),
        (F.sum(F.col("std_error") * F.col("weight")) * 100).alias(f"linear_std_error_{outcome}"),
    )


def weighted_averages(tables: dict[str, DataFrame], weights: dict[int, float] | None = None) -> DataFrame:
    """Averages of several outcomes side by side; a country missing in one of them keeps its row."""
    parts = [weighted_average(t, outcome, weights) for outcome, t in tables.items()]
    return reduce(lambda a, b: a.join(b, "country", "full"), parts)


def append_missing(table: DataFrame, extra: DataFrame, key: str = "country") -> DataFrame:
    """Add the rows of ``extra`` whose key is not in the table yet."""
    return table.unionByName(extra.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def per_country(countries: list[str], fit: Callable[[str], DataFrame]) -> DataFrame:
    """One model per country from ``fit(country)``, stacked."""
    return reduce(DataFrame.unionByName, [fit(c).withColumn("country", F.lit(c)) for c in countries])


def coefficients_wide(stacked: DataFrame, terms: dict[str, str]) -> DataFrame:
    """One row per country with a column per named term."""
    picks = [F.max(F.when(F.col("term") == t, F.col("estimate"))).alias(name) for t, name in terms.items()]
    return stacked.groupBy("country").agg(*picks)


def residuals_both_ways(df: DataFrame, x: str, y: str) -> DataFrame:
    """Residuals of the line of ``y`` on ``x`` and of the line of ``x`` on ``y``."""
    lines = df.agg(F.struct(
        F.regr_slope(y, x).alias("b_y"), F.regr_intercept(y, x).alias("a_y"),
        F.regr_slope(x, y).alias("b_x"), F.regr_intercept(x, y).alias("a_x"),
    ).alias("_l"))
    out = df.withColumn("_l", lines.scalar())
    return out.withColumns({
        "y_residuals": F.col(y) - (F.col("_l.a_y") + F.col("_l.b_y") * F.col(x)),
        "x_residuals": F.col(x) - (F.col("_l.a_x") + F.col("_l.b_x") * F.col(y)),
    }).drop("_l")
