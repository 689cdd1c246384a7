"""Trade network as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import schema as S
from tradeloom.functions.columns import weighted_mean
from tradeloom.operators.profile import name_countries

DIGITS = {"6-digit": 6, "4-digit": 4, "2-digit": 2, "total": None}


def edges(df: DataFrame, level: str = "2-digit", tariff: str = "average_tariff_official") -> DataFrame:
    """One edge per year, pair and product group, for all years, with its value-weighted tariff."""
    if level not in DIGITS:
        raise ValueError(f"level is one of {list(DIGITS)}")
    width = DIGITS[level]
    product = [] if width is None else [F.substring(S.PRODUCT, 1, width).alias(S.PRODUCT)]
    return df.groupBy(S.YEAR, S.EXPORTER, S.IMPORTER, *product).agg(
        weighted_mean(tariff, S.VALUE).alias("weighted_tariff"), F.sum(S.VALUE).alias(S.VALUE), F.sum(S.QUANTITY).alias(S.QUANTITY)
    )


def nodes(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Countries on either side of an edge, by year, with their names."""
    sides = df.select(S.YEAR, F.explode(F.array(S.EXPORTER, S.IMPORTER)).alias("country")).distinct()
    return name_countries(sides, countries, "country").select(S.YEAR, "country", F.col("country_name").alias("label"))
