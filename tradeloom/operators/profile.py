"""Profiles of countries, products, pairs, groups and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom import presets
from tradeloom import schema as S
from tradeloom.functions.columns import fill_missing, ratio, weighted_mean
from tradeloom.functions.joins import attach, attach_summary
from tradeloom.functions.ranks import quantiles
from tradeloom.functions.windows import index_to_base
from tradeloom.operators.sample import top


def name_countries(df: DataFrame, countries: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_iso3`` and ``<column>_name`` from the country table; unknown codes give NULL."""
    table = countries.select(
        F.col("country_code").alias(column),
        F.col("country_iso3").alias(f"{column}_iso3"),
        F.col("country_name").alias(f"{column}_name"),
    )
    return attach(df, table, [column])


def country_profile(df: DataFrame, side: str = S.EXPORTER, where: Column | None = None, scale: float = 1000.0) -> DataFrame:
    """Records and total value per country; values are in thousands, so they are scaled to units."""
    picked = df if where is None else df.filter(where)
    return picked.groupBy(side).agg(F.count("*").alias("record_count"), (F.sum(S.VALUE) * scale).alias("total_value"))


def yearly_top_partners(df: DataFrame, reporter: str, n: int, scale: float = 1.0) -> DataFrame:
    """Yearly value to the ``n`` partners that take most of one exporter's trade."""
    exports = df.filter(F.col(S.EXPORTER) == reporter)
    best = top(exports.groupBy(S.IMPORTER).agg(F.sum(S.VALUE).alias("_v")), "_v", n, S.IMPORTER).select(S.IMPORTER)
    return exports.join(best, S.IMPORTER, "left_semi").groupBy(S.YEAR, S.IMPORTER).agg((F.sum(S.VALUE) * scale).alias("yearly_volume"))


def without_internal_trade(df: DataFrame, bloc: list[str] | None = None) -> DataFrame:
    """Drop flows with both sides in the bloc."""
    members = list(presets.EU_AND_MONACO if bloc is None else bloc)
    return df.filter(~(F.col(S.EXPORTER).isin(members) & F.col(S.IMPORTER).isin(members)))


def importer_unit_values(df: DataFrame, importer: str, tariff: str = "average_tariff_official") -> DataFrame:
    """Unit value and mean tariff of every product one country imports, by year."""
    out = df.filter(F.col(S.IMPORTER) == importer).groupBy(S.PRODUCT, S.YEAR).agg(
        ratio(F.sum(S.VALUE), F.sum(S.QUANTITY)).alias("unit_value"), F.avg(tariff).alias(tariff)
    )
    return out.withColumn("country_code", F.lit(importer))


def yearly_path(df: DataFrame, where: Column, column: str) -> DataFrame:
    """Yearly mean of a column over the chosen rows."""
    return df.filter(where).groupBy(S.YEAR).agg(F.avg(column).alias(column))


def product_profile(df: DataFrame, products: list[str], tariff: str = "average_tariff_official", price: str = "unit_value") -> DataFrame:
    """Yearly totals, plain means and value-weighted means of tariff and prices for chosen products."""
    detrended = f"{price}_detrended"
    return df.filter(F.col(S.PRODUCT).isin(list(products))).groupBy(S.YEAR, S.PRODUCT).agg(
        F.sum(S.QUANTITY).alias(S.QUANTITY),
        F.sum(S.VALUE).alias(S.VALUE),
        F.avg(tariff).alias(tariff),
        F.avg(price).alias(price),
        F.avg(detrended).alias(detrended),
        F.avg("price_global_trend").alias("price_global_trend"),
        weighted_mean(tariff, S.VALUE).alias("weighted_tariff"),
        weighted_mean(price, S.VALUE).alias(f"weighted_{price}"),
        weighted_mean(detrended, S.VALUE).alias(f"weighted_{detrended}"),
    )


def top_pair_trends(df: DataFrame, where: Column, n: int) -> DataFrame:
    """Yearly mean unit value of the ``n`` largest pairs beside the global trend."""
    picked = df.filter(where)
    pair = [S.EXPORTER, S.IMPORTER]
    best = top(picked.groupBy(*pair).agg(F.sum(S.VALUE).alias("_v")), "_v", n, *pair).select(*pair)
    pairs = picked.join(best, pair, "left_semi").groupBy(S.YEAR, *pair).agg(F.avg("unit_value").alias("unit_value"))
    trend = picked.groupBy(S.YEAR).agg(F.avg("price_global_trend").alias("price_global_trend"))
    return pairs.join(trend, S.YEAR, "left")


def tariff_weighted_by_year(df: DataFrame, tariff: str = "average_tariff") -> DataFrame:
    """Value-weighted tariff by year."""
    return df.groupBy(S.YEAR).agg(weighted_mean(tariff, S.VALUE).alias("weighted_tariff"), F.sum(S.VALUE).alias(S.VALUE))


def control_trends(df: DataFrame, treated_products: DataFrame, side: Column, side_name: str, base_year: int, years: list[int], labels=("Tariffed", "Non-Tariffed")) -> DataFrame:
    """Value, quantity and unit value by side, tariff status and year, indexed to the base year.

    ``side`` labels the row, such as destination or source. ``treated_products``
    holds the tariffed product codes.
    """
    flagged = treated_products.select(S.PRODUCT).distinct().withColumn("_hit", F.lit(True))
    rows = attach_summary(df.filter(F.col(S.YEAR).isin(list(years))), flagged, [S.PRODUCT], tag="treated")
    rows = rows.withColumns({"tariff_status": F.when(F.col("_hit"), labels[0]).otherwise(labels[1]), side_name: side})
    totals = rows.groupBy(side_name, "tariff_status", S.YEAR).agg(F.sum(S.VALUE).alias(S.VALUE), F.sum(S.QUANTITY).alias(S.QUANTITY))
    totals = totals.withColumn("unit_value", fill_missing(ratio(S.VALUE, S.QUANTITY), 0.0))
    return index_to_base(totals, [side_name, "tariff_status"], F.col(S.YEAR) == base_year, [S.VALUE, S.QUANTITY, "unit_value"])


def _either(column: str, code: str, name: str) -> Column:
    return F.when(F.col(column) == code, name).otherwise("Rest of World")


def control_preset(df: DataFrame, treated: DataFrame, preset: str, base_year: int = 2017, last_year: int | None = None, codes: dict[str, str] | None = None, group: list[str] | None = None) -> DataFrame:
    """The five comparisons: who sells or buys, and where the goods go.

    ``world`` labels each flow by its exporter, which is how the original
    comparison of "imports" was made; ``world_importer`` labels it by the importer.
    """
    c = codes or presets.COUNTRIES
    exporter, importer = F.col(S.EXPORTER), F.col(S.IMPORTER)
    us, china, uk = c["USA"], c["China"], c["United Kingdom"]
    group = group or presets.country_group("asian_exporters")
    abroad = ("Tariffed by US", "Non-Tariffed by US")
    chosen = {
        "world": (None, S.EXPORTER, us, "USA", "region", 3, ("Tariffed", "Non-Tariffed")),
        "world_importer": (None, S.IMPORTER, us, "USA", "region", 3, ("Tariffed", "Non-Tariffed")),
        "china_to_us": (exporter == china, S.IMPORTER, us, "USA", "destination", 3, abroad),
        "group_to_us": (exporter.isin(group), S.IMPORTER, us, "USA", "destination", 5, abroad),
        "china_to_uk": (exporter == china, S.IMPORTER, uk, "UK", "destination", 3, abroad),
        "uk_from_china": (importer == uk, S.EXPORTER, china, "China", "source", 3, abroad),
    }
    if preset not in chosen:
        raise ValueError(f"unknown preset {preset!r}; use one of {sorted(chosen)}")
    where, column, code, name, side_name, span, labels = chosen[preset]
    years = list(range(base_year, (last_year or base_year + span) + 1))
    rows = df if where is None else df.filter(where)
    return control_trends(rows, treated, _either(column, code, name), side_name, base_year, years, labels)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, NULLs, mean, deviation, extremes and exact quartiles per numeric column."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p"))
    pairs = pairs.select("p.column", "p.x")
    basics = pairs.groupBy("column").agg(
        F.count("x").alias("count"),
        F.count_if(F.col("x").isNull()).alias("null_count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return basics.join(quantiles(pairs, ["column"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "column", "left")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value of each column, as ``column, value, n``; constant columns are left out."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p"))
    counts = pairs.select("p.column", "p.value").filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("column").agg(F.count("*").alias("_kinds")).filter(F.col("_kinds") > 1)
    return attach_summary(counts, kinds.select("column"), ["column"], "left_semi", tag="kinds")


def histogram(df: DataFrame, column: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width bins between the extremes; the top value belongs to the last bin."""
    x = F.col(column).cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    bounds = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n = bounds["lo"], bounds["hi"], bounds["n"]
    if n == 0 or lo == hi:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long" + (", density double" if density else ""))
    width = (hi - lo) / bins
    number = F.least(F.floor((F.col("x") - lo) / width).cast("int"), F.lit(bins - 1))
    out = rows.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    out = out.select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n")
    return out.withColumn("density", F.col("n") / (n * width)) if density else out


def rollup_levels(df: DataFrame, digits: tuple[int, ...] = (2, 4)) -> DataFrame:
    """Value and quantity per pair and year at several product digits and in total, in one pass."""
    cut = {f"_d{n}": F.substring(S.PRODUCT, 1, n) for n in digits}
    base = [S.YEAR, S.EXPORTER, S.IMPORTER]
    keys = [F.col(c) for c in [*base, *cut]]
    sets = [[F.col(c) for c in [*base, f"_d{n}"]] for n in digits] + [[F.col(c) for c in base]]
    out = df.withColumns(cut).groupingSets(sets, *keys).agg(F.sum(S.VALUE).alias(S.VALUE), F.sum(S.QUANTITY).alias(S.QUANTITY))
    code = F.coalesce(*[f"_d{n}" for n in digits], F.lit("total"))
    return out.select(*base, code.alias("product"), S.VALUE, S.QUANTITY)


def extremes(df: DataFrame, column: str = S.YEAR) -> DataFrame:
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows in an order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
