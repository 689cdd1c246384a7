"""Checks of the panel against official rates, expected rows and itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom import presets
from tradeloom import schema as S
from tradeloom.functions.columns import prefix_in, weighted_mean
from tradeloom.functions.joins import attach_summary
from tradeloom.functions.windows import fill_forward


def match_official(panel: DataFrame, official: DataFrame, rules=presets.SECTOR_RATES, rule_year: int = 2018) -> DataFrame:
    """Panel rows of an official product and year with the official rate beside the scheduled one.

    Sector rules override the rate and its year.
    """
    table = official.select(
        S.PRODUCT, F.year("effective_date").alias(S.YEAR), F.col("rate").alias("official_tariff_rate")
    )
    out = attach_summary(panel, table, [S.PRODUCT, S.YEAR], "inner", tag="official")
    rate, year = F.col("official_tariff_rate"), F.col(S.YEAR)
    for prefix, fixed in reversed(list(rules)):
        applies = F.col(S.PRODUCT).startswith(prefix)
        rate = F.when(applies, F.lit(fixed)).otherwise(rate)
    hit = prefix_in(S.PRODUCT, [p for p, _ in rules])
    return (
        out.withColumn("official_year_applied", F.when(hit, F.lit(rule_year)).otherwise(year))
        .withColumn("official_tariff_rate", rate)
        .withColumn("official_tariff_rate_percentage", F.col("official_tariff_rate") * 100)
    )


def _official_by_year(panel: DataFrame, matched: DataFrame) -> DataFrame:
    """One official percentage per product and panel year, carried forward; 0 before the first.

    The fill runs on distinct product-years, not on panel rows.
    """
    rates = matched.groupBy(S.PRODUCT, S.YEAR).agg(F.max("official_tariff_rate_percentage").alias("official_pct"))
    grid = panel.select(S.PRODUCT, S.YEAR).distinct().join(rates, [S.PRODUCT, S.YEAR], "left")
    return fill_forward(grid, [S.PRODUCT], S.YEAR, "official_pct", unique=True).withColumn("official_pct", F.coalesce("official_pct", F.lit(0.0)))


def yearly_discrepancy(panel: DataFrame, matched: DataFrame, tariff: str = "average_tariff_official") -> DataFrame:
    """Mean absolute gap between official and scheduled rate by year."""
    out = attach_summary(panel, _official_by_year(panel, matched), [S.PRODUCT, S.YEAR], tag="official-years")
    return out.groupBy(S.YEAR).agg(F.avg(F.abs(F.col("official_pct") - F.col(tariff))).alias("average_abs_discrepancy"))


def trade_weighted_tariffs(panel: DataFrame, matched: DataFrame, tariff: str = "average_tariff_official") -> DataFrame:
    """Value-weighted tariff by year with and without the official rate added, as long rows."""
    out = attach_summary(panel, _official_by_year(panel, matched), [S.PRODUCT, S.YEAR], tag="official-years")
    yearly = out.groupBy(S.YEAR).agg(
        weighted_mean(tariff, S.VALUE).alias("trade_weighted_effective_tariff"),
        weighted_mean(F.col(tariff) + F.col("official_pct"), S.VALUE).alias("trade_weighted_full_tariff"),
    )
    return yearly.unpivot(S.YEAR, ["trade_weighted_effective_tariff", "trade_weighted_full_tariff"], "tariff_type", "weighted_tariff_rate")


def coverage(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Rows, NULLs and their share, overall or by some columns."""
    missing = F.count_if(F.col(column).isNull())
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"), missing.alias("n_null"), F.try_divide(missing, F.count("*")).alias("null_share")
    )


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two sources and the side(s) each is found on, in one pass over both."""
    def side(df, in_a, in_b):
        return df.select(F.col(key), F.lit(in_a).alias("in_a"), F.lit(in_b).alias("in_b"))

    both = side(a, 1, 0).unionByName(side(b, 0, 1))
    return both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def reconciliation_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the key sets, their union, intersection and symmetric difference."""
    keys = reconcile(a, b, key)
    return keys.agg(
        F.sum("in_a").alias("n_a"),
        F.sum("in_b").alias("n_b"),
        F.count("*").alias("n_union"),
        F.sum(F.col("in_a") * F.col("in_b")).alias("n_both"),
        F.count_if(F.col("in_a") != F.col("in_b")).alias("n_one_sided"),
    )


def _agrees(actual: Column, expected: Column, tolerance: float | None) -> Column:
    """Relative tolerance for numbers, exact text otherwise; a NULL expectation wants NULL."""
    exact = actual.cast("string").eqNullSafe(expected)
    if tolerance is None:
        return exact
    a, e = F.trim(actual.cast("string")).try_cast("double"), expected.try_cast("double")
    close = F.abs(a - e) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(e))
    return F.when(e.isNotNull(), F.coalesce(close, F.lit(False))).otherwise(exact)


def check_rows(
    df: DataFrame, expectations: DataFrame, keys: list[str], values: list[str],
    tolerance: float | None = 0.01, unique: bool = True,
) -> DataFrame:
    """Pass or fail per expected row.

    ``expectations`` has the keys and ``expected_<value>`` as text. A row passes
    when exactly one row (at least one, without ``unique``) has its keys and
    every value agrees; of several rows the least is compared.
    """
    missing = [c for c in [*keys, *values] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    wanted = expectations.select(*keys).distinct()
    found = attach_summary(df, wanted, keys, "left_semi", tag="wanted").groupBy(*keys).agg(F.count("*").alias("matches"), F.min(F.struct(*values)).alias("_row"))
    out = expectations.join(found, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    enough = F.col("matches") == 1 if unique else F.col("matches") >= 1
    passed = enough
    for v in values:
        passed = passed & _agrees(F.col(f"_row.{v}"), F.col(f"expected_{v}").cast("string"), tolerance)
    return out.withColumn("passed", passed).select(*keys, *[F.col(f"_row.{v}").alias(f"actual_{v}") for v in values], "matches", "passed")
