"""Outlier trimming, country selection and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import presets
from tradeloom import schema as S
from tradeloom.functions.columns import prefix_in, ratio
from tradeloom.functions.ranks import positions, quantiles
from tradeloom.session import materialise, small_table


def percentile_bounds(df: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.99, nearest: bool = False) -> DataFrame:
    """Exact lower and upper percentile of each column, as rows ``column, low, high``.

    All columns go through the same passes as (column, value) pairs.
    """
    if not (0 <= lower < upper < 1):
        raise ValueError(f"percentiles must satisfy 0 <= lower < upper < 1, got {lower} and {upper}")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p"))
    return quantiles(pairs.select("p.column", "p.x"), ["column"], "x", {"low": lower, "high": upper}, nearest)


def trim_outliers(df: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.99, nearest: bool = False) -> DataFrame:
    """Keep rows inside the percentile bounds of every column.

    Bounds come from the untrimmed input. They are two numbers per column, so
    they are fetched and become literals that the scan can use. NULLs fail the
    comparison and go; a column without any value is not trimmed on.
    """
    bounds = percentile_bounds(df, columns, lower, upper, nearest).collect()
    keep = [F.col(b["column"]).between(b["low"], b["high"]) for b in bounds]
    return df.filter(reduce(lambda a, b: a & b, keep)) if keep else df


def country_totals(df: DataFrame, name: str = "total_trade") -> DataFrame:
    """Exports plus imports per country, both sides counted in one scan."""
    sides = df.select(F.explode(F.array(S.EXPORTER, S.IMPORTER)).alias("country"), S.VALUE)
    return sides.filter(F.col("country").isNotNull() & F.col(S.VALUE).isNotNull()).groupBy("country").agg(F.sum(S.VALUE).alias(name))


def top(df: DataFrame, by: str, n: int, *tie_break: str) -> DataFrame:
    """The ``n`` rows with the largest ``by``; ties go by the named columns."""
    return df.orderBy(F.col(by).desc(), *tie_break).limit(n)


def between_countries(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Rows whose exporter and importer are both in ``countries.country``."""
    for side in (S.EXPORTER, S.IMPORTER):
        df = df.join(countries.select(F.col("country").alias(side)), side, "left_semi")
    return df


def top_country_filter(df: DataFrame, min_value: float, n: int) -> DataFrame:
    """Flows of at least ``min_value`` between the ``n`` countries that trade most."""
    countries = materialise(top(country_totals(df), "total_trade", n, "country").select("country"), "countries")
    return between_countries(df.filter(F.col(S.VALUE) >= min_value), countries).select(df.columns)


def resource_exporters(df: DataFrame, threshold: float, chapter: str = presets.RESOURCE_CHAPTER) -> DataFrame:
    """Exporters whose share of one product chapter exceeds ``threshold`` percent of their exports."""
    if not 0 <= threshold <= 100:
        raise ValueError("the threshold is a percentage between 0 and 100")
    resource = F.when(F.col(S.PRODUCT).startswith(chapter), F.col(S.VALUE))
    shares = df.groupBy(S.EXPORTER).agg((ratio(F.coalesce(F.sum(resource), F.lit(0.0)), F.sum(S.VALUE)) * 100).alias("share"))
    return shares.filter(F.col("share") > threshold)


def exclude_products(df: DataFrame, prefixes) -> DataFrame:
    """Drop products that start with any of the prefixes.

    Prefixes are a short list, which becomes a pushed filter, or a DataFrame
    with a ``prefix`` column of one length, which becomes an anti join.
    """
    if isinstance(prefixes, DataFrame):
        width = prefixes.select(F.max(F.length("prefix")))
        cut = F.substring(F.col(S.PRODUCT), F.lit(1), width.scalar())
        return df.withColumn("prefix", cut).join(prefixes.select("prefix"), "prefix", "left_anti").select(df.columns)
    return df.filter(~prefix_in(S.PRODUCT, prefixes))


def select_sample(
    df: DataFrame,
    top_n: int | None = None,
    selection_year: int | None = None,
    years: list[int] | None = None,
    method: str = "total_trade",
    resource_threshold: float | None = 50.0,
    exclude: list[str] | None = None,
    include: list[str] | None = None,
    exclude_prefixes=None,
    resource_chapter: str = presets.RESOURCE_CHAPTER,
) -> DataFrame:
    """Analysis sample: products and resource exporters removed, then trade among chosen countries.

    Countries are ``include``, or the ``top_n`` of ``selection_year`` by imports
    (``method="importers"``) or by exports plus imports (``"total_trade"``),
    less ``exclude``.
    """
    if include and (top_n or selection_year):
        raise ValueError("give either include or top_n with selection_year")
    if not include and not (top_n and selection_year):
        raise ValueError("include, or both top_n and selection_year, are needed")
    if method not in ("importers", "total_trade"):
        raise ValueError("method is 'importers' or 'total_trade'")
    columns = df.columns
    if exclude_prefixes is not None:
        df = exclude_products(df, exclude_prefixes)
    if resource_threshold is not None:
        heavy = materialise(resource_exporters(df, resource_threshold, resource_chapter).select(S.EXPORTER), "resource")
        df = df.join(heavy, S.EXPORTER, "left_anti")
    if include:
        countries = small_table(df.sparkSession, [(c,) for c in include], "country string")
    else:
        that_year = df.filter(F.col(S.YEAR) == selection_year)
        if method == "importers":
            totals = that_year.groupBy(F.col(S.IMPORTER).alias("country")).agg(F.sum(S.VALUE).alias("total_trade"))
        else:
            totals = country_totals(that_year)
        countries = materialise(top(totals, "total_trade", top_n, "country").select("country"), "countries")
    if exclude:
        countries = countries.filter(~F.col("country").isin(list(exclude)))
    if years:
        df = df.filter(F.col(S.YEAR).isin(list(years)))
    return between_countries(df, countries).select(columns)


def all_other_exporters(df: DataFrame, fixed: list[str]) -> DataFrame:
    """Every exporter in the data that is not in ``fixed``."""
    return df.select(F.col(S.EXPORTER).alias("country")).distinct().filter(~F.col("country").isin(list(fixed)))


def sample_exact(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), chosen by a hash of the key and the seed.

    The same rows are chosen on every run and cluster. Hash values are evenly
    spread, so rows below a cut a little above ``n`` of the total are enough to
    hold the ``n`` least; if they are not, all rows are ranked.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in key])
    hashed = df.withColumn("_h", F.md5(text))
    total = df.count()
    if total <= n:
        return df
    span = 16**12
    cut = min(1.0, (n + 8 * n**0.5 + 64) / total)
    near = hashed.filter(F.col("_h") < format(int(cut * span), "012x")) if cut < 1 else hashed
    near = materialise(near, "candidates")
    if near.count() < n:
        near = hashed
    return positions(near, ["_h", *key], "_i").filter(F.col("_i") < n).drop("_h", "_i")


def every_nth(df: DataFrame, step: int, key: list[str]) -> DataFrame:
    """Rows 0, step, 2*step, ... in the order of ``key``, which must identify rows.

    Only keys are put in order; the rows come by a semi-join, in which NULL keys are equal.
    """
    named = [f"_k{i}" for i in range(len(key))]
    keys = df.select(*[F.col(k).alias(n) for k, n in zip(key, named)])
    chosen = materialise(positions(keys, named, "_i").filter(F.col("_i") % step == 0).select(*named), "every-nth")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, named)])
    return df.join(chosen, same, "left_semi")
