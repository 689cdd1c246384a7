"""Query registry, shared rounding, and the derived tables as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.plans import star

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the derived tables below."""
    def add(f: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (f, None if sql is None else with_tables(sql))
        return f

    return add


# Both engines add doubles in their own order. Results are rounded alike, with
# ties moved off the half so that the last bit of a sum cannot decide.
def q(x: Column | str, digits: int = 4) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.50001)) / F.lit(10.0**digits)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: q(c, digits) for c in columns})


def sq(expression: str, name: str, digits: int = 4) -> str:
    return f"floor(({expression}) * 1e{digits} + 0.50001) / 1e{digits} AS {name}"


def sqs(*names: str, digits: int = 4) -> str:
    return ", ".join(sq(n, n, digits) for n in names)


# Two-sided probabilities by Simpson's rule.
_WEIGHT = "CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"


def student_p(t: str, df: str) -> str:
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"
    point = f"(least(abs({t}), 40) * k / 400)"
    return f"CASE WHEN {t} IS NOT NULL THEN 1 - 2 * {scale} * least(abs({t}), 40) / 1200 * list_sum(list_transform(range(0, 401), lambda k: {_WEIGHT} * pow(1 + {point} * {point} / {df}, -({df} + 1) / 2.0))) END"


def normal_p(z: str) -> str:
    point = f"(least(abs({z}), 40) * k / 400)"
    return f"CASE WHEN {z} IS NOT NULL THEN 1 - 2 / sqrt(2 * pi()) * least(abs({z}), 40) / 1200 * list_sum(list_transform(range(0, 401), lambda k: {_WEIGHT} * exp(-{point} * {point} / 2))) END"


_CHAPTER = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in star.CHAPTERS.items()) + " END"
_OFFICIAL_CHAPTERS = ", ".join(f"'{c}'" for c in star.OFFICIAL_CHAPTERS)
_OFFICIAL_YEARS = ", ".join(str(y) for y in star.OFFICIAL_YEARS)
FIRST_OFFICIAL = min(star.OFFICIAL_YEARS)

TABLES = {
    "cells": rf"""
        SELECT lpad(s_nationkey::varchar, 3, '0') AS reporter_country, lpad(c_nationkey::varchar, 3, '0') AS partner_country,
               {_CHAPTER} || lpad(regexp_extract(p_brand, '(\d+)', 1), 2, '0') || lpad(p_size::varchar, 2, '0') AS product_code,
               year(o_orderdate)::int AS year,
               sum(round(l_extendedprice * 100)::bigint)::bigint AS cents, sum(l_quantity::bigint)::bigint AS units, count(*) AS n_lines,
               sum(round(l_tax * 100)::bigint)::bigint AS tax_sum, min(round(l_tax * 100)::bigint) AS tax_min, max(round(l_tax * 100)::bigint) AS tax_max,
               min(CASE WHEN round(l_discount * 100) >= 8 THEN round(l_discount * 100)::bigint END) AS cut_min,
               max(CASE WHEN round(l_discount * 100) >= 8 THEN round(l_discount * 100)::bigint END) AS cut_max
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
        GROUP BY ALL""",
    "flows": """
        SELECT year, reporter_country, partner_country, product_code, cents::double / 100.0 AS value, units::double AS quantity FROM cells""",
    "mfn_rates": """
        SELECT partner_country, left(product_code, 2) AS chapter, year, sum(tax_sum)::double / sum(n_lines) AS tariff_rate,
               min(tax_min)::double AS min_rate, max(tax_max)::double AS max_rate FROM cells GROUP BY ALL""",
    "mfn": f"""
        SELECT DISTINCT c.partner_country AS reporter_country, c.year, c.product_code, tariff_rate, min_rate, max_rate
        FROM cells c JOIN mfn_rates r ON c.partner_country = r.partner_country AND left(c.product_code, 2) = r.chapter AND c.year = r.year
        WHERE left(c.product_code, 2) <> '{star.NO_MFN_CHAPTER}'""",
    "pref_rates": """
        SELECT reporter_country, partner_country, left(product_code, 2) AS chapter, year, min(cut_min)::double AS tariff_rate,
               min(cut_min)::double AS min_rate, max(cut_max)::double AS max_rate FROM cells GROUP BY ALL HAVING min(cut_min) IS NOT NULL""",
    "pref": """
        SELECT DISTINCT c.reporter_country, c.partner_country, c.year, c.product_code, tariff_rate, min_rate, max_rate
        FROM cells c JOIN pref_rates r ON c.reporter_country = r.reporter_country AND c.partner_country = r.partner_country
             AND left(c.product_code, 2) = r.chapter AND c.year = r.year""",
    "official": f"""
        SELECT product_code, make_date(year, 7, 1) AS effective_date, year, (max(tax_max) * 2 + 1)::double AS rate
        FROM cells WHERE left(product_code, 2) IN ({_OFFICIAL_CHAPTERS}) AND year IN ({_OFFICIAL_YEARS}) GROUP BY ALL""",
    "panel": """
        SELECT f.*, p.tariff_rate AS tariff_rate_pref, p.min_rate AS min_rate_pref, p.max_rate AS max_rate_pref,
               m.tariff_rate AS tariff_rate_mfn, m.min_rate AS min_rate_mfn, m.max_rate AS max_rate_mfn,
               coalesce(p.tariff_rate, m.tariff_rate) AS average_tariff
        FROM flows f
        LEFT JOIN pref p ON f.reporter_country = p.reporter_country AND f.partner_country = p.partner_country
             AND f.product_code = p.product_code AND f.year = p.year
        LEFT JOIN mfn m ON f.partner_country = m.reporter_country AND f.product_code = m.product_code AND f.year = m.year""",
    "years": "SELECT DISTINCT year FROM flows",
    "dense": f"""
        SELECT product_code, year, official_rate FROM (
            SELECT s.product_code, s.year, last_value(o.rate IGNORE NULLS) OVER (PARTITION BY s.product_code ORDER BY s.year) AS official_rate
            FROM (SELECT DISTINCT product_code, y.year FROM official, (SELECT unnest(range({FIRST_OFFICIAL}, (SELECT max(year) FROM flows) + 1))::int AS year) y) s
            LEFT JOIN official o ON o.product_code = s.product_code AND o.year = s.year)
        WHERE official_rate IS NOT NULL""",
    "enriched": f"""
        SELECT p.*, value / quantity AS unit_value, t.trend AS value_global_trend, value - t.trend AS value_detrended,
               t.trend AS quantity_global_trend, quantity - t.trend AS quantity_detrended, t.trend AS price_global_trend,
               value / quantity - t.trend AS unit_value_detrended,
               CASE WHEN p.partner_country <> '{star.TARGET_IMPORTER}' THEN 0.0 WHEN p.product_code LIKE '72%' THEN 0.25
                    WHEN p.product_code LIKE '76%' THEN 0.1 ELSE coalesce(d.official_rate, 0.0) END::double AS official_tariff,
               average_tariff + CASE WHEN p.partner_country <> '{star.TARGET_IMPORTER}' THEN 0.0 WHEN p.product_code LIKE '72%' THEN 0.25
                    WHEN p.product_code LIKE '76%' THEN 0.1 ELSE coalesce(d.official_rate, 0.0) END::double AS average_tariff_official
        FROM panel p JOIN (SELECT product_code, year, sum(value) / sum(quantity) AS trend FROM panel GROUP BY ALL) t
             ON p.product_code = t.product_code AND p.year = t.year
        LEFT JOIN dense d ON d.product_code = p.product_code AND d.year = p.year
             AND p.reporter_country = '{star.TARGET_EXPORTER}' AND p.partner_country = '{star.TARGET_IMPORTER}'""",
    # The panel with products cut to chapters: several rows per group and year. Tariffs are whole
    # ten-thousandths, so their means are exact and "no change" is the same in both engines.
    "chapters": """SELECT * REPLACE (left(product_code, 2) AS product_code, floor(average_tariff_official * 1e4 + 0.50001) AS average_tariff_official) FROM enriched""",
}


def with_tables(sql: str) -> str:
    """Prefix the derived tables that ``sql`` uses, in order."""
    needed, todo = set(), [sql]
    while todo:
        words = set(_words(todo.pop()))
        for name in words & (TABLES.keys() - needed):
            needed.add(name)
            todo.append(TABLES[name])
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({TABLES[n]})" for n in TABLES if n in needed)
    text = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(start):
            return f"{start}{ctes},\n{text[len(start):]}"
    return f"WITH {ctes}\n{text}"


def _words(text: str) -> list[str]:
    return "".join(ch if ch.isalnum() or ch == "_" else " " for ch in text).split()


KEYS = ["year", "reporter_country", "partner_country", "product_code"]


def chapters(spark: SparkSession, d: str) -> DataFrame:
    """Enriched panel with products cut to chapters and tariffs in whole ten-thousandths."""
    whole = F.floor(F.col("average_tariff_official") * 1e4 + 0.50001).cast("double")
    return star.enriched(spark, d).withColumns({"product_code": F.substring("product_code", 1, 2), "average_tariff_official": whole})
