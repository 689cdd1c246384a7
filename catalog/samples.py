"""Trimming, country selection and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYS, q, query, rounded, sq
from tradeloom import presets
from tradeloom.operators import harmonise, sample
from tradeloom.plans import star
from tradeloom.session import small_table
from tradeloom.sources.dimensions import code_table

_COLS = ", ".join(KEYS)
_ROW = f"{_COLS}, value"


def _row(df):
    return df.select(*KEYS, "value")


@query("percentile_bounds", f"""SELECT unnest(['value', 'unit_value']) AS "column", unnest([{', '.join(sq(f'quantile_cont({c}, 0.01)', 'x').split(' AS ')[0] for c in ('value', 'unit_value'))}]) AS low,
    unnest([{', '.join(sq(f'quantile_cont({c}, 0.99)', 'x').split(' AS ')[0] for c in ('value', 'unit_value'))}]) AS high FROM enriched""")
def _(spark, d):
    return rounded(sample.percentile_bounds(star.enriched(spark, d), ["value", "unit_value"]), "low", "high")


_NEAREST = "min(CASE WHEN pos = floor((n - 1) * {p} + 0.5) THEN value END)"


@query("percentile_bounds_nearest", f"""WITH placed AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS pos, count(*) OVER () AS n FROM flows)
    SELECT 'value' AS "column", {_NEAREST.format(p=0.01)} AS low, {_NEAREST.format(p=0.99)} AS high FROM placed""")
def _(spark, d):
    return sample.percentile_bounds(star.flows(spark, d), ["value"], nearest=True)


@query("trim_outliers", f"""WITH fine AS (SELECT {_ROW}, {sq('unit_value', 'unit_value')} FROM enriched),
    b AS (SELECT quantile_cont(value, 0.01) AS v0, quantile_cont(value, 0.99) AS v1, quantile_cont(unit_value, 0.01) AS u0, quantile_cont(unit_value, 0.99) AS u1 FROM fine)
    SELECT {_ROW}, unit_value FROM fine, b WHERE value BETWEEN v0 AND v1 AND unit_value BETWEEN u0 AND u1""")
def _(spark, d):
    fine = star.enriched(spark, d).select(*KEYS, "value", q("unit_value").alias("unit_value"))
    return sample.trim_outliers(fine, ["value", "unit_value"])


_TOTALS = """totals AS (SELECT country, sum(value) AS v FROM (SELECT reporter_country AS country, value FROM {t} UNION ALL SELECT partner_country, value FROM {t}) GROUP BY 1)"""


@query("country_totals", f"WITH {_TOTALS.format(t='flows')} SELECT country, {sq('v', 'total_trade', 2)} FROM totals")
def _(spark, d):
    return rounded(sample.country_totals(star.flows(spark, d)), "total_trade", digits=2)


@query("top_country_filter", f"""WITH {_TOTALS.format(t='flows')}, best AS (SELECT country FROM totals ORDER BY v DESC, country LIMIT 10)
    SELECT {_ROW} FROM flows WHERE value >= 10000 AND reporter_country IN (FROM best) AND partner_country IN (FROM best)""")
def _(spark, d):
    return _row(sample.top_country_filter(star.flows(spark, d), 10000, 10))


_SHARES = "shares AS (SELECT reporter_country, sum(CASE WHEN product_code LIKE '27%' THEN value ELSE 0 END) / sum(value) * 100 AS share FROM {t} GROUP BY 1)"


@query("resource_exporters", f"WITH {_SHARES.format(t='flows')} SELECT reporter_country, {sq('share', 'share', 6)} FROM shares WHERE share > {star.RESOURCE_THRESHOLD}")
def _(spark, d):
    return rounded(sample.resource_exporters(star.flows(spark, d), star.RESOURCE_THRESHOLD), "share", digits=6)


_CLEAN = f"""kept AS (SELECT * FROM flows WHERE NOT starts_with(product_code, '7213') AND NOT starts_with(product_code, '76')),
    {_SHARES.format(t='kept')}, clean AS (SELECT * FROM kept WHERE reporter_country NOT IN (SELECT reporter_country FROM shares WHERE share > 22.0))"""
_AMONG = f"SELECT {_ROW} FROM clean WHERE reporter_country IN (FROM chosen) AND partner_country IN (FROM chosen) AND year BETWEEN 1996 AND 2000"
_OPTIONS = dict(years=list(range(1996, 2001)), resource_threshold=22.0, exclude_prefixes=["7213", "76"])


@query("select_sample_total_trade", f"""WITH {_CLEAN}, that AS (SELECT * FROM clean WHERE year = 1997), {_TOTALS.format(t='that')},
    chosen AS (SELECT country FROM (SELECT country FROM totals ORDER BY v DESC, country LIMIT 12) WHERE country NOT IN ('001', '007')) {_AMONG}""")
def _(spark, d):
    return _row(sample.select_sample(star.flows(spark, d), top_n=12, selection_year=1997, exclude=["001", "007"], **_OPTIONS))


@query("select_sample_importers", f"""WITH {_CLEAN}, chosen AS (SELECT partner_country FROM clean WHERE year = 1997 GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 12) {_AMONG}""")
def _(spark, d):
    return _row(sample.select_sample(star.flows(spark, d), top_n=12, selection_year=1997, method="importers", **_OPTIONS))


@query("select_sample_listed", f"WITH {_CLEAN}, chosen(c) AS (VALUES ('003'), ('019'), ('010'), ('011')) {_AMONG}")
def _(spark, d):
    return _row(sample.select_sample(star.flows(spark, d), include=["003", "019", "010", "011"], **_OPTIONS))


# The nations stand for the first countries of the preset list, so that its groups can be used.
_ISO = [(f"{i:03d}", iso) for i, iso in enumerate(presets.COUNTRIES.values()) if i < 25]
_LISTED = ", ".join(f"('{c}')" for c in presets.country_group("wider"))


@query("select_sample_country_group", f"""WITH iso(code, iso_num) AS (VALUES {', '.join(map(str, _ISO))}),
    renamed AS (SELECT f.* REPLACE (coalesce(a.iso_num, reporter_country) AS reporter_country, coalesce(b.iso_num, partner_country) AS partner_country) FROM flows f
      LEFT JOIN iso a ON reporter_country = a.code LEFT JOIN iso b ON partner_country = b.code),
    {_CLEAN.replace('FROM flows', 'FROM renamed')}, chosen(c) AS (VALUES {_LISTED}) {_AMONG}""")
def _(spark, d):
    iso, renamed = small_table(spark, _ISO, "original_code string, iso_num string"), star.flows(spark, d)
    for side in ("reporter_country", "partner_country"):
        renamed = harmonise.remap_countries(renamed, iso, side)
    return _row(sample.select_sample(renamed, include=presets.country_group("wider"), **_OPTIONS))


@query("exclude_product_table", f"SELECT {_ROW} FROM flows WHERE left(product_code, 4) NOT IN (SELECT DISTINCT left(product_code, 4) FROM flows WHERE product_code LIKE '72%' AND year = 2001)")
def _(spark, d):
    f = star.flows(spark, d)
    listed = f.filter(F.col("product_code").startswith("72") & (F.col("year") == 2001)).select(F.substring("product_code", 1, 4).alias("prefix")).distinct()
    return _row(sample.exclude_products(f, listed))


@query("exclude_country_table", f"SELECT {_ROW} FROM flows WHERE reporter_country NOT IN ('003', '010') AND partner_country IN ('019', '020', '021')")
def _(spark, d):
    out = code_table(spark, ["003", "010"], "reporter_country")
    keep = code_table(spark, ["019", "020", "021"], "partner_country")
    return _row(star.flows(spark, d).join(out, "reporter_country", "left_anti").join(keep, "partner_country", "left_semi"))


@query("all_other_exporters", "SELECT DISTINCT reporter_country AS country FROM flows WHERE reporter_country NOT IN ('003', '019', '010')")
def _(spark, d):
    return sample.all_other_exporters(star.flows(spark, d), ["003", "019", "010"])


_KEY = "'42|' || year || '|' || reporter_country || '|' || partner_country || '|' || product_code"


@query("sample_exact", f"SELECT {_ROW} FROM flows ORDER BY md5({_KEY}), {_COLS} LIMIT 5000")
def _(spark, d):
    return _row(sample.sample_exact(star.flows(spark, d), 5000, KEYS))


@query("every_nth_row", f"SELECT {_ROW} FROM (SELECT *, row_number() OVER (ORDER BY {_COLS}) - 1 AS i FROM flows) WHERE i % 25 = 0")
def _(spark, d):
    return _row(sample.every_nth(star.flows(spark, d), 25, KEYS))
