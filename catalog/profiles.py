"""Profiles, control groups, networks and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYS, query, rounded, sq, sqs
from tradeloom.operators import network, profile, sample, validate
from tradeloom.plans import star

T = "average_tariff_official"


def _named(spark, d, df, side):
    return profile.name_countries(df, star.countries(spark, d), side)


for _side, _name in (("reporter_country", "exports"), ("partner_country", "imports")):

    @query(f"country_profile_{_name}", f"""SELECT {_side}, n_name AS {_side}_name, 'N' || lpad(n_nationkey::varchar, 2, '0') AS {_side}_iso3, count(*) AS record_count, {sq('sum(value) * 1000', 'total_value', 0)}
        FROM flows JOIN nation ON {_side} = lpad(n_nationkey::varchar, 3, '0') GROUP BY ALL""")
    def _(spark, d, side=_side):
        return rounded(_named(spark, d, profile.country_profile(star.flows(spark, d), side), side), "total_value", digits=0)


@query("import_sources_of_target", f"SELECT reporter_country, count(*) AS record_count, {sq('sum(value) * 1000', 'total_value', 0)} FROM flows WHERE partner_country = '019' GROUP BY 1")
def _(spark, d):
    return rounded(profile.country_profile(star.flows(spark, d), "reporter_country", F.col("partner_country") == "019"), "total_value", digits=0)


@query("top_partners_by_records", f"SELECT partner_country, record_count, total_value FROM (SELECT partner_country, count(*) AS record_count, {sq('sum(value) * 1000', 'total_value', 0)} FROM flows WHERE reporter_country = '003' GROUP BY 1) ORDER BY record_count DESC, partner_country LIMIT 5")
def _(spark, d):
    partners = profile.country_profile(star.flows(spark, d), "partner_country", F.col("reporter_country") == "003")
    return rounded(sample.top(partners, "record_count", 5, "partner_country"), "total_value", digits=0)


@query("yearly_top_partners", f"""WITH best AS (SELECT partner_country FROM flows WHERE reporter_country = '003' GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 6)
    SELECT year, partner_country, {sq('sum(value)', 'yearly_volume', 2)} FROM flows WHERE reporter_country = '003' AND partner_country IN (FROM best) GROUP BY ALL""")
def _(spark, d):
    return rounded(profile.yearly_top_partners(star.flows(spark, d), "003", 6), "yearly_volume", digits=2)


@query("without_internal_trade", "SELECT year, reporter_country, partner_country, product_code, value FROM flows WHERE NOT (reporter_country IN ('000', '005', '010', '015', '020') AND partner_country IN ('000', '005', '010', '015', '020'))")
def _(spark, d):
    return profile.without_internal_trade(star.flows(spark, d), ["000", "005", "010", "015", "020"]).select(*KEYS, "value")


@query("importer_unit_values", f"SELECT product_code, year, {sq('sum(value) / sum(quantity)', 'unit_value')}, {sq(f'avg({T})', T)}, '019' AS country_code FROM enriched WHERE partner_country = '019' GROUP BY ALL")
def _(spark, d):
    return rounded(profile.importer_unit_values(star.enriched(spark, d), "019"), "unit_value", T)


@query("yearly_path_of_series", f"SELECT year, {sq('avg(average_tariff)', 'average_tariff')} FROM enriched WHERE reporter_country = '003' AND partner_country = '019' AND product_code LIKE '01%' GROUP BY 1")
def _(spark, d):
    where = (F.col("reporter_country") == "003") & (F.col("partner_country") == "019") & F.col("product_code").startswith("01")
    return rounded(profile.yearly_path(star.enriched(spark, d), where, "average_tariff"), "average_tariff")


_PRODUCTS = ["010101", "020510", "721020", "760630", "840945", "270912"]
_MEANS = [T, "unit_value", "unit_value_detrended", "price_global_trend"]


@query("product_profile", f"""SELECT year, product_code, quantity, {sqs('value', *_MEANS, 'weighted_tariff', 'weighted_unit_value', 'weighted_unit_value_detrended')} FROM (
    SELECT year, product_code, sum(quantity) AS quantity, sum(value) AS value, {', '.join(f'avg({c}) AS {c}' for c in _MEANS)}, sum({T} * value) / sum(value) AS weighted_tariff,
      sum(unit_value * value) / sum(value) AS weighted_unit_value, sum(unit_value_detrended * value) / sum(value) AS weighted_unit_value_detrended
    FROM enriched WHERE product_code IN ({', '.join(f"'{p}'" for p in _PRODUCTS)}) GROUP BY ALL)""")
def _(spark, d):
    out = profile.product_profile(star.enriched(spark, d), _PRODUCTS)
    return rounded(out, "value", *_MEANS, "weighted_tariff", "weighted_unit_value", "weighted_unit_value_detrended")


@query("top_pair_trends", f"""WITH picked AS (SELECT * FROM enriched WHERE product_code LIKE '0210%'),
    best AS (SELECT reporter_country, partner_country FROM picked GROUP BY ALL ORDER BY sum(value) DESC, 1, 2 LIMIT 15),
    trend AS (SELECT year, avg(price_global_trend) AS t FROM picked GROUP BY 1)
    SELECT year, reporter_country, partner_country, {sq('avg(unit_value)', 'unit_value')}, {sq('max(t)', 'price_global_trend')}
    FROM picked JOIN best USING (reporter_country, partner_country) JOIN trend USING (year) GROUP BY ALL""")
def _(spark, d):
    out = profile.top_pair_trends(star.enriched(spark, d), F.col("product_code").startswith("0210"), 15)
    return rounded(out, "unit_value", "price_global_trend")


# Control groups: products tariffed after 1999 against the others, around the base year 1997.
_CODES = {"USA": star.TARGET_IMPORTER, "China": star.TARGET_EXPORTER, "United Kingdom": "008"}
_ASIA = ["003", "004", "009", "011"]
_ABROAD = "Tariffed by US", "Non-Tariffed by US"
_PRESETS = {
    "world": ("true", "reporter_country", "019", "USA", "region", 2000, ("Tariffed", "Non-Tariffed")),
    "world_importer": ("true", "partner_country", "019", "USA", "region", 2000, ("Tariffed", "Non-Tariffed")),
    "china_to_us": ("reporter_country = '003'", "partner_country", "019", "USA", "destination", 2000, _ABROAD),
    "group_to_us": ("reporter_country IN ('003', '004', '009', '011')", "partner_country", "019", "USA", "destination", 2001, _ABROAD),
    "china_to_uk": ("reporter_country = '003'", "partner_country", "008", "UK", "destination", 2000, _ABROAD),
    "uk_from_china": ("partner_country = '008'", "reporter_country", "003", "China", "source", 2000, _ABROAD),
}
for _preset, (_where, _column, _code, _label, _side, _last, _status) in _PRESETS.items():

    @query(f"control_trends_{_preset}", f"""WITH treated AS (SELECT DISTINCT product_code FROM official WHERE effective_date > DATE '1999-01-01'),
      totals AS (SELECT CASE WHEN {_column} = '{_code}' THEN '{_label}' ELSE 'Rest of World' END AS {_side}, CASE WHEN product_code IN (FROM treated) THEN '{_status[0]}' ELSE '{_status[1]}' END AS tariff_status,
        year, sum(value) AS value, sum(quantity) AS quantity FROM flows WHERE {_where} AND year BETWEEN 1997 AND {_last} GROUP BY ALL)
      SELECT t.{_side}, t.tariff_status, t.year, {sq('t.value', 'value', 2)}, t.quantity, {sq('t.value / t.quantity', 'unit_value')}, {sq('t.value / b.value * 100', 'value_indexed')},
        {sq('t.quantity / b.quantity * 100', 'quantity_indexed')}, {sq('t.value / t.quantity / (b.value / b.quantity) * 100', 'unit_value_indexed')}
      FROM totals t LEFT JOIN totals b ON b.{_side} = t.{_side} AND b.tariff_status = t.tariff_status AND b.year = 1997""")
    def _(spark, d, preset=_preset):
        treated = star.official(spark, d).filter(F.year("effective_date") >= 1999).select("product_code")
        out = profile.control_preset(star.flows(spark, d), treated, preset, base_year=1997, codes=_CODES, group=_ASIA)
        return rounded(rounded(out, "value", digits=2), "unit_value", "value_indexed", "quantity_indexed", "unit_value_indexed")


_DESCRIBED = ["value", "quantity", "tariff_rate_pref"]


@query("describe", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count, {sq(f'avg({c})', 'mean')}, {sq(f'stddev_samp({c})', 'std')}, min({c}) AS min, max({c}) AS max,
    {', '.join(sq(f'quantile_cont({c}, {p / 100})', f'p{p}') for p in (25, 50, 75))} FROM panel""" for c in _DESCRIBED))
def _(spark, d):
    return rounded(profile.describe(star.stored_panel(spark, d), _DESCRIBED), "mean", "std", "p25", "p50", "p75")


@query("value_counts", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c}::varchar AS value, count(*) AS n FROM (SELECT *, left(product_code, 2) AS chapter FROM flows) GROUP BY ALL""" for c in ("chapter", "year", "reporter_country")))
def _(spark, d):
    f = star.flows(spark, d).withColumns({"chapter": F.substring("product_code", 1, 2), "constant": F.lit("x")})
    return profile.value_counts(f, ["chapter", "year", "reporter_country", "constant"])


@query("histogram", f"""WITH x AS (SELECT floor(value + 0.50001) AS v FROM flows), b AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 40 AS w, count(*) AS n FROM x),
    h AS (SELECT least(floor((v - lo) / w)::int, 39) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w, any_value(b.n) AS total FROM x, b GROUP BY 1)
    SELECT bin, {sq('lo + bin * w', 'low')}, {sq('lo + (bin + 1) * w', 'high')}, n, {sq('n / (total * w)', 'density', 9)} FROM h""")
def _(spark, d):
    whole = star.flows(spark, d).select(F.floor(F.col("value") + 0.50001).cast("double").alias("value"))
    return rounded(rounded(profile.histogram(whole, "value", 40, density=True), "low", "high"), "density", digits=9)


@query("rollup_levels", f"""WITH cut AS (SELECT *, left(product_code, 2) AS d2, left(product_code, 4) AS d4 FROM flows)
    SELECT year, reporter_country, partner_country, coalesce(d4, d2, 'total') AS product, {sq('sum(value)', 'value', 2)}, sum(quantity) AS quantity FROM cut
    GROUP BY GROUPING SETS ((year, reporter_country, partner_country, d2), (year, reporter_country, partner_country, d4), (year, reporter_country, partner_country))""")
def _(spark, d):
    return rounded(profile.rollup_levels(star.flows(spark, d), (2, 4)), "value", digits=2)


for _level, _product in (("2-digit", ", left(product_code, 2) AS product_code"), ("4-digit", ", left(product_code, 4) AS product_code"), ("6-digit", ", product_code"), ("total", "")):

    @query(f"network_edges_{_level.replace('-', '_')}", f"SELECT year, reporter_country, partner_country{_product}, {sq(f'sum({T} * value) / sum(value)', 'weighted_tariff')}, {sq('sum(value)', 'value', 2)}, sum(quantity) AS quantity FROM enriched GROUP BY ALL")
    def _(spark, d, level=_level):
        return rounded(rounded(network.edges(star.enriched(spark, d), level), "weighted_tariff"), "value", digits=2)


@query("network_nodes", "SELECT year, country, n_name AS label FROM (SELECT year, reporter_country AS country FROM flows UNION SELECT year, partner_country FROM flows) JOIN nation ON country = lpad(n_nationkey::varchar, 3, '0')")
def _(spark, d):
    return network.nodes(star.flows(spark, d), star.countries(spark, d))


@query("year_extremes", "SELECT min(year) AS min_year, max(year) AS max_year FROM flows")
def _(spark, d):
    return profile.extremes(star.flows(spark, d))


@query("last_rows", f"SELECT {', '.join(KEYS)}, value FROM flows ORDER BY {', '.join(k + ' DESC' for k in KEYS)} LIMIT 20")
def _(spark, d):
    return profile.last_rows(star.flows(spark, d), KEYS, 20).select(*KEYS, "value")


_MATCH = """matched AS (SELECT e.*, CASE WHEN e.product_code LIKE '01%' THEN 0.25 WHEN e.product_code LIKE '0205%' THEN 0.1 ELSE o.rate / 100 END AS official_tariff_rate,
    CASE WHEN e.product_code LIKE '01%' OR e.product_code LIKE '0205%' THEN 2018 ELSE e.year END AS official_year_applied
    FROM enriched e JOIN official o ON e.product_code = o.product_code AND e.year = o.year)"""


def _matched(spark, d):
    o = star.official(spark, d).withColumn("rate", F.col("rate") / 100)
    return validate.match_official(star.enriched(spark, d), o, [("01", 0.25), ("0205", 0.10)])


@query("match_official", f"WITH {_MATCH} SELECT {', '.join(KEYS)}, official_year_applied, {sq('official_tariff_rate * 100', 'official_tariff_rate_percentage')} FROM matched")
def _(spark, d):
    return rounded(_matched(spark, d).select(*KEYS, "official_year_applied", "official_tariff_rate_percentage"), "official_tariff_rate_percentage")


_CARRIED = f"""{_MATCH}, rates AS (SELECT product_code, year, max(official_tariff_rate * 100) AS pct FROM matched GROUP BY ALL),
    grid AS (SELECT product_code, year, coalesce(last_value(pct IGNORE NULLS) OVER (PARTITION BY product_code ORDER BY year), 0) AS pct FROM (SELECT DISTINCT product_code, year FROM flows) LEFT JOIN rates USING (product_code, year)),
    both_rates AS (SELECT e.year, e.{T}, e.value, pct FROM enriched e JOIN grid USING (product_code, year))"""


@query("yearly_discrepancy", f"WITH {_CARRIED} SELECT year, {sq(f'avg(abs(pct - {T}))', 'average_abs_discrepancy')} FROM both_rates GROUP BY year")
def _(spark, d):
    return rounded(validate.yearly_discrepancy(star.enriched(spark, d), _matched(spark, d)), "average_abs_discrepancy")


@query("trade_weighted_tariffs", f"""WITH {_CARRIED}, w AS (SELECT year, sum({T} * value) / sum(value) AS a, sum(({T} + pct) * value) / sum(value) AS b FROM both_rates GROUP BY year)
    SELECT year, 'trade_weighted_effective_tariff' AS tariff_type, {sq('a', 'weighted_tariff_rate')} FROM w UNION ALL SELECT year, 'trade_weighted_full_tariff', {sq('b', 'weighted_tariff_rate')} FROM w""")
def _(spark, d):
    return rounded(validate.trade_weighted_tariffs(star.enriched(spark, d), _matched(spark, d)), "weighted_tariff_rate")


_MISSING = f"count(*) AS n_rows, count(*) - count(average_tariff) AS n_null, {sq('(count(*) - count(average_tariff)) / count(*)', 'null_share', 6)} FROM panel"


@query("coverage_overall", f"SELECT {_MISSING}")
def _(spark, d):
    return rounded(validate.coverage(star.stored_panel(spark, d), "average_tariff"), "null_share", digits=6)


@query("coverage_by_year", f"SELECT year, {_MISSING} GROUP BY year")
def _(spark, d):
    return rounded(validate.coverage(star.stored_panel(spark, d), "average_tariff", ["year"]), "null_share", digits=6)


_SIDES = "a AS (SELECT DISTINCT product_code FROM mfn), b AS (SELECT DISTINCT product_code FROM pref)"


def _keys(spark, d):
    return star.mfn(spark, d), star.pref(spark, d)


@query("reconcile_keys", f"WITH {_SIDES} SELECT coalesce(a.product_code, b.product_code) AS product_code, (a.product_code IS NOT NULL)::int AS in_a, (b.product_code IS NOT NULL)::int AS in_b FROM a FULL JOIN b ON a.product_code = b.product_code")
def _(spark, d):
    return validate.reconcile(*_keys(spark, d), "product_code")


@query("reconciliation_counts", f"""WITH {_SIDES}, f AS (SELECT a.product_code AS x, b.product_code AS y FROM a FULL JOIN b ON a.product_code = b.product_code)
    SELECT count(x) AS n_a, count(y) AS n_b, count(*) AS n_union, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) FILTER (x IS NULL OR y IS NULL) AS n_one_sided FROM f""")
def _(spark, d):
    return validate.reconciliation_counts(*_keys(spark, d), "product_code")


# Expectations made from the lines' cells: right for one chapter, 3% off for the next, absent keys for the last.
@query("check_rows", f"""SELECT year + CASE WHEN product_code LIKE '84%' THEN 100 ELSE 0 END AS year, reporter_country, partner_country, product_code, CASE WHEN product_code NOT LIKE '84%' THEN value END AS actual_value,
    CASE WHEN product_code LIKE '84%' THEN 0 ELSE 1 END::bigint AS matches, product_code NOT LIKE '84%' AND product_code NOT LIKE '76%' AS passed FROM flows""")
def _(spark, d):
    p = star.stored_panel(spark, d)
    code = F.col("product_code")
    wrong = F.when(code.startswith("76"), F.col("value") * 1.03).when(code.startswith("72"), F.col("value") * 1.005).otherwise(F.col("value"))
    expected = p.select((F.col("year") + F.when(code.startswith("84"), 100).otherwise(0)).alias("year"), *KEYS[1:], wrong.cast("string").alias("expected_value"))
    return validate.check_rows(p, expected, KEYS, ["value"])
