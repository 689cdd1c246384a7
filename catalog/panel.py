"""Harmonisation, merging, trends and added tariffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYS, q, query, rounded, sq, sqs
from tradeloom import presets
from tradeloom.functions import windows
from tradeloom.operators import added, design, harmonise, merge, profile, trend
from tradeloom.plans import stages, star
from tradeloom.session import small_table

RATES = ["tariff_rate", "min_rate", "max_rate"]
PANEL_RATES = [f"{r}_{k}" for k in ("pref", "mfn") for r in RATES] + ["average_tariff"]
PANEL_SQL = "year, reporter_country, partner_country, product_code, value, quantity, " + sqs(*PANEL_RATES)


@query("weighted_tariff_by_year", f"SELECT year, {sq('sum(average_tariff * value) / sum(value)', 'weighted_tariff', 6)}, {sq('sum(value)', 'value', 2)} FROM panel GROUP BY year")
def _(spark, d):
    return rounded(rounded(profile.tariff_weighted_by_year(star.panel(spark, d)), "weighted_tariff", digits=6), "value", digits=2)


# Revisions and translations made from the panel's own products: H1 codes of one
# chapter have two translations each, H2 codes of another chapter have one.
def _revised(spark, d):
    size = F.substring("product_code", 5, 2).cast("int")
    revision = F.when(size % 5 == 0, "H0").when(size % 5 == 1, "H1").when(size % 5 == 2, "H2").when(size % 5 == 3, "H6")
    return star.flows(spark, d).withColumn("hs_revision", revision)


def _concordance(spark, d):
    codes = star.stored_cells(spark, d).select("product_code").distinct()
    tail, chapter = F.substring("product_code", 3, 4), F.substring("product_code", 1, 2)
    def row(revision, target):
        return F.struct(F.lit(revision).alias("hs_revision"), F.col("product_code").alias("source_code"), F.concat(F.lit(target), tail).alias("target_code"))
    rows = F.when(chapter == "01", F.array(row("H1", "02"), row("H1", "27"))).when(chapter == "02", F.array(row("H2", "01")))
    return codes.select(F.explode(rows).alias("r")).select("r.*")


_REVISED = """revised AS (
    SELECT *, CASE substr(product_code, 5, 2)::int % 5 WHEN 0 THEN 'H0' WHEN 1 THEN 'H1' WHEN 2 THEN 'H2' WHEN 3 THEN 'H6' END AS hs_revision FROM flows),
  concordance AS (
    SELECT DISTINCT r.hs_revision, product_code AS source_code, r.head || substr(product_code, 3, 4) AS target_code
    FROM cells JOIN (VALUES ('H1', '01', '02'), ('H1', '01', '27'), ('H2', '02', '01')) r(hs_revision, chapter, head) ON left(product_code, 2) = r.chapter),
  joined AS (
    SELECT v.*, c.target_code FROM revised v LEFT JOIN concordance c
    ON v.hs_revision = c.hs_revision AND v.product_code = c.source_code WHERE v.hs_revision IS NOT NULL)"""


@query("translate_products", f"WITH {_REVISED} SELECT year, reporter_country, partner_country, coalesce(target_code, product_code) AS product_code, value, quantity FROM joined")
def _(spark, d):
    return harmonise.translate_products(_revised(spark, d), _concordance(spark, d))


@query("translation_report", f"""WITH {_REVISED}
    SELECT a.*, b.* FROM (SELECT count(DISTINCT product_code) AS codes_before, count(*) FILTER (hs_revision = 'H0') AS base_rows,
      count(*) FILTER (hs_revision IS NULL) AS dropped_rows FROM revised) a,
    (SELECT count(*) FILTER (hs_revision <> 'H0' AND target_code IS NOT NULL) AS translated_rows,
      count(*) FILTER (hs_revision <> 'H0' AND target_code IS NULL) AS left_alone_rows,
      count(DISTINCT coalesce(target_code, product_code)) AS codes_after FROM joined) b""")
def _(spark, d):
    return harmonise.translation_report(_revised(spark, d), _concordance(spark, d))


# Country codes derived from nations: every fifth code is an area of two nations,
# the next known directly, the next by name, the next by short code, the rest by none.
def _mapping(spark, d):
    nations = star.countries(spark, d)
    code, number = F.col("country_code"), F.col("country_code").cast("int")
    overrides = nations.filter(number % 5 == 0).select(
        code.alias("original_code"), F.explode(F.array(code, F.lpad((number + 1).cast("string"), 3, "0"))).alias("iso_num"))
    labels = F.when(number % 5 == 1, code).when(number % 5 == 2, F.upper("country_name")).when(number % 5 == 3, F.lower("country_iso3"))
    standard = nations.filter(labels.isNotNull()).select(labels.alias("label"), F.concat(F.lit("9"), F.substring(code, 2, 2)).alias("iso_num"))
    codes = stages.distinct_codes(star.flows(spark, d), ["reporter_country", "partner_country"])
    return harmonise.country_map(codes, overrides, standard, [nations, nations])


_MAPPING = """mapping AS (
    SELECT original_code, unnest(CASE original_code::int % 5 WHEN 0 THEN [original_code, lpad((original_code::int + 1)::varchar, 3, '0')]
      WHEN 4 THEN [original_code] ELSE ['9' || substr(original_code, 2, 2)] END) AS iso_num
    FROM (SELECT reporter_country AS original_code FROM flows UNION SELECT partner_country FROM flows))"""


@query("country_code_map", f"WITH {_MAPPING} SELECT original_code, iso_num FROM mapping")
def _(spark, d):
    return _mapping(spark, d)


# Every name without its third letter, looked up by its nearest label.
@query("country_code_map_misspelt", r"""WITH named AS (SELECT lpad(n_nationkey::varchar, 3, '0') AS original_code, lower(n_name) AS label, lower(left(n_name, 2) || substr(n_name, 4)) AS name FROM nation),
    sized AS (SELECT original_code, name, least(2, (len(list_distinct(list_transform(range(1, len(name) + 2), lambda i: substr('  ' || name || ' ', i::int, 3)))) - 1) // 3) AS allowed FROM named),
    near AS (SELECT s.original_code, min({'d': levenshtein(s.name, l.label), 'l': l.label}) AS b FROM sized s JOIN named l ON levenshtein(s.name, l.label) <= allowed GROUP BY ALL)
    SELECT f.original_code, coalesce('9' || substr(l.original_code, 2), f.original_code) AS iso_num
    FROM (SELECT reporter_country AS original_code FROM flows UNION SELECT partner_country FROM flows) f LEFT JOIN near n USING (original_code) LEFT JOIN named l ON l.label = n.b.l""")
def _(spark, d):
    nations = star.countries(spark, d)
    misspelt = F.concat(F.substring("country_name", 1, 2), F.substring("country_name", 4, 100))
    standard = nations.select(F.upper("country_name").alias("label"), F.concat(F.lit("9"), F.substring("country_code", 2, 2)).alias("iso_num"))
    none = nations.select(F.col("country_code").alias("original_code"), F.lit("").alias("iso_num")).filter("original_code IS NULL")
    codes = stages.distinct_codes(star.flows(spark, d), ["reporter_country", "partner_country"])
    table = nations.withColumns({"country_name": misspelt, "country_iso3": F.lit("")})
    return harmonise.country_map(codes, none, standard, [table], inexact=2)


@query("remap_countries", f"""WITH {_MAPPING}
    SELECT year, a.iso_num AS reporter_country, b.iso_num AS partner_country, product_code, value, quantity
    FROM flows JOIN mapping a ON reporter_country = a.original_code JOIN mapping b ON partner_country = b.original_code""")
def _(spark, d):
    m = _mapping(spark, d)
    return harmonise.remap_countries(harmonise.remap_countries(star.flows(spark, d), m, "reporter_country"), m, "partner_country")


# Half of the preferential rows name the region of the importer instead of the importer.
def _grouped_pref(spark, d):
    group = star.membership(spark, d).withColumnsRenamed({"country_iso_num": "partner_country"})
    named = star.pref(spark, d).join(group, "partner_country")
    partner = F.when(F.substring("product_code", 6, 1).cast("int") % 2 == 0, F.col("pref_group_code")).otherwise(F.col("partner_country"))
    return named.withColumn("partner_country", partner).drop("pref_group_code")


_GROUPED = """members AS (
    SELECT '9' || n_regionkey || '0' AS pref_group_code, lpad(n_nationkey::varchar, 3, '0') AS country_iso_num FROM nation),
  grouped AS (
    SELECT reporter_country, CASE WHEN substr(product_code, 6, 1)::int % 2 = 0 THEN pref_group_code ELSE partner_country END AS partner_country,
           year, product_code, tariff_rate FROM pref JOIN members ON partner_country = country_iso_num)"""
_EXPANDED = "reporter_country, {p} AS partner_country, year, product_code, count(*) AS n_rows, min(tariff_rate) AS least, max(tariff_rate) AS most"


def _summed(df):
    return df.groupBy("reporter_country", "partner_country", "year", "product_code").agg(
        F.count("*").alias("n_rows"), F.min("tariff_rate").alias("least"), F.max("tariff_rate").alias("most"))


@query("expand_groups", f"WITH {_GROUPED} SELECT {_EXPANDED.format(p='country_iso_num')} FROM grouped JOIN members ON partner_country = pref_group_code GROUP BY ALL")
def _(spark, d):
    return _summed(harmonise.expand_groups(_grouped_pref(spark, d), star.membership(spark, d)))


@query("expand_groups_keep_individuals", f"WITH {_GROUPED} SELECT {_EXPANDED.format(p='coalesce(country_iso_num, partner_country)')} FROM grouped LEFT JOIN members ON partner_country = pref_group_code GROUP BY ALL")
def _(spark, d):
    return _summed(harmonise.expand_groups(_grouped_pref(spark, d), star.membership(spark, d), keep_individuals=True))


def _chapter_rates(rates):
    return rates.withColumn("product_code", F.substring("product_code", 1, 4))


@query("mean_rates", f"SELECT reporter_country, year, left(product_code, 4) AS product_code, 'AVEMFN' AS tariff_type, {', '.join(sq(f'avg({r})', r) for r in RATES)} FROM mfn GROUP BY ALL")
def _(spark, d):
    return rounded(harmonise.mean_rates(_chapter_rates(star.mfn(spark, d))), *RATES)


@query("least_rates", f"SELECT reporter_country, partner_country, year, left(product_code, 4) AS product_code, {', '.join(f'min({r}) AS {r}' for r in RATES)} FROM pref GROUP BY ALL")
def _(spark, d):
    return harmonise.least_rates(_chapter_rates(star.pref(spark, d)), ["reporter_country", "partner_country", "year", "product_code"])


@query("unified_panel", f"SELECT {PANEL_SQL} FROM panel")
def _(spark, d):
    return rounded(star.panel(spark, d), *PANEL_RATES)


_JOINED = """SELECT {cols} FROM flows f LEFT JOIN pref p ON f.reporter_country = p.{pe} AND f.partner_country = p.{pi}
    AND f.product_code = p.product_code AND f.year = p.year
    LEFT JOIN mfn m ON f.{mc} = m.reporter_country AND f.product_code = m.product_code AND f.year = m.year"""
_JOINED_COLS = "f.year, f.reporter_country, f.partner_country, f.product_code, f.value, " + ", ".join(
    [sq("p.tariff_rate", "tariff_rate_pref"), sq("m.tariff_rate", "tariff_rate_mfn"), sq("coalesce(p.tariff_rate, m.tariff_rate)", "average_tariff")])


def _slim(panel):
    return rounded(panel.select(*KEYS, "value", "tariff_rate_pref", "tariff_rate_mfn", "average_tariff"), "tariff_rate_pref", "tariff_rate_mfn", "average_tariff")


@query("unified_panel_pref_by_importer", _JOINED.format(cols=_JOINED_COLS, pe="partner_country", pi="reporter_country", mc="partner_country"))
def _(spark, d):
    return _slim(merge.build_panel(star.flows(spark, d), star.mfn(spark, d), star.pref(spark, d), pref_reporter_is="importer"))


@query("unified_panel_early_join", _JOINED.format(cols=_JOINED_COLS, pe="reporter_country", pi="partner_country", mc="reporter_country"))
def _(spark, d):
    return _slim(merge.build_panel(star.flows(spark, d), star.mfn(spark, d), star.pref(spark, d), mfn_reporter_is="exporter"))


_TREND = ["unit_value", "value_global_trend", "value_detrended", "quantity_global_trend", "quantity_detrended", "price_global_trend", "unit_value_detrended"]


@query("detrend", f"SELECT {', '.join(KEYS)}, {sqs(*_TREND)} FROM enriched")
def _(spark, d):
    return rounded(trend.detrend(trend.add_unit_value(star.stored_panel(spark, d))).select(*KEYS, *_TREND), *_TREND)


@query("global_trend", f"SELECT product_code, year, {sq('sum(value) / sum(quantity)', 'trend')} FROM flows GROUP BY ALL")
def _(spark, d):
    return rounded(trend.global_trend(star.flows(spark, d), "trend"), "trend")


@query("detrend_by_line", f"""WITH lines AS (SELECT product_code, regr_slope(unit_value, year) AS slope, regr_intercept(unit_value, year) AS intercept FROM enriched GROUP BY ALL)
    SELECT {', '.join('e.' + k for k in KEYS)}, {sq('slope * year + intercept', 'trend_line_value', 3)}, {sq('unit_value - (slope * year + intercept)', 'detrended_value', 3)}
    FROM enriched e JOIN lines l ON e.product_code = l.product_code""")
def _(spark, d):
    out = trend.detrend_by_line(star.enriched(spark, d), "unit_value")
    return rounded(out.select(*KEYS, "trend_line_value", "detrended_value"), "trend_line_value", "detrended_value", digits=3)


@query("trend_lines", f"SELECT product_code, {sq('regr_slope(value, year)', 'slope', 3)}, {sq('regr_intercept(value, year)', 'intercept', 1)} FROM chapters GROUP BY ALL")
def _(spark, d):
    lines = trend.trend_lines(star.enriched(spark, d).withColumn("product_code", F.substring("product_code", 1, 2)), "value")
    return lines.select("product_code", q("slope", 3).alias("slope"), q("intercept", 1).alias("intercept"))


@query("densify_official", "SELECT product_code, year, official_rate FROM dense")
def _(spark, d):
    last = star.flows(spark, d).agg(F.max("year")).first()[0]
    return added.densify(star.official(spark, d), last)


@query("overlay_official", f"SELECT {', '.join(KEYS)}, {sqs('official_tariff', 'average_tariff_official')} FROM enriched")
def _(spark, d):
    out = added.overlay_official(star.stored_panel(spark, d), star.official(spark, d), exporter=star.TARGET_EXPORTER, importer=star.TARGET_IMPORTER)
    return rounded(out.select(*KEYS, "official_tariff", "average_tariff_official"), "official_tariff", "average_tariff_official")


@query("overlay_official_dated_rules", f"""SELECT {', '.join('p.' + k for k in KEYS)}, {sq(f'''CASE WHEN p.partner_country <> '{star.TARGET_IMPORTER}' THEN 0.0
      WHEN p.product_code LIKE '72%' AND p.year >= 1999 AND p.reporter_country = '{star.TARGET_EXPORTER}' THEN 25.0
      WHEN p.product_code LIKE '76%' AND p.year >= 1999 AND p.reporter_country = '{star.TARGET_EXPORTER}' THEN 10.0 ELSE coalesce(d.official_rate, 0.0) END''', 'official_tariff')}
    FROM panel p LEFT JOIN dense d ON d.product_code = p.product_code AND d.year = p.year AND p.reporter_country = '{star.TARGET_EXPORTER}' AND p.partner_country = '{star.TARGET_IMPORTER}'""")
def _(spark, d):
    percent = [(p, r * 100) for p, r in presets.SECTOR_RATES]
    rules = added.sector_rules(percent, from_year=1999, exporters=[star.TARGET_EXPORTER])
    out = added.overlay_official(star.stored_panel(spark, d), star.official(spark, d), exporter=star.TARGET_EXPORTER, importer=star.TARGET_IMPORTER, rules=rules)
    return rounded(out.select(*KEYS, "official_tariff"), "official_tariff")


@query("prepare_added", f"""SELECT left(product_code, 4) AS product_code, (DATE '1970-01-01' + floor(avg(effective_date - DATE '1970-01-01'))::int) AS effective_date,
    {sq('avg(rate / 100) * 100', 'rate')}, 'HS6' AS hs_revision FROM official GROUP BY 1""")
def _(spark, d):
    lists = star.official(spark, d).select("effective_date", F.substring("product_code", 1, 4).alias("product_code"), (F.col("rate") / 100).alias("rate"))
    return rounded(added.prepare_added(lists), "rate")


# Headings by chapter and brand; the log names each heading once per official year.
def _codes(spark, d):
    c = star.official(spark, d).select("product_code").distinct()
    dotted = F.concat(F.substring("product_code", 1, 4), F.lit("."), F.substring("product_code", 5, 2), F.lit(".00"))
    return c.select(dotted.alias("hs_code"), F.concat(F.lit("9903."), F.substring("product_code", 1, 4)).alias("heading"))


def _log(spark, d):
    per = star.official(spark, d).groupBy(F.substring("product_code", 1, 4).alias("h"), "effective_date").agg(F.max("rate").alias("applied_rate"))
    late = per.filter(F.col("h") % 3 != 0)
    return late.select(F.concat(F.lit(" 9903."), "h").alias("hts_heading"), "effective_date", "applied_rate", F.year("effective_date").alias("seq"))


_LOG = """log AS (SELECT left(product_code, 4) AS h, max_by(effective_date, year) AS effective_date, max_by(rate, year) AS rate FROM (
      SELECT product_code, effective_date, year, max(rate) OVER (PARTITION BY left(product_code, 4), year) AS rate FROM official) WHERE left(product_code, 4)::int % 3 <> 0 GROUP BY 1),
  codes AS (SELECT DISTINCT product_code, left(product_code, 4) AS h FROM official)"""


@query("rates_by_heading", f"""WITH {_LOG} SELECT h2 || '.' || substr(product_code, 5, 2) || '.00' AS hs_code, rate, effective_date, '9903.' || h2 AS heading
    FROM (SELECT *, codes.h AS h2 FROM codes LEFT JOIN log ON codes.h = log.h)""")
def _(spark, d):
    return added.rates_by_heading(_codes(spark, d), _log(spark, d))


@query("six_digit_rates", f"WITH {_LOG} SELECT product_code, effective_date, rate, 'HS6' AS hs_revision FROM codes JOIN log ON codes.h = log.h")
def _(spark, d):
    return added.six_digit_rates(added.rates_by_heading(_codes(spark, d), _log(spark, d)))


@query("compare_tariff_sources", f"""WITH {_LOG}, a AS (SELECT product_code, date_trunc('month', effective_date)::date AS month, rate FROM official),
      b AS (SELECT product_code, date_trunc('month', effective_date)::date AS month, rate FROM codes JOIN log ON codes.h = log.h)
    SELECT coalesce(a.product_code, b.product_code) AS product_code, coalesce(a.month, b.month) AS month, coalesce(a.rate, b.rate) AS rate,
      CASE WHEN a.rate IS NOT NULL AND b.rate IS NOT NULL THEN 'both' WHEN a.rate IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS found_in
    FROM a FULL JOIN b ON a.product_code = b.product_code AND a.month = b.month AND a.rate = b.rate""")
def _(spark, d):
    """The list of added tariffs against the rates that the action log gives by heading."""
    by_heading = added.six_digit_rates(added.rates_by_heading(_codes(spark, d), _log(spark, d)))
    return added.compare_sources(star.official(spark, d), by_heading.select("product_code", "effective_date", "rate", "hs_revision"))


# The kept log of actions, its headings dealt to the products by chapter, joined with the flows.
_FIXED_LOG = "actions(seq, effective_date, rate, heading) AS (VALUES " + ", ".join(
    f"({i}, DATE '{day}', {'NULL' if rate is None else rate}::double, {'NULL' if h is None else repr(h)})"
    for i, (day, rate, h) in enumerate([*((a[0], a[5], next((h for t, d, r, h in presets.ACTION_HEADINGS if (t, d, r) == (a[2], a[0], a[5])), None)) for a in presets.TARIFF_ACTIONS), *((day, rate, h) for day, _, _, rate, h in presets.HEADING_ACTIONS)])
) + ")"
_DEALT = {"01": "9903.88.01", "02": "9903.88.02", "27": "9903.88.03", "72": "9903.88.15", "76": "9903.91.05", "84": "none"}


@query("action_log_rates", f"""WITH {_FIXED_LOG}, latest AS (SELECT heading, max_by(rate, (effective_date, seq)) AS rate, max_by(effective_date, (effective_date, seq)) AS effective_date FROM actions WHERE heading IS NOT NULL GROUP BY 1),
    products AS (SELECT DISTINCT product_code, CASE left(product_code, 2) {' '.join(f"WHEN '{c}' THEN '{h}'" for c, h in _DEALT.items())} END AS heading FROM flows)
    SELECT substr(product_code, 1, 4) || '.' || substr(product_code, 5, 2) || '.00' AS hs_code, l.rate, l.effective_date, p.heading FROM products p LEFT JOIN latest l ON p.heading = l.heading""")
def _(spark, d):
    c = star.flows(spark, d).select("product_code").distinct()
    dotted = F.concat(F.substring("product_code", 1, 4), F.lit("."), F.substring("product_code", 5, 2), F.lit(".00"))
    heading = F.create_map(*[F.lit(x) for pair in _DEALT.items() for x in pair])[F.substring("product_code", 1, 2)]
    return added.rates_by_heading(c.select(dotted.alias("hs_code"), heading.alias("heading")), presets.tariff_action_log(spark))


_LISTED = ", ".join(f"'{p}'" for p in presets.STEEL_AND_ALUMINIUM_PRODUCTS)


@query("flows_outside_product_list", f"SELECT product_code, count(*) AS n, {sq('sum(value)', 'value', 2)} FROM flows WHERE product_code NOT IN ({_LISTED}) GROUP BY 1")
def _(spark, d):
    listed = small_table(spark, [(p,) for p in presets.STEEL_AND_ALUMINIUM_PRODUCTS], "product_code string")
    left = star.flows(spark, d).join(listed, "product_code", "left_anti")
    return rounded(left.groupBy("product_code").agg(F.count("*").alias("n"), F.sum("value").alias("value")), "value", digits=2)


@query("keep_first_duplicate", """SELECT product_code, first(effective_date ORDER BY year) AS effective_date, first(rate ORDER BY year) AS rate FROM official GROUP BY 1""")
def _(spark, d):
    return added.keep_first(star.official(spark, d).select("product_code", "effective_date", "rate"), ["product_code"], ["effective_date"])


# Fills and interpolation on pairs and chapters, with rates missing in some cells.
_SERIES = """series AS (SELECT reporter_country, partner_country, product_code, year,
    max(CASE WHEN (year + reporter_country::int) % 3 <> 0 THEN tariff_rate_pref END) AS rate FROM panel GROUP BY ALL)"""
_GROUP = "PARTITION BY reporter_country, partner_country, product_code ORDER BY year"


def _series(spark, d):
    gaps = F.when((F.col("year") + F.col("reporter_country").cast("int")) % 3 != 0, F.col("tariff_rate_pref"))
    p = star.stored_panel(spark, d).withColumn("product_code", F.substring("product_code", 1, 2))
    return p.groupBy(*KEYS).agg(F.max(gaps).alias("rate"))


_SERIES = _SERIES.replace("product_code, year,", "left(product_code, 2) AS product_code, year,", 1)


@query("fill_forward", f"WITH {_SERIES} SELECT reporter_country, partner_country, product_code, year, last_value(rate IGNORE NULLS) OVER ({_GROUP}) AS rate FROM series")
def _(spark, d):
    return windows.fill_forward(_series(spark, d), KEYS[1:], "year", "rate", unique=True)


@query("fill_both_ways", f"""WITH {_SERIES} SELECT reporter_country, partner_country, product_code, year, coalesce(last_value(rate IGNORE NULLS) OVER ({_GROUP}),
    first_value(rate IGNORE NULLS) OVER ({_GROUP} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM series""")
def _(spark, d):
    return windows.fill_both_ways(_series(spark, d), KEYS[1:], "year", "rate")


@query("interpolate", f"""WITH {_SERIES}, placed AS (SELECT *, row_number() OVER ({_GROUP}) AS pos FROM series),
    ends AS (SELECT *, last_value(rate IGNORE NULLS) OVER ({_GROUP}) AS v0, last_value(CASE WHEN rate IS NOT NULL THEN pos END IGNORE NULLS) OVER ({_GROUP}) AS p0,
      first_value(rate IGNORE NULLS) OVER ({_GROUP} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
      first_value(CASE WHEN rate IS NOT NULL THEN pos END IGNORE NULLS) OVER ({_GROUP} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM placed)
    SELECT reporter_country, partner_country, product_code, year,
      {sq('CASE WHEN rate IS NOT NULL THEN rate WHEN v0 IS NULL OR v1 IS NULL THEN 0.0 ELSE v0 + (v1 - v0) / (p1 - p0) * (pos - p0) END', 'rate')} FROM ends""")
def _(spark, d):
    return rounded(windows.interpolate(_series(spark, d), KEYS[1:], "year", "rate"), "rate")


@query("rebase", f"""WITH yearly AS (SELECT year, sum(value) AS value, sum(quantity) AS quantity FROM flows GROUP BY year)
    SELECT y.year, {sq('y.value / b.value * 100', 'value_rebased')}, {sq('y.quantity / b.quantity * 100', 'quantity_rebased')} FROM yearly y, yearly b WHERE b.year = 1996""")
def _(spark, d):
    yearly = star.flows(spark, d).groupBy("year").agg(F.sum("value").alias("value"), F.sum("quantity").alias("quantity"))
    out = windows.rebase(yearly, F.col("year") == 1996, ["value", "quantity"])
    return rounded(out.select("year", "value_rebased", "quantity_rebased"), "value_rebased", "quantity_rebased")


@query("index_to_base_year", f"""WITH yearly AS (SELECT reporter_country, year, sum(value) AS value FROM flows GROUP BY ALL)
    SELECT y.reporter_country, y.year, {sq('y.value / b.value * 100', 'value_indexed')} FROM yearly y
    LEFT JOIN yearly b ON b.reporter_country = y.reporter_country AND b.year = 1997""")
def _(spark, d):
    yearly = star.flows(spark, d).groupBy("reporter_country", "year").agg(F.sum("value").alias("value"))
    return rounded(windows.index_to_base(yearly, ["reporter_country"], F.col("year") == 1997, ["value"]).drop("value"), "value_indexed")


_TREATED = f"""SELECT e.*, t.tariff_us_china FROM enriched e LEFT JOIN (SELECT year, product_code, avg(average_tariff_official) AS tariff_us_china FROM enriched
    WHERE reporter_country = '{star.TARGET_EXPORTER}' AND partner_country = '{star.TARGET_IMPORTER}' GROUP BY ALL) t ON e.year = t.year AND e.product_code = t.product_code"""


@query("treatment_rate", f"SELECT {', '.join(KEYS)}, {sq('tariff_us_china', 'tariff_us_china')} FROM ({_TREATED})")
def _(spark, d):
    out = design.treatment_rate(star.enriched(spark, d), star.TARGET_EXPORTER, star.TARGET_IMPORTER)
    return rounded(out.select(*KEYS, "tariff_us_china"), "tariff_us_china")


@query("treatment_rate_conditional", f"SELECT {', '.join(KEYS)}, {sq('tariff_us_china', 'rate')} FROM ({_TREATED})")
def _(spark, d):
    pair = (F.col("reporter_country") == star.TARGET_EXPORTER) & (F.col("partner_country") == star.TARGET_IMPORTER)
    out = windows.broadcast_where(star.enriched(spark, d), ["year", "product_code"], pair, F.col("average_tariff_official"), "rate")
    return rounded(out.select(*KEYS, "rate"), "rate")
