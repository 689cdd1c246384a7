"""Readers and writers, as round trips over tables derived from the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYS, query, rounded, sq
from tradeloom import presets
from tradeloom.functions import columns as C
from tradeloom.plans import stages, star
from tradeloom.session import fresh_path
from tradeloom.sources import added, dimensions, flows, panel, sinks, tariffs

_ROW = "year, reporter_country, partner_country, product_code, value, quantity"


# Country codes lose their zeros, one chapter has no quantity, and amounts are padded.
@query("flow_csv_scan", f"""SELECT year, reporter_country, partner_country, product_code, value, CASE WHEN product_code NOT LIKE '84%' THEN quantity END AS quantity FROM flows""")
def _(spark, d):
    f = star.flows(spark, d)
    amount = F.when(~F.col("product_code").startswith("84"), F.concat(F.lit("  "), F.col("quantity").cast("string"))).otherwise("NA")
    raw = f.select(
        F.col("year").alias("t"), F.col("reporter_country").cast("int").alias("i"), F.col("partner_country").cast("int").alias("j"),
        F.col("product_code").alias("k"), F.format_string("%.2f", "value").alias("v"), amount.alias("q"))
    path = sinks.write_csv(raw, fresh_path(spark, "flows-csv"))
    return flows.name_columns(flows.pad_countries(flows.scan_flows(spark, f"{path}/*.csv")))


def _raw_tariffs(spark, rates, kind):
    """Schedules as published: text rates, some ``NA``, one folder per year."""
    country = F.when(F.col("year") % 2 == 0, F.col("tariff_rate").cast("string")).otherwise(F.concat(F.lit(" "), F.col("tariff_rate").cast("string")))
    partner = [F.col("partner_country").alias("Partner")] if kind == "AVEPref" else []
    counts = [F.lit(1).alias(c) for c in ("Nbr_NA_Lines", "Nbr_Free_Lines", "Nbr_AVE_Lines", "Nbr_Dutiable_Lines", "TotalNoOfValidLines", "TotalNoOfLines")]
    raw = rates.select(
        F.lit("H0").alias("NomenCode"), F.col("reporter_country").alias("Reporter_ISO_N"), F.col("year").alias("Year"), F.col("product_code").alias("ProductCode"), *partner,
        F.lit("0").alias("Sum_Of_Rates"), F.when(F.col("min_rate") == 0, "NA").otherwise(F.col("min_rate").cast("string")).alias("Min_Rate"),
        F.when(F.col("max_rate") == 8, "n/a").otherwise(F.col("max_rate").cast("string")).alias("Max_Rate"), country.alias("SimpleAverage"), *counts, F.lit("").alias("EstCode"),
        F.format_string(kind + "_H0_ALL_%d_U2", "year").alias("folder"))
    path = fresh_path(spark, kind)
    raw.hint("rebalance", "folder").write.option("header", True).partitionBy("folder").csv(path)
    return tariffs.scan_tariffs(spark, kind, path, "*/*.csv")


_RATES_SQL = f"{sq('tariff_rate', 'tariff_rate')}, CASE WHEN min_rate <> 0 THEN min_rate END AS min_rate, CASE WHEN max_rate <> 8 THEN max_rate END AS max_rate"


@query("mfn_csv_scan", f"SELECT year, reporter_country, product_code, 'H0' AS hs_revision, {_RATES_SQL}, 'AVEMFN' AS tariff_type FROM mfn")
def _(spark, d):
    return rounded(tariffs.tidy_tariffs(_raw_tariffs(spark, star.mfn(spark, d), "AVEMFN"), "AVEMFN"), "tariff_rate")


@query("pref_csv_scan", f"SELECT year, reporter_country, partner_country, product_code, 'H0' AS hs_revision, {_RATES_SQL}, 'AVEPref' AS tariff_type FROM pref")
def _(spark, d):
    return rounded(tariffs.tidy_tariffs(_raw_tariffs(spark, star.pref(spark, d), "AVEPref"), "AVEPref"), "tariff_rate")


@query("tariff_folder_names", "SELECT 'H0' AS folder_revision, 'ALL' AS folder_country, year AS folder_year, count(*) AS n FROM mfn GROUP BY year")
def _(spark, d):
    return _raw_tariffs(spark, star.mfn(spark, d), "AVEMFN").groupBy("folder_revision", "folder_country", "folder_year").agg(F.count("*").alias("n"))


@query("unparsed_tariff_rates", """SELECT 0::bigint AS "SimpleAverage", 0::bigint AS "Min_Rate", count(*) FILTER (max_rate = 8) AS "Max_Rate" FROM mfn""")
def _(spark, d):
    return tariffs.unparsed_rates(_raw_tariffs(spark, star.mfn(spark, d), "AVEMFN"))


# A year that is no number, rates without one, and lines with a field too many.
@query("rejected_tariff_fields", """SELECT year AS folder_year, reason, "column", text, count(*) AS n FROM (
      SELECT year, 'type' AS reason, 'Year' AS "column", '19x' AS text FROM mfn WHERE product_code LIKE '%1' AND tariff_rate < 4 AND max_rate <> 8
      UNION ALL SELECT year, 'rate', 'Max_Rate', 'n/a' FROM mfn WHERE max_rate = 8
      UNION ALL SELECT year, 'fields', NULL, NULL FROM mfn WHERE product_code LIKE '%2' AND tariff_rate < 4 AND max_rate <> 8) GROUP BY ALL""")
def _(spark, d):
    rates = star.mfn(spark, d)
    odd = (F.col("tariff_rate") < 4) & (F.col("max_rate") != 8)
    text = [F.lit("H0"), "reporter_country", F.when(odd & F.col("product_code").endswith("1"), "19x").otherwise(F.col("year").cast("string")), "product_code", F.lit("0"), F.col("min_rate").cast("string"),
            F.when(F.col("max_rate") == 8, "n/a").otherwise(F.col("max_rate").cast("string")), F.col("tariff_rate").cast("string"), *[F.lit("1")] * 6, F.lit("x")]
    more = F.when(odd & F.col("product_code").endswith("2"), F.array(F.lit("beyond"))).otherwise(F.array().cast("array<string>"))
    folder = F.format_string("AVEMFN_H0_ALL_%d_U2", "year").alias("folder")
    lines = rates.select(F.concat_ws(",", F.concat(F.array(*text), more)).alias("value"), folder, F.lit(1).alias("place"))
    header = ",".join(f.name for f in tariffs.tariff_schema("AVEMFN"))
    files = lines.unionByName(rates.select(F.lit(header).alias("value"), folder, F.lit(0).alias("place")).distinct())
    path = fresh_path(spark, "broken")
    files.repartition("folder").sortWithinPartitions("folder", "place").select("value", "folder").write.partitionBy("folder").text(path)
    found = tariffs.rejected_fields(spark, "AVEMFN", path, "*/*.txt")
    return found.groupBy("folder_year", "reason", "column", F.when(F.col("reason") != "fields", F.col("text")).alias("text")).agg(F.count("*").alias("n"))


# The translation of each revision is one latin-1 file with an ignored middle column.
@query("concordance_csv_scan", """SELECT DISTINCT hs_revision, product_code AS source_code, chapter || substr(product_code, 3, 4) AS target_code
    FROM cells, (VALUES ('H1', '27'), ('H2', '84')) r(hs_revision, chapter)""")
def _(spark, d):
    codes = star.stored_cells(spark, d).select("product_code").distinct()
    folder = fresh_path(spark, "concordance")
    for revision, chapter in (("H1", "27"), ("H2", "84")):
        table = codes.select(F.col("product_code").alias("source"), F.lit("café").alias("label"), F.concat(F.lit(chapter), F.substring("product_code", 3, 4)).alias("target"))
        table.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{folder}/{revision}_to_H0.CSV")
    return dimensions.scan_concordance(spark, folder, ("H1", "H2"))


@query("country_csv_scan", "SELECT lpad(n_nationkey::varchar, 3, '0') AS country_code, n_name AS country_name, 'N' || lpad(n_nationkey::varchar, 2, '0') AS country_iso3 FROM nation")
def _(spark, d):
    raw = star.countries(spark, d).select(F.col("country_name").alias("Country Name"), F.col("country_iso3").alias("ISO3"), F.col("country_code").cast("int").alias("Numeric Code"))
    return dimensions.scan_countries(spark, sinks.write_csv(raw, fresh_path(spark, "countries")), "Numeric Code", "Country Name", "ISO3")


@query("membership_csv_scan", """SELECT '9' || n_regionkey || '0' AS pref_group_code, string_agg(lpad(n_nationkey::varchar, 3, '0'), ',' ORDER BY n_nationkey) AS members, count(DISTINCT n_nationkey) AS n_distinct FROM nation GROUP BY n_regionkey""")
def _(spark, d):
    raw = star.membership(spark, d).select("pref_group_code", F.lit("région").alias("label"), F.col("country_iso_num").cast("int").alias("country"))
    path = fresh_path(spark, "members")
    raw.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    lists = dimensions.member_lists(dimensions.scan_membership(spark, path))
    return lists.select("pref_group_code", F.array_join("members", ",").alias("members"), F.size("distinct_members").cast("bigint").alias("n_distinct"))


@query("panel_partition_scan", f"SELECT {_ROW} FROM panel WHERE year = 1998")
def _(spark, d):
    path = sinks.write_by_year(star.stored_panel(spark, d), fresh_path(spark, "by-year"))
    return panel.scan_panel(spark, path).filter(F.col("year") == 1998).select(*_ROW.split(", "))


@query("panel_recursive_scan", f"SELECT product_code, count(*) AS n, {sq('sum(value)', 'value', 2)} FROM panel GROUP BY 1")
def _(spark, d):
    path = sinks.write_by_year(star.stored_panel(spark, d), fresh_path(spark, "by-year"))
    out = panel.scan_recursive(spark, path).groupBy("product_code").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rounded(out, "value", digits=2)


@query("sql_over_parquet", "SELECT p_type, count(*) AS n, min(p_size) AS least FROM part GROUP BY 1")
def _(spark, d):
    return panel.sql_over_parquet(spark, "SELECT p_type, count(*) AS n, min(p_size) AS least FROM {table} GROUP BY p_type", f"{d}/part.parquet")


@query("dated_csv_scan", "SELECT product_code, effective_date, rate FROM official")
def _(spark, d):
    path = sinks.write_csv(star.official(spark, d).select("product_code", "effective_date", "rate"), fresh_path(spark, "dated"))
    return added.scan_dated(spark, path, {"product_code": "string", "effective_date": "date", "rate": "double"})


@query("added_tariff_csv_scan", f"SELECT effective_date, product_code, {sq('rate / 100', 'rate')} FROM official")
def _(spark, d):
    o = star.official(spark, d)
    raw = o.select(F.date_format("effective_date", "yyyy'm'M").alias("time"), F.concat("product_code", F.lit("00")).alias("hs_code"), (F.col("rate") / 100).alias("tariff_add"))
    parts = [sinks.write_csv(raw.filter(F.pmod(F.xxhash64("hs_code"), F.lit(4)) == i), fresh_path(spark, f"part{i}")) for i in range(4)]
    return rounded(added.scan_added(spark, parts), "rate")


@query("wide_csv_scan", "SELECT count(*) AS n_rows, 13 AS n_columns, count(average_tariff) AS n_rates FROM panel")
def _(spark, d):
    p = star.stored_panel(spark, d)
    wide = dimensions.scan_text(spark, sinks.write_csv(p, fresh_path(spark, "wide")))
    return wide.agg(F.count("*").alias("n_rows"), F.lit(len(wide.columns)).alias("n_columns"), F.count("average_tariff").alias("n_rates"))


_LOG_SQL = "log AS (SELECT left(product_code, 2) AS chapter, year, max(rate) AS applied_rate FROM official GROUP BY ALL)"


@query("action_log_headings", f"""WITH {_LOG_SQL} SELECT chapter AS tariff_target, make_date(year, 7, 1) AS effective_date, applied_rate,
    CASE WHEN chapter = '01' AND year = 1998 THEN '9903.01' WHEN year = 2000 THEN '9903.20' END AS hts_heading FROM log""")
def _(spark, d):
    log = star.official(spark, d).groupBy(F.substring("product_code", 1, 2).alias("tariff_target"), "effective_date").agg(F.max("rate").alias("applied_rate"))
    year = F.year("effective_date")
    rules = [((F.col("tariff_target") == "01") & (year == 1998), "9903.01"), (year == 2000, "9903.20")]
    return added.set_where(log.withColumn("hts_heading", F.lit(None).cast("string")), "hts_heading", rules)


@query("flatten_exclusions", "SELECT DISTINCT product_code AS hts_code, make_date(year, 7, 1) AS date_of_exclusion_start, '9903.' || year AS chapter_99_code, 'notice ' || year AS source_document_url FROM official")
def _(spark, d):
    o = star.official(spark, d).select("product_code", F.year("effective_date").alias("y"), "effective_date").distinct()
    detail = F.struct(F.col("effective_date").cast("string").alias("date_of_exclusion_start"), F.concat(F.lit("9903."), "y").alias("chapter_99_code"), F.concat(F.lit("notice "), "y").alias("source_document_url"))
    nested = o.groupBy("product_code").agg(F.collect_list(detail).alias("d")).select(F.create_map("product_code", "d").alias("exclusions"))
    return added.flatten_exclusions(nested)


@query("parquet_zstd_round_trip", f"SELECT {_ROW} FROM flows")
def _(spark, d):
    return spark.read.parquet(sinks.write_parquet(star.flows(spark, d), fresh_path(spark, "zstd"), "zstd")).select(*_ROW.split(", "))


# Written whole, then the two latest years are replaced by doubled values.
@query("replace_years", f"SELECT year, reporter_country, partner_country, product_code, CASE WHEN year >= 2000 THEN 2 * value ELSE value END AS value, quantity FROM flows")
def _(spark, d):
    f = star.flows(spark, d)
    path = sinks.write_by_year(f, fresh_path(spark, "replaced"))
    sinks.write_by_year(f.filter(F.col("year") >= 2000).withColumn("value", 2 * F.col("value")), path, only_years_present=True)
    return panel.scan_panel(spark, path).select(*_ROW.split(", "))


@query("next_version", f"SELECT {', '.join(KEYS)}, {sq('unit_value', 'unit_value')} FROM enriched")
def _(spark, d):
    path = sinks.write_by_year(star.stored_panel(spark, d), fresh_path(spark, "versioned"))
    p = panel.scan_panel(spark, path)
    out = sinks.write_next_version(p.withColumn("unit_value", C.ratio("value", "quantity")), path, "enriched")
    return rounded(panel.scan_panel(spark, out).select(*KEYS, "unit_value"), "unit_value")


@query("csv_round_trip", "SELECT product_code, effective_date, rate, hs_revision FROM (SELECT *, 'HS6' AS hs_revision FROM official)")
def _(spark, d):
    path = sinks.write_csv(star.official(spark, d), fresh_path(spark, "official-csv"))
    return added.scan_dated(spark, path, {"product_code": "string", "effective_date": "date", "rate": "double", "hs_revision": "string"})


@query("scalar_functions", f"""SELECT {', '.join(KEYS)}, lpad(reporter_country::int::varchar, 3, '0') AS padded, {sq('ln(value)', 'log_value', 6)}, {sq('asinh(quantity)', 'arcsinh_quantity', 6)},
    {sq('value / nullif(quantity - 10, 0)', 'safe_ratio')}, {sq('abs(quantity - 20)', 'distance')}, coalesce(tariff_rate_pref, -1.0) AS filled,
    product_code LIKE '72%' OR product_code LIKE '760%' AS metal, tariff_rate_pref IS NOT NULL AS known,
    partner_country || '^' || product_code || '^' || year AS importer_product_year, try_cast(trim(' ' || quantity || ' ') AS double) AS from_text, value * 1000 AS units FROM panel""")
def _(spark, d):
    p = star.stored_panel(spark, d)
    out = p.select(
        *KEYS, C.zfill(F.col("reporter_country").cast("int").cast("string"), 3).alias("padded"),
        C.log_or_null("value").alias("log_value"), C.arcsinh("quantity").alias("arcsinh_quantity"), C.ratio("value", F.col("quantity") - 10).alias("safe_ratio"),
        F.abs(F.col("quantity") - 20).alias("distance"), C.fill_missing("tariff_rate_pref", -1).alias("filled"), C.prefix_in("product_code", ["72", "760"]).alias("metal"),
        C.is_number("tariff_rate_pref").alias("known"), F.concat_ws("^", "partner_country", "product_code", "year").alias("importer_product_year"),
        C.rate_from_text(F.concat(F.lit(" "), F.col("quantity").cast("string"), F.lit(" "))).alias("from_text"), (F.col("value") * 1000).alias("units"))
    return rounded(rounded(out, "log_value", "arcsinh_quantity", digits=6), "safe_ratio", "distance")


@query("null_and_nan_filters", f"""SELECT count(*) FILTER (tariff_rate_mfn IS NOT NULL AND tariff_rate_pref IS NOT NULL) AS both_known,
    count(*) FILTER (tariff_rate_pref IS NULL OR quantity <> 5) AS not_nan, count(*) FILTER (tariff_rate_pref IS NOT NULL AND quantity <> 5) AS finite, count(*) FILTER (year BETWEEN 1996 AND 1999) AS between_years FROM panel""")
def _(spark, d):
    p = star.stored_panel(spark, d)
    nan = p.withColumn("x", F.when(F.col("tariff_rate_pref").isNotNull() & (F.col("quantity") == 5), F.lit(float("nan"))).otherwise(F.col("tariff_rate_pref")))
    both = C.drop_null(p, ["tariff_rate_mfn", "tariff_rate_pref"]).agg(F.count("*").alias("both_known"))
    not_nan = C.drop_nan(nan, ["x"]).agg(F.count("*").alias("not_nan"))
    return nan.agg(F.count_if(C.is_number("x")).alias("finite"), F.count_if(F.col("year").between(1996, 1999)).alias("between_years")).select(
        both.scalar().alias("both_known"), not_nan.scalar().alias("not_nan"), "finite", "between_years")


@query("distinct_codes", "SELECT reporter_country AS original_code FROM flows UNION SELECT partner_country FROM flows")
def _(spark, d):
    return stages.distinct_codes(star.flows(spark, d), ["reporter_country", "partner_country"])


# The whole way from raw files. Two countries hide behind area codes, codes lose their zeros, every second product is
# published in a later revision under another code, some lines say NA, and partners are named by their group.
_AREAS = {"907": "007", "908": "008"}
_ENRICHED = ["value", "quantity", "tariff_rate_pref", "min_rate_pref", "max_rate_pref", "tariff_rate_mfn", "min_rate_mfn", "max_rate_mfn", "average_tariff",
             "unit_value", "value_global_trend", "value_detrended", "quantity_detrended", "unit_value_detrended", "official_tariff", "average_tariff_official"]


def _published(column):
    return F.replace(F.replace(F.col(column), F.lit("007"), F.lit("907")), F.lit("008"), F.lit("908"))


def _later_code():
    """A product's code in the later revision: another chapter, the same digits after it."""
    chapters = F.create_map(*[F.lit(x) for i, c in enumerate(star.CHAPTERS.values(), 91) for x in (c, str(i))])
    return F.concat(chapters[F.substring("product_code", 1, 2)], F.substring("product_code", 3, 4))


def _publish_tariffs(rates, kind, path):
    later = F.substring("product_code", 6, 1).cast("int") % 2 == 1
    revision = F.when(later, "H1").otherwise("H0")
    code = F.when(later, _later_code()).otherwise(F.col("product_code"))
    partner = [F.concat(F.lit("G"), "partner_country").alias("Partner")] if kind == "AVEPref" else []
    counts = [F.lit(1).alias(c) for c in ("Nbr_NA_Lines", "Nbr_Free_Lines", "Nbr_AVE_Lines", "Nbr_Dutiable_Lines", "TotalNoOfValidLines", "TotalNoOfLines")]
    # Every line of one year comes twice, once without rates.
    blank = F.explode(F.when(F.col("year") == 1999, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    said = {c: F.when(F.col("blank"), "NA").otherwise(F.col(c).cast("string")) for c in ("tariff_rate", "min_rate", "max_rate")}
    raw = rates.withColumn("blank", blank).select(
        revision.alias("NomenCode"), _published("reporter_country").alias("Reporter_ISO_N"), F.col("year").alias("Year"), code.alias("ProductCode"), *partner,
        F.lit("0").alias("Sum_Of_Rates"), said["min_rate"].alias("Min_Rate"), said["max_rate"].alias("Max_Rate"), said["tariff_rate"].alias("SimpleAverage"), *counts, F.lit("").alias("EstCode"),
        F.format_string(kind + "_%s_ALL_%d_U2", revision, "year").alias("folder"))
    raw.hint("rebalance", "folder").write.option("header", True).partitionBy("folder").csv(f"{path}/{kind}")


@query("raw_files_to_enriched_panel", f"SELECT {', '.join(KEYS)}, {', '.join(sq(c, c) for c in _ENRICHED)} FROM enriched")
def _(spark, d):
    path = fresh_path(spark, "raw")
    flat = star.flows(spark, d).select(
        F.col("year").alias("t"), _published("reporter_country").cast("int").alias("i"), _published("partner_country").cast("int").alias("j"),
        F.col("product_code").alias("k"), F.format_string("  %.2f", "value").alias("v"), F.col("quantity").cast("string").alias("q"))
    sinks.write_csv(flat, f"{path}/flows")
    _publish_tariffs(star.mfn(spark, d), "AVEMFN", f"{path}/tariffs")
    _publish_tariffs(star.pref(spark, d), "AVEPref", f"{path}/tariffs")
    codes = star.stored_cells(spark, d).select("product_code").distinct()
    concordance = codes.select(F.lit("H1").alias("hs_revision"), _later_code().alias("source_code"), F.col("product_code").alias("target_code"))
    members = star.countries(spark, d).select(F.concat(F.lit("G"), "country_code").alias("pref_group_code"), F.col("country_code").alias("country_iso_num"))
    areas = presets.area_code_table(spark, {area: [iso] for area, iso in _AREAS.items()})
    out = stages.run(
        spark, f"{path}/flows/*.csv", f"{path}/tariffs", concordance, members, areas, areas, star.official(spark, d), f"{path}/out", "*/*.csv",
        exporter=star.TARGET_EXPORTER, importer=star.TARGET_IMPORTER)
    return rounded(panel.scan_panel(spark, out).select(*KEYS, *_ENRICHED), *_ENRICHED)
