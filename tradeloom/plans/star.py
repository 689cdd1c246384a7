"""A trade panel derived from an order schema (orders, lines, parts, suppliers, customers).

The supplier's nation exports, the customer's nation imports, the order year is
the year and the part gives a six-digit product: chapter from its type, then
brand and size. Taxes give the general rate, high discounts the preferential
rate. All amounts are added as whole cents, so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom import schema as S
from tradeloom.functions.columns import zfill
from tradeloom.functions.joins import attach_summary
from tradeloom.operators import merge
from tradeloom.plans.stages import enrich
from tradeloom.session import fresh_path, widen_shuffles
from tradeloom.sources.sinks import write_by_year

# Product chapter of each part type.
CHAPTERS = {"ECONOMY": "01", "SMALL": "02", "PROMO": "27", "STANDARD": "72", "LARGE": "76", "MEDIUM": "84"}
TARGET_EXPORTER, TARGET_IMPORTER = "003", "019"
RESOURCE_THRESHOLD = 17.0
OFFICIAL_CHAPTERS, OFFICIAL_YEARS = ("01", "02"), (1998, 2000)
NO_MFN_CHAPTER = "84"

INPUTS = ("lineitem", "orders", "customer", "supplier", "part")

_written: dict[tuple, str] = {}


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents, quantity and rate sums per exporter, importer, product and year."""
    def read(name, *columns):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)

    lines = read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    orders = read("orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias(S.YEAR))
    buyers = read("customer", F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias(S.IMPORTER))
    sellers = read("supplier", F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias(S.EXPORTER))
    chapter = F.create_map(*[F.lit(x) for pair in CHAPTERS.items() for x in pair])[F.col("p_type")]
    brand = F.regexp_extract("p_brand", r"(\d+)", 1)
    code = F.concat(chapter, F.lpad(brand, 2, "0"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    parts = read("part", F.col("p_partkey").alias("l_partkey"), code.alias(S.PRODUCT))
    # Orders meet their buyers before the lines do, so that lines are shuffled once less; nations stay numbers until the lines are added up.
    facts = lines.join(orders.join(buyers, "o_custkey"), "l_orderkey").join(sellers, "l_suppkey").join(parts, "l_partkey")
    tax, cut = _cents("l_tax"), _cents("l_discount")
    code = {c: zfill(F.col(c).cast("string"), 3) for c in (S.EXPORTER, S.IMPORTER)}
    return facts.groupBy(S.EXPORTER, S.IMPORTER, S.PRODUCT, S.YEAR).agg(
        F.sum(_cents("l_extendedprice")).alias("cents"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
        F.count("*").alias("n_lines"),
        F.sum(tax).alias("tax_sum"),
        F.min(tax).alias("tax_min"),
        F.max(tax).alias("tax_max"),
        F.min(F.when(cut >= 8, cut)).alias("cut_min"),
        F.max(F.when(cut >= 8, cut)).alias("cut_max"),
    ).withColumns(code)


def _stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """Written once per application and input folder, partitioned by year, and read back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    widen_shuffles(spark, [f"{sf_dir}/{table}.parquet" for table in INPUTS])
    if key not in _written:
        _written[key] = write_by_year(make(), fresh_path(spark, name))
    return spark.read.parquet(_written[key])


def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "cells", lambda: cells(spark, sf_dir))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_cells(spark, sf_dir).select(
        S.YEAR, S.EXPORTER, S.IMPORTER, S.PRODUCT, (F.col("cents") / F.lit(100.0)).alias(S.VALUE), F.col("units").cast("double").alias(S.QUANTITY)
    )


def _chapter():
    return F.substring(S.PRODUCT, 1, 2)


def mfn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General rates per importing country, year and product: the mean tax of the chapter, in percent."""
    c = stored_cells(spark, sf_dir).withColumn("chapter", _chapter())
    keys = [S.IMPORTER, "chapter", S.YEAR]
    rates = c.groupBy(*keys).agg(
        (F.sum("tax_sum").cast("double") / F.sum("n_lines")).alias("tariff_rate"),
        F.min("tax_min").cast("double").alias("min_rate"),
        F.max("tax_max").cast("double").alias("max_rate"),
    )
    products = c.filter(F.col("chapter") != NO_MFN_CHAPTER).select(*keys, S.PRODUCT).distinct()
    out = attach_summary(products, rates, keys, "inner", "mfn_rates").withColumn("tariff_type", F.lit("AVEMFN"))
    return out.select(F.col(S.IMPORTER).alias(S.EXPORTER), S.YEAR, S.PRODUCT, *S.RATES, "tariff_type")


def pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferential rates per country pair, year and product: the least high discount of the chapter."""
    c = stored_cells(spark, sf_dir).withColumn("chapter", _chapter())
    keys = [S.EXPORTER, S.IMPORTER, "chapter", S.YEAR]
    rates = c.groupBy(*keys).agg(
        F.min("cut_min").cast("double").alias("tariff_rate"),
        F.min("cut_min").cast("double").alias("min_rate"),
        F.max("cut_max").cast("double").alias("max_rate"),
    ).filter(F.col("tariff_rate").isNotNull())
    products = c.select(*keys, S.PRODUCT)  # one cell per product already
    out = attach_summary(products, rates, keys, "inner", "pref_rates").withColumn("tariff_type", F.lit("AVEPref"))  # so that cells are not shuffled to meet a few rates
    return out.select(S.EXPORTER, S.IMPORTER, S.YEAR, S.PRODUCT, *S.RATES, "tariff_type")


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tariffs on two chapters in two years, from the highest tax on the product that year."""
    c = stored_cells(spark, sf_dir).filter(_chapter().isin(list(OFFICIAL_CHAPTERS)) & F.col(S.YEAR).isin(list(OFFICIAL_YEARS)))
    return c.groupBy(S.PRODUCT, S.YEAR).agg((F.max("tax_max") * 2 + 1).cast("double").alias("rate")).select(
        S.PRODUCT, F.make_date(S.YEAR, F.lit(7), F.lit(1)).alias("effective_date"), "rate", F.lit("HS6").alias("hs_revision")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified panel, not stored."""
    return merge.build_panel(flows(spark, sf_dir), mfn(spark, sf_dir), pref(spark, sf_dir))


def stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "panel", lambda: panel(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with unit values, trends and official tariffs, stored by year."""
    return _stored(
        spark, sf_dir, "enriched",
        lambda: enrich(stored_panel(spark, sf_dir), official(spark, sf_dir), exporter=TARGET_EXPORTER, importer=TARGET_IMPORTER),
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country table from the nations: three-digit code, name and a short code."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    code = zfill(F.col("n_nationkey").cast("string"), 3)
    return n.select(code.alias("country_code"), F.col("n_name").alias("country_name"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("country_iso3"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region codes ``9<region>0`` with their nations as members."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.format_string("9%d0", F.col("n_regionkey")).alias("pref_group_code"), zfill(F.col("n_nationkey").cast("string"), 3).alias("country_iso_num"))
