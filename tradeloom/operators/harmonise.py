"""Product and country codes brought to one standard, and duplicate rates merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import schema as S
from tradeloom.functions.joins import attach
from tradeloom.session import materialise


def _translated(df: DataFrame, concordance: DataFrame) -> DataFrame:
    table = concordance.filter(F.col("hs_revision") != "H0").select(
        "hs_revision", F.col("source_code").alias(S.PRODUCT), "target_code"
    )
    return attach(df.filter(F.col("hs_revision").isNotNull()), table, ["hs_revision", S.PRODUCT])


def translate_products(df: DataFrame, concordance: DataFrame) -> DataFrame:
    """Product codes of every revision as base-revision codes.

    A code without a translation stays as it is, a code with several yields
    several rows, and a row without a revision is left out.
    """
    keep = [c for c in df.columns if c != "hs_revision"]
    return _translated(df, concordance).withColumn(S.PRODUCT, F.coalesce("target_code", S.PRODUCT)).select(keep)


def translation_report(df: DataFrame, concordance: DataFrame) -> DataFrame:
    """One row of counts: codes before and after, base rows, translated rows, rows left alone, rows dropped."""
    before = df.agg(
        F.countDistinct(S.PRODUCT).alias("codes_before"),
        F.count_if(F.col("hs_revision") == "H0").alias("base_rows"),
        F.count_if(F.col("hs_revision").isNull()).alias("dropped_rows"),
    )
    after = _translated(df, concordance).agg(
        F.count_if((F.col("hs_revision") != "H0") & F.col("target_code").isNotNull()).alias("translated_rows"),
        F.count_if((F.col("hs_revision") != "H0") & F.col("target_code").isNull()).alias("left_alone_rows"),
        F.countDistinct(F.coalesce("target_code", S.PRODUCT)).alias("codes_after"),
    )
    one_row = [F.lit(1).alias("_one")]
    return before.select("*", *one_row).join(after.select("*", *one_row), "_one").drop("_one")


def nearest_labels(names: DataFrame, labels: DataFrame, most: int = 2) -> DataFrame:
    """The label nearest to each of ``names.name``, as ``name, label, distance``; names without one near enough have no row.

    Distance is the number of letters put in, left out or changed, in lower case; ties go to the first label in order. A
    name may be at most ``most`` edits away, and one edit for every three of its three-letter pieces. So a name
    and its label share a piece at least, and only such pairs are compared: both sides are indexed by pieces, and
    pairs that share too few of them for the allowed edits are left out.
    """
    def pieces(df: DataFrame, column: str) -> DataFrame:
        padded = F.concat(F.lit("  "), F.lower(column), F.lit(" "))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))
        known = df.select(F.lower(column).alias(column)).filter(F.col(column) != "").distinct()
        return known.select(column, F.size(grams).alias(f"{column}_pieces"), F.explode(grams).alias("piece"))

    shared = pieces(names, "name").join(pieces(labels, "label").drop("label_pieces"), "piece").groupBy("name", "label", "name_pieces").agg(F.count("*").alias("shared"))
    allowed = F.least(F.lit(most), F.floor((F.col("name_pieces") - 1) / 3))
    near = shared.filter(F.col("shared") >= F.col("name_pieces") - 3 * allowed).withColumn("distance", F.levenshtein("name", "label"))
    best = near.filter(F.col("distance") <= allowed).groupBy("name").agg(F.min(F.struct("distance", "label")).alias("b"))
    return best.select("name", "b.label", "b.distance")


def country_map(codes: DataFrame, overrides: DataFrame, standard: DataFrame, tables: list[DataFrame], inexact: int = 0) -> DataFrame:
    """ISO codes for each code in ``codes.original_code``, as rows ``original_code, iso_num``.

    Order of precedence: ``overrides`` (may give several countries), a direct
    hit in ``standard``, the code's name and then its ISO3 from the first of
    ``tables`` that knows it, and the code itself. ``standard`` holds
    ``label, iso_num`` with every numeric code, alpha code and name. With
    ``inexact``, a name that is no label is looked up by :func:`nearest_labels`
    with at most so many edits, after the exact name and before the ISO3 code.

    The map is written, so that joining it twice does not make it twice and its
    real size, not that of the tables the codes come from, decides how.
    """
    wanted = codes.select("original_code").filter(F.col("original_code").isNotNull()).distinct()
    labels = standard.select(F.lower("label").alias("_label"), "iso_num").groupBy("_label").agg(F.min("iso_num").alias("iso_num"))

    def by(df, label, name):
        found = labels.select("_label", F.col("iso_num").alias(name))
        return df.withColumn("_label", F.lower(label)).join(found, "_label", "left").drop("_label")

    names, iso3s = [], []
    for n, table in enumerate(tables):
        known = table.groupBy(F.col("country_code").alias("original_code")).agg(
            F.max("country_name").alias(f"_name{n}"), F.max("country_iso3").alias(f"_iso3{n}")
        )
        wanted = wanted.join(known, "original_code", "left")
        names.append(F.nullif(f"_name{n}", F.lit("")))
        iso3s.append(F.nullif(f"_iso3{n}", F.lit("")))
    none = F.lit(None).cast("string")
    wanted = by(wanted, F.col("original_code"), "_direct")
    wanted = by(wanted, F.coalesce(*names, none), "_by_name")
    wanted = by(wanted, F.coalesce(*iso3s, none), "_by_iso3")
    found = ["_direct", "_by_name", "_by_iso3"]
    if inexact:
        open_names = wanted.filter(F.col("_direct").isNull() & F.col("_by_name").isNull()).select(F.coalesce(*names, none).alias("name")).filter("name IS NOT NULL")
        near = nearest_labels(open_names, standard, inexact).join(labels.withColumnRenamed("_label", "label"), "label").select(F.col("name").alias("_near"), F.col("iso_num").alias("_by_near"))
        wanted = wanted.withColumn("_near", F.lower(F.coalesce(*names, none))).join(near, "_near", "left")
        found.insert(2, "_by_near")
    single = F.coalesce(*found, "original_code")
    listed = overrides.select("original_code", F.col("iso_num").alias("_override")).distinct()
    out = wanted.join(listed, "original_code", "left").select("original_code", F.coalesce("_override", single).alias("iso_num"))
    return materialise(out, "country-map")


def remap_countries(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace an area code by its countries.

    An area with several members yields one row per member, each with the full
    value; a code that is NULL or unknown is kept.
    """
    table = mapping.select(F.col("original_code").alias(column), F.col("iso_num").alias("_iso"))
    return attach(df, table, [column]).withColumn(column, F.coalesce("_iso", column)).select(df.columns)


def expand_groups(df: DataFrame, membership: DataFrame, keep_individuals: bool = False, column: str = S.IMPORTER) -> DataFrame:
    """Replace a preference group by its members.

    Rows whose partner is no group are dropped, or kept as they are with
    ``keep_individuals``.
    """
    table = membership.select(F.col("pref_group_code").alias(column), F.col("country_iso_num").alias("_member"))
    out = attach(df, table, [column], "left" if keep_individuals else "inner")
    return out.withColumn(column, F.coalesce("_member", column)).select(df.columns)


def mean_rates(rates: DataFrame) -> DataFrame:
    """Mean rates per country (pair), year and product, after translation merged codes."""
    keys = [c for c in [S.EXPORTER, S.IMPORTER, S.YEAR, S.PRODUCT, "tariff_type"] if c in rates.columns]
    return rates.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in S.RATES])


def least_rates(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Least rates per key, so a join on the key cannot repeat rows."""
    return rates.groupBy(*keys).agg(*[F.min(c).alias(c) for c in S.RATES])
