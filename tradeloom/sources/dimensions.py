"""Small code tables. All columns are text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.functions.columns import zfill
from tradeloom.session import small_table


def scan_text(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, every column as text."""
    return spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).csv(path)


def scan_positions(spark: SparkSession, path, columns: dict[int, str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Selected column positions of a latin-1 CSV under new names."""
    raw = scan_text(spark, path, encoding)
    raw = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    return raw.select(*[F.col(f"c{i}").alias(name) for i, name in columns.items()])


def scan_concordance(spark: SparkSession, folder: str, revisions=("H1", "H2", "H3", "H4", "H5", "H6")) -> DataFrame:
    """Product code translations of several revisions to H0, one file per revision."""
    parts = [
        scan_positions(spark, f"{folder.rstrip('/')}/{r}_to_H0.CSV", {0: "source_code", 2: "target_code"}).select(
            F.lit(r).alias("hs_revision"), "source_code", "target_code"
        )
        for r in revisions
    ]
    return reduce(DataFrame.unionByName, parts)


def scan_countries(spark: SparkSession, path: str, code: str, name: str, iso3: str) -> DataFrame:
    """A country table as ``country_code, country_name, country_iso3`` with three-digit codes."""
    raw = scan_text(spark, path)
    return raw.select(zfill(code, 3).alias("country_code"), F.col(name).alias("country_name"), F.col(iso3).alias("country_iso3"))


def scan_membership(spark: SparkSession, path: str) -> DataFrame:
    """Members of preference groups, one row per group and country."""
    raw = scan_positions(spark, path, {0: "pref_group_code", 2: "country_iso_num"})
    return raw.withColumn("country_iso_num", zfill("country_iso_num", 3))


def member_lists(membership: DataFrame) -> DataFrame:
    """One row per group with its members as a list and as a set."""
    return membership.groupBy("pref_group_code").agg(
        F.sort_array(F.collect_list("country_iso_num")).alias("members"),
        F.sort_array(F.collect_set("country_iso_num")).alias("distinct_members"),
    )


def code_table(spark: SparkSession, codes, name: str) -> DataFrame:
    """A preset list as a one-column table for semi and anti joins."""
    return small_table(spark, [(c,) for c in codes], T.StructType([T.StructField(name, T.StringType())]))
