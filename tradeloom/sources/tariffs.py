"""Tariff schedules: one folder per kind, product revision, country and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom import schema as S
from tradeloom.functions.columns import rate_from_text


def tariff_schema(kind: str):
    if kind not in S.TARIFF_RAW:
        raise ValueError(f"unknown tariff kind {kind!r}; use one of {sorted(S.TARIFF_RAW)}")
    return S.TARIFF_RAW[kind]


def scan_tariffs(spark: SparkSession, kind: str, base: str, files: str = "*/*JobID*.CSV") -> DataFrame:
    """Every schedule of one kind in a single read, with the parts of its folder name.

    ``NA`` and empty text are NULL, extra fields of a ragged line are cut and
    fields of the wrong type become NULL.
    """
    raw = (
        spark.read.schema(tariff_schema(kind))
        .option("header", True).option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("nullValue", "NA")
        .csv(f"{base.rstrip('/')}/{files}")
    )
    return raw.withColumns({name: folder_part(kind, name) for name in ("folder_revision", "folder_country", "folder_year")})


def folder_part(kind: str, part: str) -> Column:
    """A field of a folder named like ``AVEMFN_H3_840_2010_U2``."""
    group = {"folder_revision": 1, "folder_country": 2, "folder_year": 3}[part]
    text = F.regexp_extract(F.col("_metadata.file_path"), rf"{kind}_(H\d+)_(\w+)_(\d+)_U2", group)
    return text.try_cast("int") if part == "folder_year" else text


def tidy_tariffs(raw: DataFrame, kind: str) -> DataFrame:
    """Panel names and numeric rates. The rate is the simple average."""
    tariff_schema(kind)
    partner = [F.col("Partner").alias(S.IMPORTER)] if kind == "AVEPref" else []
    return raw.select(
        F.col("Year").alias(S.YEAR),
        F.col("Reporter_ISO_N").alias(S.EXPORTER),
        *partner,
        F.col("ProductCode").alias(S.PRODUCT),
        F.col("NomenCode").alias("hs_revision"),
        rate_from_text("SimpleAverage").alias("tariff_rate"),
        rate_from_text("Min_Rate").alias("min_rate"),
        rate_from_text("Max_Rate").alias("max_rate"),
        F.lit(kind).alias("tariff_type"),
    )


def unparsed_rates(raw: DataFrame) -> DataFrame:
    """How many rate texts were present but no number, per column."""
    texts = ["SimpleAverage", "Min_Rate", "Max_Rate"]
    bad = [F.count_if(F.col(t).isNotNull() & rate_from_text(t).isNull()).alias(t) for t in texts]
    return raw.agg(*bad)


def rejected_fields(spark: SparkSession, kind: str, base: str, files: str = "*/*JobID*.CSV") -> DataFrame:
    """What :func:`scan_tariffs` reads as NULL or cuts: one row per field or line, with its file.

    ``reason`` is ``type`` for a field that is no value of its column's type, ``rate`` for a rate text without a
    number, both with ``column`` and ``text``, and ``fields`` for a line with too few or too many fields, with the line as ``text``.
    """
    kinds = tariff_schema(kind)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in kinds] + [T.StructField("_line", T.StringType())])
    raw = (
        spark.read.schema(texts)
        .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").option("columnPruning", False).option("nullValue", "NA")
        .csv(f"{base.rstrip('/')}/{files}")
    )
    checks = []
    for f in kinds:
        rate = f.name in ("SimpleAverage", "Min_Rate", "Max_Rate")
        if rate or not isinstance(f.dataType, T.StringType):
            value = rate_from_text(f.name) if rate else F.trim(f.name).try_cast(f.dataType)
            bad = F.col(f.name).isNotNull() & value.isNull()
            checks.append(F.struct(F.when(bad, "rate" if rate else "type").alias("reason"), F.lit(f.name).alias("column"), F.col(f.name).alias("text")))
    checks.append(F.struct(F.when(F.col("_line").isNotNull(), "fields").alias("reason"), F.lit(None).cast("string").alias("column"), F.col("_line").alias("text")))
    found = raw.select(F.col("_metadata.file_path").alias("file"), folder_part(kind, "folder_year").alias("folder_year"), F.explode(F.array(*checks)).alias("r"))
    return found.filter(F.col("r.reason").isNotNull()).select("file", "folder_year", "r.*")
