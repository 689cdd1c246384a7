"""The stages from raw files to the enriched panel, each reading the last one's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom import schema as S
from tradeloom.operators import added, harmonise, merge, trend
from tradeloom.sources import flows as flow_source
from tradeloom.sources import sinks
from tradeloom.sources import tariffs as tariff_source


def clean_flows(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Raw flows with standard country codes on both sides and panel column names."""
    padded = flow_source.pad_countries(raw)
    return flow_source.name_columns(harmonise.remap_countries(harmonise.remap_countries(padded, mapping, "i"), mapping, "j"))


def clean_mfn(raw: DataFrame, concordance: DataFrame, mapping: DataFrame) -> DataFrame:
    """General schedule in base-revision products and standard countries."""
    rates = harmonise.translate_products(tariff_source.tidy_tariffs(raw, "AVEMFN"), concordance)
    return harmonise.remap_countries(harmonise.mean_rates(rates), mapping, S.EXPORTER)


def clean_pref(raw: DataFrame, concordance: DataFrame, membership: DataFrame, mapping: DataFrame, keep_individuals: bool = False) -> DataFrame:
    """Preferential schedule likewise, with groups replaced by their members."""
    rates = harmonise.translate_products(tariff_source.tidy_tariffs(raw, "AVEPref"), concordance)
    rates = harmonise.expand_groups(harmonise.mean_rates(rates), membership, keep_individuals)
    return harmonise.remap_countries(harmonise.remap_countries(rates, mapping, S.EXPORTER), mapping, S.IMPORTER)


def distinct_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of several code columns as ``original_code``."""
    return df.select(F.explode(F.array(*columns)).alias("original_code")).distinct()


def enrich(panel: DataFrame, official: DataFrame, last_year: int | None = None, **overlay) -> DataFrame:
    """Unit values, detrended metrics and official tariffs on the panel."""
    return added.overlay_official(trend.detrend(trend.add_unit_value(panel)), official, last_year, **overlay)


def run(
    spark: SparkSession, flows_glob: str, tariff_base: str, concordance: DataFrame, membership: DataFrame,
    flow_map: DataFrame, tariff_map: DataFrame, official: DataFrame, out: str, tariff_files: str = "*/*JobID*.CSV", **overlay,
) -> str:
    """All stages. Each writes Parquet that the next one reads; returns the enriched panel's path."""
    out = out.rstrip("/")
    sinks.write_parquet(clean_flows(flow_source.scan_flows(spark, flows_glob), flow_map), f"{out}/flows", mode="overwrite")
    raw = {k: tariff_source.scan_tariffs(spark, k, f"{tariff_base}/{k}", tariff_files) for k in ("AVEMFN", "AVEPref")}
    sinks.write_parquet(clean_mfn(raw["AVEMFN"], concordance, tariff_map), f"{out}/mfn", "zstd", "overwrite")
    sinks.write_parquet(clean_pref(raw["AVEPref"], concordance, membership, tariff_map), f"{out}/pref", "zstd", "overwrite")
    panel = merge.build_panel(*[spark.read.parquet(f"{out}/{t}") for t in ("flows", "mfn", "pref")])
    path = sinks.write_by_year(panel, f"{out}/panel")
    return sinks.write_next_version(enrich(spark.read.parquet(path), official, **overlay), path, "enriched")
