"""Flows joined with the tariffs that apply to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import schema as S
from tradeloom.functions.joins import attach, attach_summary
from tradeloom.operators.harmonise import least_rates


def build_panel(
    flows: DataFrame,
    mfn: DataFrame,
    pref: DataFrame,
    pref_reporter_is: str = "exporter",
    mfn_reporter_is: str = "importer",
) -> DataFrame:
    """Unified panel: each flow with its preferential and general rate of the year.

    ``average_tariff`` is the preferential rate, else the general rate, else
    NULL. A tariff is set by the importing country, so the reporter of the
    general schedule is matched with the importer. The preferential schedule is
    matched reporter to exporter by default, which is how the original panel
    was made; ``pref_reporter_is="importer"`` matches it the other way round.
    ``mfn_reporter_is="exporter"`` is the early variant of the join.
    """
    for role in (pref_reporter_is, mfn_reporter_is):
        if role not in ("exporter", "importer"):
            raise ValueError("a reporter is 'exporter' or 'importer'")
    if pref_reporter_is == "importer":
        swapped = {S.EXPORTER: S.IMPORTER, S.IMPORTER: S.EXPORTER}
        pref = pref.select(*[F.col(swapped.get(c, c)).alias(c) for c in pref.columns])
    country = S.IMPORTER if mfn_reporter_is == "importer" else S.EXPORTER
    mfn = mfn.withColumnRenamed(S.EXPORTER, country)

    pref_keys = [S.IMPORTER, S.PRODUCT, S.EXPORTER, S.YEAR]
    mfn_keys = [country, S.PRODUCT, S.YEAR]
    pref_least = least_rates(pref, pref_keys).withColumnsRenamed({c: f"{c}_pref" for c in S.RATES})
    mfn_least = least_rates(mfn, mfn_keys).withColumnsRenamed({c: f"{c}_mfn" for c in S.RATES})
    # The preferential rates are nearly as many as the flows and their keys hold few rows each, so the sums are joined as they are shuffled.
    panel = attach(flows, pref_least, pref_keys)
    panel = attach_summary(panel, mfn_least, mfn_keys, tag="mfn")
    rates = [f"{c}_{kind}" for kind in ("pref", "mfn") for c in S.RATES]
    return panel.select(*flows.columns, *rates, F.coalesce("tariff_rate_pref", "tariff_rate_mfn").alias("average_tariff"))
