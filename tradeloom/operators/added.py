"""Added (official) tariffs: preparation, mapping from headings, and overlay on the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import presets
from tradeloom import schema as S
from tradeloom.functions.joins import attach_summary
from tradeloom.functions.ranks import first_per_key
from tradeloom.functions.windows import fill_forward


def prepare_added(lists: DataFrame, revision: str = "HS6") -> DataFrame:
    """Mean rate (as a percentage) and mean date per shortened product code."""
    return lists.groupBy(S.PRODUCT).agg(
        F.date_from_unix_date(F.floor(F.avg(F.unix_date("effective_date"))).cast("int")).alias("effective_date"),
        (F.avg("rate") * 100).alias("rate"),
        F.lit(revision).alias("hs_revision"),
    )


def rates_by_heading(codes: DataFrame, log: DataFrame) -> DataFrame:
    """Rate and date of each product's tariff heading.

    ``codes`` has ``hs_code, heading`` and ``log`` has ``hts_heading,
    effective_date, applied_rate, seq``. A heading listed several times counts
    with its last row by ``seq``; a product listed twice under a heading counts once.
    """
    last = log.filter(F.col("hts_heading").isNotNull()).groupBy(F.trim("hts_heading").alias("heading")).agg(
        F.max_by(F.struct("effective_date", F.coalesce("applied_rate", F.lit(0.0)).alias("rate")), "seq").alias("_r")
    )
    pairs = codes.select("hs_code", "heading").distinct()
    return attach_summary(pairs, last, ["heading"], tag="headings").select("hs_code", F.col("_r.rate").alias("rate"), F.col("_r.effective_date").alias("effective_date"), "heading")


def six_digit_rates(mapped: DataFrame) -> DataFrame:
    """Mean rate per six-digit product and date; undated products are left out."""
    code = F.substring(F.replace("hs_code", F.lit("."), F.lit("")), 1, 6)
    return mapped.filter(F.col("effective_date").isNotNull()).groupBy(code.alias(S.PRODUCT), "effective_date").agg(
        F.avg("rate").alias("rate"), F.lit("HS6").alias("hs_revision")
    )


def densify(official: DataFrame, last_year: int) -> DataFrame:
    """Yearly rate per product from the first official year on, carried forward until ``last_year``.

    The years come from one sequence per product, so there is no cross join.
    """
    yearly = (
        official.select(S.PRODUCT, F.year("effective_date").alias(S.YEAR), F.col("rate").cast("double").alias("official_rate"))
        .dropna()
        .groupBy(S.PRODUCT, S.YEAR)
        .agg(F.avg("official_rate").alias("official_rate"))
    )
    first = yearly.agg(F.min(S.YEAR))
    years = F.explode(F.when(F.col("_first") <= last_year, F.sequence(F.col("_first"), F.lit(last_year))))
    scaffold = yearly.select(S.PRODUCT).distinct().withColumn("_first", first.scalar()).select(S.PRODUCT, years.alias(S.YEAR))
    dense = scaffold.join(yearly, [S.PRODUCT, S.YEAR], "left")
    dense = fill_forward(dense, [S.PRODUCT], S.YEAR, "official_rate", unique=True)
    return dense.filter(F.col("official_rate").isNotNull())


def sector_rules(rates=presets.SECTOR_RATES, from_year: int | None = None, exporters: list[str] | None = None) -> list[dict]:
    """Sector overrides as rules. The preset applies to every exporter and year and holds fractions, not percentages."""
    return [{"prefix": p, "rate": r, "from_year": from_year, "exporters": exporters} for p, r in rates]


def overlay_official(
    panel: DataFrame,
    official: DataFrame,
    last_year: int | None = None,
    exporter: str = presets.COUNTRIES["China"],
    importer: str = presets.COUNTRIES["USA"],
    rules: list[dict] | None = None,
) -> DataFrame:
    """Add ``official_tariff`` and ``average_tariff_official`` to the panel.

    The densified official rate holds for one exporter-importer pair; sector
    rules replace it for every exporter into that importer. Elsewhere the added
    tariff is 0. An unknown average tariff stays unknown.
    """
    panel = panel.drop("official_tariff", "average_tariff_official")
    if last_year is None:
        last_year = panel.agg(F.max(S.YEAR)).first()[0]
    dense = densify(official, last_year).withColumns({S.EXPORTER: F.lit(exporter), S.IMPORTER: F.lit(importer)})
    out = attach_summary(panel, dense, [S.PRODUCT, S.YEAR, S.EXPORTER, S.IMPORTER], tag="official")
    rate = F.col("official_rate")
    for rule in reversed(sector_rules() if rules is None else rules):
        applies = F.col(S.PRODUCT).startswith(rule["prefix"])
        if rule.get("from_year") is not None:
            applies &= F.col(S.YEAR) >= rule["from_year"]
        if rule.get("exporters"):
            applies &= F.col(S.EXPORTER).isin(list(rule["exporters"]))
        rate = F.when(applies, F.lit(float(rule["rate"]))).otherwise(rate)
    added = F.coalesce(F.nanvl(F.when(F.col(S.IMPORTER) == importer, rate), F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("official_tariff", added)
    return out.withColumn("average_tariff_official", F.col("average_tariff") + F.col("official_tariff")).select(
        *panel.columns, "official_tariff", "average_tariff_official"
    )


def compare_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tariff sources matched on product, month and rate, with the side(s) each row is on."""
    def keyed(df, side):
        return df.select(S.PRODUCT, F.trunc("effective_date", "month").alias("month"), "rate").withColumn(side, F.lit(True))

    both = keyed(a, "_a").join(keyed(b, "_b"), [S.PRODUCT, "month", "rate"], "full")
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left_only").otherwise("right_only")
    return both.withColumn("found_in", side).drop("_a", "_b")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Drop duplicates of ``keys``, keeping the first in ``order``."""
    return first_per_key(df, keys, order)
