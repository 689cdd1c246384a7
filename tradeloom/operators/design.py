"""Regression samples: treatment, interaction and growth columns.

Fixed-effect keys stay separate columns; the solver takes lists of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom import presets
from tradeloom import schema as S
from tradeloom.functions.columns import is_number, log_or_null
from tradeloom.functions.joins import attach_summary
from tradeloom.operators.absorb import MAX_TERMS, Family

US, CHINA = presets.COUNTRIES["USA"], presets.COUNTRIES["China"]
TREATMENT = "tariff_us_china"


@dataclass
class Design:
    """A sample with its interaction columns; ``labels`` gives each term's country and year.

    Terms of ``families`` are not columns: of each family a row has at most one term, see :func:`spread`.
    """

    data: DataFrame
    terms: list[str]
    labels: dict[str, tuple[str | None, int | None]] = field(default_factory=dict)
    families: list[Family] = field(default_factory=list)


def treatment_rate(df: DataFrame, exporter: str = CHINA, importer: str = US, tariff: str = "average_tariff_official", name: str = TREATMENT) -> DataFrame:
    """Attach the mean tariff of one exporter-importer pair to every row of the year and product.

    Only that pair's rows are read for the mean; the result has one row per
    product and year.
    """
    pair = (F.col(S.EXPORTER) == exporter) & (F.col(S.IMPORTER) == importer)
    rates = df.filter(pair).groupBy(S.YEAR, S.PRODUCT).agg(F.avg(tariff).alias(name))
    return attach_summary(df, rates, [S.YEAR, S.PRODUCT], tag="treatment")


def with_roles(df: DataFrame) -> DataFrame:
    return df.withColumns({"importer": F.col(S.IMPORTER), "exporter": F.col(S.EXPORTER)})


def add_logs(df: DataFrame, columns=("value", "quantity")) -> DataFrame:
    """``log_<column>``; NULL where the column is zero or negative."""
    return df.withColumns({f"log_{c}": log_or_null(c) for c in columns})


def usable(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every column is a finite number."""
    for c in columns:
        df = df.filter(is_number(c))
    return df


def sample_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in total and rows each column would drop."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(~is_number(c)).alias(f"dropped_by_{c}") for c in columns])


def by_year(name: str, active: Column, years: list[int]) -> dict[str, Column]:
    """One column per year: the treatment where ``active`` holds in that year, 0 otherwise."""
    return {f"{name}_{y}": F.when(active & (F.col(S.YEAR) == y), F.col(TREATMENT)).otherwise(F.lit(0.0)) for y in years}


def interaction_panel(
    df: DataFrame,
    name: str,
    importers: list[str],
    exporters: list[str],
    years: list[int],
    outcome: str,
    where: Column | None = None,
    only_years: bool = False,
    treated_pair: tuple[str, str] = (CHINA, US),
) -> Design:
    """Treatment by year, active for the chosen importers and exporters.

    Rows without an outcome or a treatment are dropped. ``where`` filters after
    the treatment is known; ``only_years`` keeps just the listed years.
    """
    data = with_roles(treatment_rate(df, *treated_pair))
    active = F.col("importer").isin(list(importers)) & F.col("exporter").isin(list(exporters))
    return _interactions(data, {name: active}, years, outcome, where, only_years)


def interaction_variants(
    df: DataFrame, years: list[int], outcome: str, treated_pair: tuple[str, str] = (CHINA, US), third: str = presets.COUNTRIES["United Kingdom"], third_name: str = "UK"
) -> dict[str, Design]:
    """Three samples: imports of the treated importer, of all others, and of one third country."""
    exporter, importer = treated_pair
    data = with_roles(treatment_rate(df, exporter, importer))
    sold = F.col("exporter") == exporter
    variants = {
        "tariff_interaction_US": (F.col("importer") == importer) & sold,
        "tariff_interaction_ROW": (F.col("importer") != importer) & sold,
        f"tariff_interaction_{third_name}": (F.col("importer") == third) & sold,
    }
    return {name: _interactions(data, {name: active}, years, outcome, None, True) for name, active in variants.items()}


def _interactions(data, actives, years, outcome, where, only_years) -> Design:
    columns, labels = {}, {}
    for name, active in actives.items():
        for term, column in by_year(name, active, years).items():
            columns[term] = column
            labels[term] = (name, int(term.rsplit("_", 1)[1]))
    if only_years:
        data = data.filter(F.col(S.YEAR).isin(list(years)))
    if where is not None:
        data = data.filter(where)
    data = usable(data, [outcome, TREATMENT]).withColumns(columns)
    return Design(data, list(columns), labels)


def importer_split(df: DataFrame, importer: str, outcome: str, exporter: str = CHINA, treated_pair: tuple[str, str] = (CHINA, US), years: list[int] | None = None) -> Design:
    """One country's imports with the treatment split into the target exporter and all others."""
    data = with_roles(treatment_rate(df, *treated_pair)).filter(F.col("importer") == importer)
    if years:
        data = data.filter(F.col(S.YEAR).isin(list(years)))
    target = F.col("exporter") == exporter
    columns = {
        "tariff_x_target": F.when(target, F.col(TREATMENT)).otherwise(F.lit(0.0)),
        "tariff_x_row": F.when(~target, F.col(TREATMENT)).otherwise(F.lit(0.0)),
    }
    return Design(usable(data, [outcome, TREATMENT]).withColumns(columns), list(columns), {c: (c, None) for c in columns})


def importer_years(data: DataFrame, name: str, importers: list[str], years: list[int], active: Column) -> Design:
    """A term per importer and year, ``<name>_<importer>_<year>``: the treatment in that importer's active rows of that year.

    A row has at most one of them, so they stay one column ``<name>_at``, however many there are.
    """
    if len(importers) * len(years) > MAX_TERMS:
        raise ValueError(f"{len(importers)} importers and {len(years)} years make more than {MAX_TERMS} terms")
    labels = {f"{name}_{c}_{y}": (c, y) for c in importers for y in years}
    country, year = (F.array_position(F.lit(known) if known else F.array().cast(kind), F.col(c)) for known, c, kind in ((importers, "importer", "array<string>"), (years, S.YEAR, "array<int>")))
    at = F.when(active & (country > 0) & (year > 0), (country - 1) * len(years) + year - 1).cast("int")
    return Design(data.withColumn(f"{name}_at", at), list(labels), labels, [Family(f"{name}_at", TREATMENT, list(labels))])


def spread(design: Design) -> DataFrame:
    """The sample with a column for every term of its families."""
    columns = {n: F.when(F.col(f.at) == i, F.col(f.value)).otherwise(F.lit(0.0)) for f in design.families for i, n in enumerate(f.names)}
    return design.data.withColumns(columns)


def saturated_panel(
    df: DataFrame,
    years: list[int],
    outcome: str,
    exclude: list[str] | None = None,
    where: Column | None = None,
    treated_pair: tuple[str, str] = (CHINA, US),
) -> Design:
    """A term per importer and year, named ``gamma_<importer>_<year>``.

    The importers are fetched: a country list, not data. Only the columns a
    regression can use are kept.
    """
    exclude = list(treated_pair if exclude is None else exclude)
    found = df.select(S.IMPORTER).distinct().filter(~F.col(S.IMPORTER).isin(exclude)).orderBy(S.IMPORTER).limit(MAX_TERMS + 1)
    data = with_roles(treatment_rate(df, *treated_pair))
    if where is not None:
        data = data.filter(where)
    keep = list(dict.fromkeys([S.YEAR, S.PRODUCT, "importer", "exporter", TREATMENT, outcome]))
    return importer_years(usable(data, [outcome, TREATMENT]).select(*keep), "gamma", [r[0] for r in found.collect()], years, F.col("exporter") == treated_pair[0])


def growth_panel(
    df: DataFrame, period1: tuple[int, int], period2: tuple[int, int], importers: list[str],
    exporters: dict[str, str] | None = None,
) -> DataFrame:
    """Yearly log growth (percent) of each flow over two periods, one row per period.

    ``PostEvent`` marks the second period and ``is_<name>_exporter`` the chosen
    exporters. Flows missing at either end of a period are left out of it. Of
    several rows in a year the least value counts.
    """
    for start, end in (period1, period2):
        if end <= start:
            raise ValueError("a period must end after it starts")
    years = sorted({*period1, *period2})
    rows = df.filter(F.col(S.YEAR).isin(years) & F.col(S.IMPORTER).isin(list(importers)) & (F.col(S.VALUE) > 0))
    wide = rows.groupBy(*S.TRIPLE).agg(*[F.min(F.when(F.col(S.YEAR) == y, F.col(S.VALUE))).alias(f"v{y}") for y in years])

    def growth(period, flag):
        start, end = period
        y = 100 * (F.ln(f"v{end}") - F.ln(f"v{start}")) / (end - start)
        return F.struct(y.alias("y"), F.lit(flag).cast("byte").alias("PostEvent"))

    periods = F.explode(F.array(growth(period1, 0), growth(period2, 1)))
    out = wide.select(*S.TRIPLE, periods.alias("g")).select(*S.TRIPLE, "g.y", "g.PostEvent").filter(is_number("y"))
    dummies = {f"is_{name}_exporter": (F.col(S.EXPORTER) == code).cast("byte") for name, code in (exporters or {"CHN": CHINA, "USA": US}).items()}
    return out.withColumns(dummies)


def third_country_panel(
    df: DataFrame, country: str, period1: tuple[int, int], period2: tuple[int, int], importers: list[str],
    exporters: dict[str, str] | None = None,
) -> DataFrame:
    """Growth panel with each exporter's dummy split into sales to one country and to all others."""
    if country not in importers:
        raise ValueError(f"{country!r} is not among the importers")
    exporters = exporters or {"CHN": CHINA, "USA": US}
    out = growth_panel(df, period1, period2, importers, exporters).drop(*[f"is_{n}_exporter" for n in exporters])
    there = F.col(S.IMPORTER) == country
    dummies = {}
    for label, to in ((country, there), (f"non{country}", ~there)):
        for name, code in exporters.items():
            dummies[f"is_{name}_exporter_{label}_importer"] = ((F.col(S.EXPORTER) == code) & to).cast("byte")
    return out.withColumns(dummies)


def multiply(df: DataFrame, columns: list[str], by: str = "PostEvent") -> Design:
    """Products of dummies with an event flag, named ``<column>_x_<by>``."""
    products = {f"{c}_x_{by}": F.col(c).cast("double") * F.col(by) for c in columns}
    return Design(df.withColumns(products), list(products), {p: (p, None) for p in products})
