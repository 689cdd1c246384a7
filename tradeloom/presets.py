"""Fixed values that results depend on. Callers may pass their own instead."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.session import small_table
from tradeloom.sources.added import action_log, set_where

# Codes of areas that stand for one or several ISO numeric codes.
EU_AND_MONACO = (
    "040", "056", "100", "191", "196", "203", "208", "233", "246", "250", "276", "300", "348", "372",
    "380", "428", "440", "442", "470", "528", "616", "620", "642", "703", "705", "724", "752", "492",
)
EFTA = ("352", "438", "578", "756")
AREA_CODES = {"697": list(EFTA), "490": ["158"], "918": list(EU_AND_MONACO)}

# Further codes in tariff schedules.
TARIFF_AREA_CODES = AREA_CODES | {
    "230": ["231"],
    "200": ["203"],
    "729": ["736"],
    "728": ["736"],
    "688": ["891"],
    "499": ["890"],
}

# ISO numeric codes of the countries the analyses name.
COUNTRIES = {
    "USA": "840",
    "China": "156",
    "United Kingdom": "826",
    "Brazil": "076",
    "Ireland": "372",
    "Italy": "380",
    "South Africa": "710",
    "Germany": "276",
    "France": "250",
    "South Korea": "410",
    "Turkiye": "792",
    "Australia": "036",
    "Saudi Arabia": "682",
    "Mexico": "484",
    "Canada": "124",
    "Indonesia": "360",
    "India": "356",
    "Russia": "643",
    "Hong Kong": "344",
    "Vietnam": "704",
    "Japan": "392",
    "Taiwan": "158",
    "Malaysia": "458",
    "Thailand": "764",
    "Cambodia": "116",
}

# Country groups of the regressions and charts, by name above.
CORE_REST_OF_WORLD = ["United Kingdom", "Brazil", "Ireland", "Italy", "South Africa", "Germany", "France"]
WIDER_REST_OF_WORLD = [
    *CORE_REST_OF_WORLD,
    "South Korea", "Turkiye", "Australia", "Saudi Arabia", "Mexico", "Canada", "Indonesia", "India",
]
ASIAN_EXPORTERS = ["China", "Vietnam", "Mexico", "Taiwan", "South Korea", "Malaysia", "Thailand", "Cambodia"]
NOT_IN_REST_OF_WORLD = ["United Kingdom", "China", "Russia", "Hong Kong", "USA"]
COUNTRY_GROUPS = {
    "core_rest_of_world": CORE_REST_OF_WORLD,
    "core": ["USA", "China", *CORE_REST_OF_WORLD],
    "wider_rest_of_world": WIDER_REST_OF_WORLD,
    "wider": ["USA", "China", *WIDER_REST_OF_WORLD],
    "asian_exporters": ASIAN_EXPORTERS,
    "not_in_rest_of_world": NOT_IN_REST_OF_WORLD,
}

# Added rate by product prefix, as a fraction.
STEEL_PREFIX, STEEL_RATE = "72", 0.25
ALUMINIUM_PREFIX, ALUMINIUM_RATE = "76", 0.10
SECTOR_RATES = [(STEEL_PREFIX, STEEL_RATE), (ALUMINIUM_PREFIX, ALUMINIUM_RATE)]

RESOURCE_CHAPTER = "27"

# Weights that average yearly coefficients.
COEFFICIENT_WEIGHTS = {2018: 0.25, 2019: 0.75, 2020: 0.0}


def country_group(name: str) -> list[str]:
    return [COUNTRIES[c] for c in COUNTRY_GROUPS[name]]


def area_code_table(spark: SparkSession, areas: dict[str, list[str]] | None = None) -> DataFrame:
    """Area codes as rows ``original_code, iso_num``."""
    rows = [(code, iso) for code, members in (areas or AREA_CODES).items() for iso in members]
    return small_table(spark, rows, "original_code string, iso_num string")


# Six-digit steel and aluminium products under separate duties.
STEEL_AND_ALUMINIUM_PRODUCTS = (
    "720610", "720690", "720711", "720712", "720719", "720720", "720810", "720825", "720826", "720827", "720836", "720837",
    "720838", "720839", "720840", "720851", "720852", "720853", "720854", "720890", "720915", "720916", "720917", "720918",
    "720925", "720926", "720927", "720928", "720990", "721011", "721012", "721020", "721030", "721041", "721049", "721050",
    "721061", "721069", "721070", "721090", "721113", "721114", "721119", "721123", "721129", "721190", "721210", "721220",
    "721230", "721240", "721250", "721260", "721310", "721320", "721391", "721399", "721410", "721420", "721430", "721491",
    "721499", "721510", "721550", "721590", "721610", "721621", "721622", "721631", "721632", "721633", "721640", "721650",
    "721699", "721710", "721720", "721730", "721790", "721810", "721891", "721899", "721911", "721912", "721913", "721914",
    "721921", "721922", "721923", "721924", "721931", "721932", "721933", "721934", "721935", "721990", "722011", "722012",
    "722020", "722090", "722100", "722211", "722219", "722220", "722230", "722240", "722300", "722410", "722490", "722511",
    "722519", "722530", "722540", "722550", "722591", "722592", "722599", "722611", "722619", "722620", "722691", "722692",
    "722699", "722710", "722720", "722790", "722810", "722820", "722830", "722840", "722850", "722860", "722870", "722880",
    "722920", "722990", "730110", "730210", "730240", "730290", "730411", "730419", "730422", "730423", "730424", "730429",
    "730431", "730439", "730441", "730449", "730451", "730459", "730490", "730511", "730512", "730519", "730520", "730531",
    "730539", "730590", "730611", "730619", "730621", "730629", "730630", "730640", "730650", "730661", "730669", "730690",
    "760110", "760120", "760410", "760421", "760429", "760511", "760519", "760521", "760529", "760611", "760612", "760691",
    "760692", "760711", "760719", "760720", "760810", "760820", "760900",
)

# Tariff actions as date, country, target, legal basis, trade value in USD, rate and status.
TARIFF_ACTIONS = [
    ("2018-03-23", "USA", "Steel imports from various countries", "Section 232", None, 0.25, "Active"),
    ("2018-03-23", "USA", "Aluminum imports from various countries", "Section 232", None, 0.10, "Active"),
    ("2018-04-02", "China", "128 U.S. products (Retaliation to Sec 232)", "Retaliation", 3_000_000_000, 0.15, "Active"),
    ("2018-04-02", "China", "128 U.S. products (Retaliation to Sec 232)", "Retaliation", 3_000_000_000, 0.25, "Active"),
    ("2018-07-06", "USA", "Chinese products (List 1)", "Section 301", 34_000_000_000, 0.25, "Active"),
    ("2018-07-06", "China", "545 U.S. products (Retaliation to List 1)", "Retaliation", 34_000_000_000, 0.25, "Active"),
    ("2018-08-23", "USA", "Chinese products (List 2)", "Section 301", 16_000_000_000, 0.25, "Active"),
    ("2018-08-23", "China", "333 U.S. products (Retaliation to List 2)", "Retaliation", 16_000_000_000, 0.25, "Active"),
    ("2018-09-24", "USA", "Chinese products (List 3)", "Section 301", 200_000_000_000, 0.10, "Active"),
    ("2019-05-10", "USA", "Chinese products (List 3)", "Section 301", 200_000_000_000, 0.25, "Increased"),
    ("2018-09-24", "China", "U.S. products (Retaliation to List 3)", "Retaliation", 60_000_000_000, 0.05, "Active"),
    ("2018-09-24", "China", "U.S. products (Retaliation to List 3)", "Retaliation", 60_000_000_000, 0.10, "Active"),
    ("2019-09-01", "USA", "Chinese products (List 4A)", "Section 301", 120_000_000_000, 0.15, "Active"),
    ("2019-09-01", "China", "U.S. products (Retaliation to List 4A)", "Retaliation", None, 0.05, "Active"),
    ("2019-09-01", "China", "U.S. products (Retaliation to List 4A)", "Retaliation", None, 0.10, "Active"),
    ("2019-12-15", "USA", "Chinese products (List 4B)", "Section 301", 180_000_000_000, 0.15, "Suspended"),
    ("2019-12-15", "China", "U.S. products (Retaliation to List 4B)", "Retaliation", None, 0.05, "Suspended"),
    ("2019-12-15", "China", "U.S. products (Retaliation to List 4B)", "Retaliation", None, 0.10, "Suspended"),
    ("2020-02-14", "USA", "Chinese products (List 4A)", "Section 301", 120_000_000_000, 0.075, "Reduced"),
    ("2020-02-14", "China", "Some U.S. goods (Reductions/Exemptions)", "Retaliation", None, None, "Reduced/Exempted"),
]

# Headings of those actions, by target, date and rate.
ACTION_HEADINGS = [
    ("Chinese products (List 1)", "2018-07-06", 0.25, "9903.88.01"),
    ("Chinese products (List 2)", "2018-08-23", 0.25, "9903.88.02"),
    ("Chinese products (List 3)", "2018-09-24", 0.10, "9903.88.03"),
    ("Chinese products (List 3)", "2019-05-10", 0.25, "9903.88.03"),
    ("Chinese products (List 4A)", "2019-09-01", 0.15, "9903.88.15"),
    ("Chinese products (List 4A)", "2020-02-14", 0.075, "9903.88.15"),
]

# Later actions by the USA that are known by their heading: date, target, legal basis, rate and heading.
HEADING_ACTIONS = [
    ("2018-09-24", "Chinese products (under HTS 9903.88.04)", "Section 301", 0.20, "9903.88.04"),
    ("2024-09-27", "Chinese products (under HTS 9903.91.01)", "Section 301", 0.25, "9903.91.01"),
    ("2024-09-27", "Chinese products (under HTS 9903.91.02)", "Section 301", 0.25, "9903.91.02"),
    ("2024-09-27", "Chinese products (under HTS 9903.91.03)", "Section 301", 0.25, "9903.91.03"),
    ("2024-09-27", "Chinese products (under HTS 9903.92.10)", "Section 301", 0.25, "9903.92.10"),
    ("2025-01-01", "Chinese products (under HTS 9903.91.04)", "Section 301", 0.25, "9903.91.04"),
    ("2025-01-01", "Chinese products (under HTS 9903.91.05)", "Section 301", 0.25, "9903.91.05"),
    ("2025-01-01", "Chinese products (under HTS 9903.91.11)", "Section 301", 0.25, "9903.91.11"),
    ("2025-02-05", "Products of China and Hong Kong (IEEPA)", "IEEPA", 0.10, "9903.01.20"),
    ("2025-03-04", "Products of China and Hong Kong (IEEPA)", "IEEPA", 0.20, "9903.01.24"),
]


def tariff_actions() -> list[dict]:
    """The actions as records for :func:`tradeloom.sources.added.action_log`; ``seq`` is their order above."""
    rows = [(*action, None) for action in TARIFF_ACTIONS]
    rows += [(day, "USA", target, basis, None, rate, "Active", heading) for day, target, basis, rate, heading in HEADING_ACTIONS]
    names = ("effective_date", "action_entity", "tariff_target", "legal_basis", "trade_value_usd", "applied_rate", "status", "hts_heading")
    records = []
    for seq, row in enumerate(rows):
        record = {"seq": seq, **dict(zip(names, row))}
        record["effective_date"] = date.fromisoformat(record["effective_date"])
        record["trade_value_usd"] = None if record["trade_value_usd"] is None else float(record["trade_value_usd"])
        records.append(record)
    return records


def tariff_action_log(spark: SparkSession) -> DataFrame:
    """The log of all actions, with the headings of the earlier ones filled in by rule."""
    rules = [
        ((F.col("tariff_target") == target) & (F.col("effective_date") == F.lit(day).cast("date")) & (F.col("applied_rate") == rate), heading)
        for target, day, rate, heading in ACTION_HEADINGS
    ]
    return set_where(action_log(spark, tariff_actions()), "hts_heading", rules)
