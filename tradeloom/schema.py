"""Column names and explicit schemas. ``year`` is an integer inside the library."""

from __future__ import annotations

from pyspark.sql import types as T

YEAR, EXPORTER, IMPORTER, PRODUCT = "year", "reporter_country", "partner_country", "product_code"
VALUE, QUANTITY = "value", "quantity"
TRIPLE = [EXPORTER, IMPORTER, PRODUCT]
RATES = ["tariff_rate", "min_rate", "max_rate"]


def _fields(kind, *names):
    return [T.StructField(n, kind()) for n in names]


FLOWS_RAW = T.StructType(
    _fields(T.IntegerType, "t") + _fields(T.StringType, "i", "j", "k") + _fields(T.StringType, "v", "q")
)

_RATE_TEXT = ["Sum_Of_Rates", "Min_Rate", "Max_Rate", "SimpleAverage"]
_LINE_COUNTS = ["Nbr_NA_Lines", "Nbr_Free_Lines", "Nbr_AVE_Lines", "Nbr_Dutiable_Lines", "TotalNoOfValidLines", "TotalNoOfLines"]


def _tariff_schema(with_partner: bool) -> T.StructType:
    partner = _fields(T.StringType, "Partner") if with_partner else []
    return T.StructType(
        _fields(T.StringType, "NomenCode", "Reporter_ISO_N")
        + _fields(T.IntegerType, "Year")
        + _fields(T.StringType, "ProductCode")
        + partner
        + _fields(T.StringType, *_RATE_TEXT)
        + _fields(T.IntegerType, *_LINE_COUNTS)
        + _fields(T.StringType, "EstCode")
    )


TARIFF_RAW = {"AVEMFN": _tariff_schema(False), "AVEPref": _tariff_schema(True)}

ADDED_RAW = T.StructType(_fields(T.StringType, "time", "hs_code") + _fields(T.DoubleType, "tariff_add"))

ADDED = T.StructType(
    _fields(T.StringType, PRODUCT)
    + _fields(T.DateType, "effective_date")
    + _fields(T.DoubleType, "rate")
    + _fields(T.StringType, "hs_revision")
)

ACTION_LOG = T.StructType(
    _fields(T.IntegerType, "seq")
    + _fields(T.DateType, "effective_date")
    + _fields(T.StringType, "action_entity", "tariff_target", "legal_basis")
    + _fields(T.DoubleType, "trade_value_usd", "applied_rate")
    + _fields(T.StringType, "status", "hts_heading")
)
