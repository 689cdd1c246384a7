"""Scalar expressions. All are built-in functions and stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zfill(code: ColumnLike, width: int) -> Column:
    """Left-pad with zeros without ever cutting longer codes (``lpad`` cuts)."""
    c = _c(code)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def rate_from_text(text: ColumnLike) -> Column:
    """Trimmed text as a number; text that is no number becomes NULL."""
    return F.trim(_c(text)).try_cast("double")


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Division that is NULL for a zero or NULL denominator."""
    return F.try_divide(_c(numerator), _c(denominator))


def weighted_mean(x: ColumnLike, weight: ColumnLike) -> Column:
    """Aggregate ``sum(x*w)/sum(w)``; a NULL ``x`` still counts in the weight."""
    return F.try_divide(F.sum(_c(x) * _c(weight)), F.sum(_c(weight)))


def is_number(x: ColumnLike) -> Column:
    """True for a finite value: not NULL, not NaN, not infinite."""
    c = _c(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def log_or_null(x: ColumnLike) -> Column:
    """Natural log, NULL for zero and negative input."""
    return F.ln(_c(x))


def arcsinh(x: ColumnLike) -> Column:
    return F.asinh(_c(x))


def null_if_nan(x: ColumnLike) -> Column:
    return F.when(~F.isnan(_c(x)), _c(x))


def fill_missing(x: ColumnLike, value: float) -> Column:
    """Replace NULL and NaN."""
    return F.coalesce(F.nanvl(_c(x).cast("double"), F.lit(float(value))), F.lit(float(value)))


def prefix_in(code: ColumnLike, prefixes: Iterable[str]) -> Column:
    """True when the code starts with any prefix; ``startswith`` reaches the scan as a pushed filter."""
    return reduce(lambda a, b: a | b, [_c(code).startswith(p) for p in prefixes], F.lit(False))


def drop_nan(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop rows with NaN in a column but keep NULL."""
    keep = reduce(lambda a, b: a & b, [F.col(c).isNull() | ~F.isnan(c) for c in columns])
    return df.filter(keep)


def drop_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with NULL in a column (all columns by default) but keep NaN."""
    keep = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (columns or df.columns)])
    return df.filter(keep)


def sum_or_zero(x: ColumnLike) -> Column:
    """Aggregate sum that is 0, not NULL, over an empty or filtered-out group."""
    return F.coalesce(F.sum(_c(x)), F.lit(0.0))
