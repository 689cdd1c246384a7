"""Fill, interpolation and indexing along an ordered group.

A window puts a whole group into one task. The fills therefore first reduce the
input to one row per group and sort value (``grid``), which is bounded by the
number of distinct sort values, run the window on that, and join the result
back. Callers that know the pair to be a key pass ``unique=True`` and get the
plain window instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradeloom.functions.columns import ratio
from tradeloom.functions.joins import attach_summary


def _before(group, sort):
    return W.partitionBy(*group).orderBy(sort).rowsBetween(W.unboundedPreceding, W.currentRow)


def _after(group, sort):
    return W.partitionBy(*group).orderBy(sort).rowsBetween(W.currentRow, W.unboundedFollowing)


def _along(df: DataFrame, group: list[str], sort: str, col: str, filled: Column, unique: bool, finish=None) -> DataFrame:
    """Replace NULLs of ``col`` by ``filled``, an expression over one row per (group, sort)."""
    finish = finish or (lambda c: c)
    if unique:
        return df.withColumn("_f", filled).withColumn(col, finish(F.coalesce(col, "_f"))).drop("_f")
    grid = df.groupBy(*group, sort).agg(F.max(col).alias(col)).withColumn("_f", filled).drop(col)
    return attach_summary(df, grid, [*group, sort], tag="grid").withColumn(col, finish(F.coalesce(col, "_f"))).drop("_f").select(*df.columns)


def fill_forward(df: DataFrame, group: list[str], sort: str, col: str, unique: bool = False) -> DataFrame:
    return _along(df, group, sort, col, F.last(col, ignorenulls=True).over(_before(group, sort)), unique)


def fill_both_ways(df: DataFrame, group: list[str], sort: str, col: str, unique: bool = False) -> DataFrame:
    """Forward fill, then backward fill what is still missing at the start."""
    filled = F.coalesce(
        F.last(col, ignorenulls=True).over(_before(group, sort)),
        F.first(col, ignorenulls=True).over(_after(group, sort)),
    )
    return _along(df, group, sort, col, filled, unique)


def interpolate(df: DataFrame, group: list[str], sort: str, col: str, fill_value: float | None = 0.0, unique: bool = False) -> DataFrame:
    """Linear interpolation by position within the group; NULLs outside the known range get ``fill_value``.

    Positions count distinct sort values, so a missing year takes no slot.
    """
    pos = F.row_number().over(W.partitionBy(*group).orderBy(sort))
    known = F.when(F.col(col).isNotNull(), F.struct(pos.alias("p"), F.col(col).cast("double").alias("v")))
    work = df if unique else df.groupBy(*group, sort).agg(F.max(col).alias(col))
    work = work.withColumn("_known", known).withColumn("_pos", pos)
    lo = F.last("_known", ignorenulls=True).over(_before(group, sort))
    hi = F.first("_known", ignorenulls=True).over(_after(group, sort))
    work = work.withColumn("_lo", lo).withColumn("_hi", hi)
    step = ratio(F.col("_hi.v") - F.col("_lo.v"), F.col("_hi.p") - F.col("_lo.p"))
    work = work.withColumn("_f", F.col("_lo.v") + step * (F.col("_pos") - F.col("_lo.p")))
    if not unique:
        work = attach_summary(df, work.select(*group, sort, "_f"), [*group, sort], tag="grid")
    parts = [F.col(col).cast("double"), F.col("_f")]
    if fill_value is not None:
        parts.append(F.lit(float(fill_value)))
    return work.withColumn(col, F.coalesce(*parts)).select(*df.columns)


def broadcast_where(df: DataFrame, keys: list[str], condition: Column, x: Column, name: str, how=F.avg) -> DataFrame:
    """Attach ``how(x)`` over the rows of each key group that meet ``condition``.

    The condition reaches the scan as a filter, so only the selected rows are
    aggregated, and no task ever holds a whole group.
    """
    picked = df.filter(condition).groupBy(*keys).agg(how(x).alias(name))
    return attach_summary(df, picked, keys, tag="picked")


def index_to_base(df: DataFrame, group: list[str], at_base: Column, cols: list[str], suffix: str = "_indexed") -> DataFrame:
    """Each column as a percentage of its value in the base row of its group."""
    base = df.filter(at_base).groupBy(*group).agg(*[F.min(c).alias(f"_base_{c}") for c in cols])
    out = attach_summary(df, base, group, tag="base")
    indexed = {f"{c}{suffix}": ratio(F.col(c), F.col(f"_base_{c}")) * 100 for c in cols}
    return out.withColumns(indexed).drop(*[f"_base_{c}" for c in cols])


def rebase(df: DataFrame, at_base: Column, cols: list[str], suffix: str = "_rebased") -> DataFrame:
    """Rebase whole columns to 100 at one baseline row (the least of several, so the result is repeatable)."""
    base = df.filter(at_base).agg(F.min(F.struct(*cols)).alias("_b")).select("_b")
    scaled = {f"{c}{suffix}": ratio(F.col(c), F.col(f"_b.{c}")) * 100 for c in cols}
    return df.withColumn("_b", base.scalar()).withColumns(scaled).drop("_b")
