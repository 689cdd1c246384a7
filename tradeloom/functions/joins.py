"""Lookup joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.session import materialise


def attach(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", salt: int = 0) -> DataFrame:
    """Join ``table`` (few rows per key) onto ``rows``.

    There is no broadcast hint: the planner broadcasts a table whose size it
    knows to be small and otherwise sorts and merges, where AQE splits a hot
    partition. ``salt`` > 1 spreads every key of ``rows`` over that many
    partitions and repeats ``table`` as often, for sessions without AQE.
    """
    if salt <= 1:
        return rows.join(table, on, how)
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError("a salted join cannot keep unmatched rows of the repeated side")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salt)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
    salted = rows.withColumn("_salt", spread).join(table.withColumn("_salt", copies), [*on, "_salt"], how)
    return salted.drop("_salt")


def attach_summary(rows: DataFrame, summary: DataFrame, on: list[str], how: str = "left", tag: str = "summary") -> DataFrame:
    """Attach an aggregate of a large table back to a large table.

    The planner cannot know how far an aggregate shrinks its input, so it would
    shuffle ``rows`` too. Writing the aggregate first gives it the real size.
    It also lets AQE split a hot key: that needs both sides of the join to come
    straight from a shuffle, with no aggregate in between.
    """
    return attach(rows, materialise(summary, tag), on, how)
