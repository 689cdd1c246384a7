"""Writers. None of them overwrites the table it reads from."""

from __future__ import annotations

import os.path

from pyspark.sql import DataFrame
from tradeloom import schema as S


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("compression", compression).parquet(path)
    return path


def write_by_year(df: DataFrame, path: str, mode: str = "overwrite", only_years_present: bool = False) -> str:
    """Partition by ``year``.

    Rows are brought together by year with a rebalance hint: at run time a
    heavy year is split into files of the advisory size and light years share a
    task, so no year has to fit one task. With ``only_years_present`` an
    overwrite replaces just the years in ``df``.
    """
    writer = df.hint("rebalance", S.YEAR).write.mode(mode).option("compression", "zstd").partitionBy(S.YEAR)
    if only_years_present:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path


def write_next_version(df: DataFrame, source: str, tag: str) -> str:
    """Write an enriched table beside its source and return the new path.

    Spark reads lazily, so writing over the source would destroy the input of
    the running job. The source stays as it is.
    """
    target = f"{source.rstrip('/')}__{tag}"
    if os.path.normpath(target) == os.path.normpath(source):
        raise ValueError("a tag is needed to keep the new version apart")
    return write_by_year(df, target)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path
