"""Helpers shared by the operators: tables, shared scratch files, row identity."""

from __future__ import annotations

import gc
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.session import fresh_path

#: Rows per Arrow batch sent to Python. Texts may be long, so batches hold few rows.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Scratch:
    """Tables written to the shared folder, each dropped once nothing reads it.

    Writing cuts the lineage in a way that survives lost executors.
    """

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.tag = spark, tag
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, self.tag)
        df.write.parquet(path)
        out = self.spark.read.schema(nullable(df.schema)).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *written: DataFrame) -> None:
        for df in written:
            remove(self.spark, self.paths.pop(id(df)))

    def settle(self) -> None:
        """Let Spark delete the shuffle files of finished steps: it does so when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def text_key() -> Column:
    """64 bits of a text; with ``row_key`` it tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def row_key(id_column: str = "doc_id") -> Column:
    """The id, or the text's hash where the id is null, so that no row is lost in a join."""
    return F.coalesce(F.col(id_column).cast("long"), text_key())


def arrow_rows(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterable[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))
