"""Queries that judge documents: quality, benchmark passages, license notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import decontaminate, licenses, quality
from tradeloom.llm.base import query
from tradeloom.llm.common import table

ACCEPT = 0.3


@query("op4_quality_scores")
def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, net)
    predicted = (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    return scored.select("doc_id", (~quality.in_training()).alias("held_out"), "score", predicted)


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))
