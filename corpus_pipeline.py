"""Documents made ready for training: five stages, each written and read again as the next one's input.

Every stage handles null and empty texts, null ids, repeated rows, empty tables
and extra columns; how is stated with the operator it calls. All but the last
return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import decontaminate, mixing, ngram_join, quality
from tradeloom.llm.common import Scratch, table, text_key
from tradeloom.llm.queries_layout import shard_rows
from tradeloom.llm.queries_quality import ACCEPT

SCORE = "__quality"


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    net = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, net, SCORE).filter(F.col(SCORE) >= ACCEPT).drop(SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.keep_one_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights."""
    hashed = docs.withColumn("__hash", text_key())
    return mixing.mix(hashed, ["doc_id", "__hash"]).drop("__hash")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every remaining document."""
    return shard_rows(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix_sources),
    ("sharding", shard),
]

#: The classifier, the tiling and the similarity classes cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    spent = []
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(*spent)  # what the stage before wrote, now read to the end
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
