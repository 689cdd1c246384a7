"""Exact nearest neighbours of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm import covertree
from tradeloom.llm.base import query
from tradeloom.llm.common import table

TOP = 5

TOP_SQL = f"""
    WITH q AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint AS score
        FROM (SELECT * FROM q WHERE vec_id % 50 = 0) a JOIN q b ON a.vec_id <> b.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""


@query("op10_cover_tree_top_k", TOP_SQL)
def op10_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", TOP)
