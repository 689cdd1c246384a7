"""Queries over raw web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import main_text, warc
from tradeloom.llm.base import query
from tradeloom.llm.common import table
from tradeloom.session import fresh_path


def page_number(column: str) -> Column:
    return F.regexp_extract(F.col(column), r"^urn:page:(-?\d+)$", 1).try_cast("long")


WARC_SQL = rf"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
    f AS (SELECT *, CASE WHEN n >= {warc.LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM p)
    SELECT page_id, nullif(replace(replace(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), ' ', '%20'), chr(9), '%09'), '') AS url, n::bigint AS payload_bytes, sha256(body) AS payload_digest,
      CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""


@query("op7_warc_round_trip", WARC_SQL)
def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    index = warc.index_archives(spark, path)
    revisit = F.col("record_type") == "revisit"
    return index.select(
        page_number("record_id").alias("page_id"), F.col("target_uri").alias("url"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page_number("refers_to").alias("refers_to"),
    )


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
