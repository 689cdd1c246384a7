"""Queries that lay out whole tables: shards, mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import mixing, sharding
from tradeloom.llm.base import query
from tradeloom.llm.common import Scratch, table

N_SHARDS = 24


def shard_rows(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Shard and slot of every document, with its size and the CRC of its text."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = Scratch(docs.sparkSession, "sizes").write(docs.select("doc_id", sharding.text_size().alias("size"), crc.alias("text_crc32")))
    dealt = sharding.assign_shards(sized, n_shards, ["doc_id", "text_crc32"])
    law, none = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return dealt.select("doc_id", "size", "text_crc32", law, "shard", "slot", none)


def crc_step(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


# The CRC goes through the bytes of a text with the table of its polynomial.
SHARDS_SQL = f"""
    WITH step AS (SELECT {[crc_step(n) for n in range(256)]} AS t),
    b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {sharding.ROW_BYTES} AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) AS bytes FROM documents),
    s AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::bigint AS text_crc32 FROM b, step),
    placed AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM s WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
    dealt AS (SELECT *, least({N_SHARDS - 1}, (2 * before + size)::hugeint * {N_SHARDS} // (2 * total))::int AS shard FROM placed)
    SELECT doc_id, size::bigint AS size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::bigint AS slot, NULL::int AS grown_shard FROM dealt"""


@query("op6_byte_balanced_shards", SHARDS_SQL)
def op6_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


# Decimals of 12 places as whole numbers; rows that agree in the order are alike in all columns.
ONE = 10**12
MIX_SQL = f"""
    WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM documents),
    sizes AS (SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, {list(map(float, mixing.WEIGHTS))}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::int]::double AS weight, source_size::double * {float(mixing.MOST_COPIES)} AS cap FROM sizes),
    ranked AS (SELECT *, row_number() OVER w AS rank, sum(source_size) OVER ()::double - coalesce(sum(cap) OVER earlier, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS rest_weight
      FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST), earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    halted AS (SELECT *, rest / rest_weight AS share, cap <= rest / rest_weight * weight AS stops FROM ranked),
    targets AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE (SELECT arg_min(share, rank) FROM halted WHERE NOT stops) * weight END AS target FROM halted),
    rates AS (SELECT *, CASE WHEN source_size > 0 THEN ((target / source_size)::varchar::decimal(14, 12) * {ONE})::hugeint ELSE 0 END AS rate FROM targets),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS n FROM sized),
    drawn AS (SELECT p.*, source_size, target, (((n + 1) * rate + {int(mixing.offset(1)[2:])}) // {ONE} - (n * rate + {int(mixing.offset(1)[2:])}) // {ONE})::bigint AS copies FROM placed p JOIN rates r ON p.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, size, source, source_size, target, copies, copies * size AS taken FROM drawn"""


@query("op8_mix_sources", MIX_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = Scratch(spark, "words").write(docs.select("doc_id", "source", mixing.word_count().alias("size"), crc.alias("crc")))
    mixed = mixing.count_copies(sized, ["doc_id", "crc"])
    return mixed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
