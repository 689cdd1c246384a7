"""Codes of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import vector_codes
from tradeloom.llm.base import query
from tradeloom.llm.common import table

_DISTANCE = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _round(i: int) -> str:
    """Parts with their nearest entry, and the entries moved to their parts' floored means."""
    return f""",
    near{i} AS MATERIALIZED (SELECT row, p, x, min({{'d': {_DISTANCE}, 'e': e}}) AS m FROM parts JOIN book{i} USING (p) GROUP BY ALL),
    mean{i} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM (
      SELECT p, m.e AS e, i, sum(v)::bigint AS s, count(*) AS n FROM (SELECT p, m, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{i}) GROUP BY ALL) GROUP BY ALL),
    book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON b.p = m.p AND b.e = m.e)"""


CODES_SQL = rf"""
    WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::double)::bigint) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT row, p, v[p * (len(v) // {vector_codes.PARTS}) + 1 : (p + 1) * (len(v) // {vector_codes.PARTS})] AS x FROM kept, range({vector_codes.PARTS}) t(p)),
    book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS c FROM parts WHERE row <= {vector_codes.ENTRIES}){''.join(map(_round, range(vector_codes.ROUNDS)))},
    final AS (SELECT row, p, min({{'d': {_DISTANCE}, 'e': e}}) AS m FROM parts JOIN book{vector_codes.ROUNDS} USING (p) GROUP BY row, p),
    coded AS (SELECT row, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' ORDER BY p) AS code, sum(m.d)::bigint AS error FROM final GROUP BY row)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
      (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{vector_codes.ROUNDS}) AS codebooks_sha256
    FROM coded JOIN kept USING (row)"""


@query("op12_vector_codes", CODES_SQL)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.books_digest(made.codebooks)).alias("codebooks_sha256")
    return vector_codes.label_errors(made.coded).select("vec_id", "code", "error", "label_error", digest)
