"""Collocations of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm import phrases
from tradeloom.llm.base import query
from tradeloom.llm.common import table

PHRASES_SQL = rf"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    totals AS (SELECT lang, sum(len(ws))::bigint AS n FROM w GROUP BY lang),
    grams AS (SELECT lang, ws[i : i + k - 1] AS words, array_to_string(ws[i : i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, {phrases.LONGEST + 1}) t(k))),
    known AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
    inside AS (SELECT DISTINCT s.lang, s.phrase FROM known s JOIN (
        SELECT lang, f, len(words) AS m, unnest(flatten(list_transform(range(2, len(words)), lambda k: list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i : i + k - 1], ' '))))) AS part FROM known WHERE len(words) > 2) l
      ON s.lang = l.lang AND s.phrase = l.part WHERE 100 * l.f >= {phrases.SHARE} * s.f),
    cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 :], ' ') AS tail
      FROM (SELECT *, unnest(range(1, len(words))) AS k FROM known WHERE len(words) > 1) WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside)),
    scores AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, k, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint AS score
      FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = head JOIN known y ON y.lang = c.lang AND y.phrase = tail JOIN totals t ON t.lang = c.lang),
    least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::int AS rank, phrase, a, l, r, n, score FROM least
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {phrases.TOP}"""


@query("op13_phrase_collocations", PHRASES_SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = phrases.mine(table(spark, sf_dir, "documents").select("text", "lang"))
    return phrases.best(mined).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
