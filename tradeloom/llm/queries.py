"""All queries of this package, and the pipeline."""

import corpus_pipeline
from tradeloom.llm import queries_codes, queries_dedup, queries_layout, queries_pages, queries_phrases, queries_quality, queries_search  # noqa: F401
from tradeloom.llm.base import REGISTRY

REGISTRY["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
