from __future__ import annotations

import pytest
from llm_rows import PASSAGE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names operators use too."""
    def make(rows):
        full = [(i, t, "en", s[0] if s else "src0", None if t is None else len(t)) for i, t, *s in rows]
        df = spark.createDataFrame(full, DOCS)
        clash = "0L AS shard, 0L AS slot, 'x' AS score, 1.5D AS size_, 'k' AS key, 2 AS copies, 'n' AS node, 'b' AS body, 9 AS target"
        return df.selectExpr("*", *[c.strip() for c in clash.split(",")])

    return make


@pytest.fixture
def odd_docs(make_docs):
    """Null id, null text, empty text, a repeated row, a very long text, a null source."""
    return make_docs([
        (1, PASSAGE), (1, PASSAGE), (2, PASSAGE + " more"), (None, PASSAGE, None), (None, None), (3, ""), (4, None), (5, "word"),
        (6, " ".join(f"w{i}" for i in range(60_000)), "src1"), (7, "é ß 漢字 \U0001f600 " * 30, None),
    ])


@pytest.fixture
def no_docs(make_docs):
    return make_docs([])

