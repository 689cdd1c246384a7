"""Sharding and mixing."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from llm_rows import SF
from tradeloom.llm import mixing, queries_layout, sharding


def test_shards_are_contiguous_and_equal(spark):
    rows = queries_layout.op6_byte_balanced_shards(spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    per_shard, by_shard = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        per_shard[r.shard] += r.size
        by_shard[r.shard].append(r.slot)
    order = [r.shard for r in sorted(rows, key=lambda r: r.doc_id)]
    assert order == sorted(order)
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    share, most = sum(per_shard.values()) / 24, max(r.size for r in rows)
    assert all(abs(b - share) <= most for b in per_shard.values())


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = queries_layout.shard_rows(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r["size"] for r in rows if r.doc_id is None) == [8, 8 + len(odd_docs.filter("doc_id = 1").first().text)]
    assert queries_layout.shard_rows(no_docs, 3).collect() == []
    with pytest.raises(ValueError):
        sharding.assign_shards(no_docs.withColumn("size", no_docs.n_chars), 0, ["doc_id"])


def test_clashing_columns_are_replaced(odd_docs):
    sized = odd_docs.withColumn("size", sharding.text_size())
    out = sharding.assign_shards(sized, 2, ["doc_id"])
    assert Counter(out.columns) == Counter(sized.columns) and {r.shard for r in out.collect()} == {0, 1}


def test_one_row_repeated_very_often(spark):
    df = spark.range(5000).selectExpr("1L AS doc_id", "10L AS size")
    rows = sharding.assign_shards(df, 7, ["doc_id"]).collect()
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == 5000


def test_shards_are_written_whole(spark, tmp_path):
    df = spark.range(200).selectExpr("id AS doc_id", "10L AS size", "repeat('x', 10) AS text")
    sharding.write_shards(sharding.assign_shards(df, 4, ["doc_id"]), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(200)) and back.filter("shard = 0").count() == 50


def water_level(sizes, weights, most):
    """Targets by raising the level again and again, as the rule says it."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total >= most * sizes[n]]
        if not over:
            target |= {n: left * weight[n] / total for n in open_}
            break
        for n in over:
            target[n] = most * sizes[n]
            open_.discard(n)
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5}, {"é": 3, "z": 50, None: 900, "a": 2}, {"a": 10}, {"a": 0, "b": 7},
    {"a": 1, "b": 1, "c": 1, "d": 1, "e": 4000},
])
def test_targets_fill_up_to_the_caps(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = water_level(sizes, mixing.WEIGHTS, mixing.MOST_COPIES)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_mix_reaches_targets_and_agrees_with_itself(spark):
    runs = [sorted(tuple(r) for r in queries_layout.op8_mix_sources(spark, SF).select("doc_id", "size", "taken", "target", "source").collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    taken, target, most = Counter(), {}, Counter()
    for _, size, words, goal, source in runs[0]:
        taken[source] += words
        target[source] = goal
        most[source] = max(most[source], size)
        assert words <= 3 * size
    assert all(abs(taken[s] - target[s]) <= 3 * most[s] for s in target)


def test_mix_of_odd_rows(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs, ["doc_id"])
    assert mixed.columns == odd_docs.columns and 0 < mixed.count() <= 3 * odd_docs.count()
    assert mixing.mix(no_docs, ["doc_id"]).collect() == []


def test_word_count(spark):
    df = spark.createDataFrame([("a b\tc\n\nd",), (" ",), ("",), (None,), ("x y",)], "text string")
    assert [r[0] for r in df.select(mixing.word_count()).collect()] == [4, 0, 0, 0, 1]
