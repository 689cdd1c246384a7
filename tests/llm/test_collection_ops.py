"""Suffix dedup, n-gram join, components, WARC, top-k search, pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from llm_rows import PASSAGE, SF
from tradeloom.llm import covertree, ngram_join, queries_dedup, queries_pages, queries_search, suffix_dedup, warc
from tradeloom.llm.common import Scratch
from tradeloom.llm.components import components
from tradeloom.llm.words import WordHashes, shingle_set


def brute_classes(rows):
    """(links, class) of each row by comparing all pairs."""
    table = WordHashes()
    sets = [set(shingle_set(t, table).tolist()) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and common >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            members[find(i)].append(d)
    return [(d, min(members[find(i)], default=d) if links[i] else d, links[i]) for i, (d, _) in enumerate(rows)]


def near_copies(n, rng):
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [ngram_join.BLOCK_TEXTS, 7])
def test_join_equals_all_pairs(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 5)
    rng = random.Random(2)
    texts = near_copies(40, rng) + near_copies(3, rng) + [PASSAGE, PASSAGE, "", None, "one", "one", " ".join(f"u{i}" for i in range(500))]
    rows = list(enumerate(texts)) + [(None, PASSAGE), (3, texts[3]), (3, "other text under the same id")]
    got = sorted((tuple(r) for r in ngram_join.links_and_classes(make_docs(rows)).select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == sorted(brute_classes(rows), key=str)


def test_one_of_each_class_stays(odd_docs, no_docs):
    kept = ngram_join.keep_one_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = sorted(((r.doc_id, (r.text or "")[:8]) for r in kept.collect()), key=str)
    assert rows == sorted([(1, PASSAGE[:8]), (None, ""), (3, ""), (4, ""), (5, "word"), (6, "w0 w1 w2"), (7, "é ß 漢字 \U0001f600 "[:8])], key=str)
    assert ngram_join.keep_one_each(no_docs).collect() == [] and ngram_join.links_and_classes(no_docs).collect() == []


def test_join_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries_dedup.op5_ngram_jaccard_join(spark, SF).collect()) == sorted(brute_classes(rows))


def test_pruning_keeps_what_reaches_the_threshold():
    least = ngram_join.least_agreements(0.8, 1e-9)
    assert len(least) == ngram_join.HASHES // ngram_join.STEP and list(least) == sorted(least)
    assert least[-1] / ngram_join.HASHES < 0.65


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i + 7, i) for i in range(0, 90, 3)] + [(5, 88), (200, 201), (201, 200)],
])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in list(root)}


def brute_repeats(rows):
    """Bytes covered by a 100-byte string that starts earlier, by (id, nulls last; start)."""
    first = {}
    bodies = [(1 << 63 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in bodies:
        for p in range(len(b) - 99):
            key = b[p : p + 100]
            first[key] = min(first.get(key, (d, p)), (d, p))
    out = []
    for (d, b), (doc_id, _) in zip(bodies, rows):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (d, p):
                gone[p : p + 100] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def removed(docs):
    rows = suffix_dedup.deduplicate(docs).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize(("chunks", "piece"), [(suffix_dedup.BUCKET_CHUNKS, suffix_dedup.PIECE), (2, 300)])
def test_repeats_equal_brute_force(make_docs, monkeypatch, chunks, piece):
    monkeypatch.setattr(suffix_dedup, "BUCKET_CHUNKS", chunks)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60))) + passage[rng.randrange(40) : rng.randrange(120, 300)] + " ".join(word() for _ in range(20))) for i in range(40)]
    rows += [(100, "ab" * 300), (101, "x" * 99), (102, "x" * 100), (103, "y" * 1000), (104, None), (105, ""), (106, passage), (107, passage), (None, passage)]
    assert removed(make_docs(rows)) == brute_repeats(rows)


def test_repeats_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries_dedup.op2_suffix_dedup(spark, SF).collect()), key=str) == brute_repeats(rows)


def test_rows_that_share_an_id(make_docs, no_docs):
    other = "an other text under the same id, longer than a hundred bytes " * 3
    rows = [(1, PASSAGE), (1, PASSAGE), (1, other)]
    got = {(r[0], r[1], r[2]) for r in removed(make_docs(rows))}
    assert (1, len(PASSAGE), 0) in got and any(n == len(other) for _, n, _ in got)
    assert removed(no_docs) == []


def test_column_wise_order_is_the_suffix_order():
    rng = random.Random(6)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 9))]
        owner, length = suffix_dedup.column_wise_order(texts)
        suffixes = [texts[o][len(texts[o]) - n :] for o, n in zip(owner, length)]
        assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(t) + 1 for t in texts)


def warc_rows():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    return [
        (1, "http://a b\r\nc", "x" * 50), (2, None, None), (3, "u", fake * 4), (4, "u", "y" * 200), (5, "u", "y" * 200), (6, "u", "x" * 50),
        (7, "u", "zz WARC/1. WARC/1.1\r\nContent-Length: 99999\r\n\r\n é" + "q" * 3000 + "WARC/1.1\r\n"), (None, "u", "y" * 200), (4, "u", "y" * 200),
        (8, "u", "é" * 60_000 + "WARC/1.0\r\n\r\n"), (9, "u", "\r\n\r\n"),
    ]


@pytest.mark.parametrize("split, later", [("128m", "128m"), ("3k", "3k"), ("3k", "1k"), ("128m", "2k")])
def test_archives_round_trip(spark, tmp_path, split, later):
    """``later`` is how files are split when the index is collected, as after executors came or went."""
    pages = spark.createDataFrame(warc_rows(), "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest", "3 AS value")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        path = str(tmp_path / "archives")
        warc.write_archives(pages.coalesce(2), path, records_per_file=4)
        index = warc.index_archives(spark, path, with_payload=True)
        spark.conf.set("spark.sql.files.maxPartitionBytes", later)
        rows = index.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    firsts = defaultdict(list)
    for i, _, html in warc_rows():
        firsts[html or ""].append(i)
    want = Counter()
    for i, _, html in warc_rows():
        raw = (html or "").encode()
        first = min(x for x in firsts[html or ""] if x is not None)
        again = len(raw) >= 100 and i != first
        want[str(i), "revisit" if again else "response", f"urn:page:{first}" if again else None, b"" if again else raw, hashlib.sha256(raw).hexdigest(), len(raw)] += 1
    got = Counter((r.record_id.removeprefix("urn:page:").replace("null", "None"), r.record_type, r.refers_to, bytes(r.payload), r.stated_digest, r.stated_bytes) for r in rows)
    assert got == want
    assert all(r.record_type == "revisit" or r.payload_digest == r.stated_digest for r in rows)
    assert {r.target_uri for r in rows} == {"http://a%20b%0D%0Ac", "u", None}


def test_no_archives(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.index_archives(spark, str(tmp_path / "none")).collect() == []


def test_warc_query_returns_every_page(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries_pages.op7_warc_round_trip(spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in rows} == {i: (len(h), hashlib.sha256(h).hexdigest()) for i, h in pages.items()}
    first = {}
    for i, h in sorted(pages.items()):
        first.setdefault(h, i)
    again = {i: len(h) >= warc.LEAST_REVISIT and first[h] != i for i, h in pages.items()}
    assert {r.page_id: (r.record_type, r.refers_to) for r in rows} == {i: ("revisit", first[h]) if again[i] else ("response", None) for i, h in pages.items()}


def brute_top(rows, k, modulo):
    usable = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = []
    for i, v in usable:
        if i % modulo == 0:
            best = sorted((-int(v @ w), j) for j, w in usable if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("PIVOTS", 5), ("CHUNK_ROWS", 40), ("GROUP_ROWS", 3), ("BIN_ROWS", 4), ("LEAF", 3), ("NEAR", 1)):
            monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) / 3).tolist()) for i in range(300)]
    rows += [(i, [0.25] * 6) for i in range(300, 420)]  # ties and one hot vector
    rows += [(500, None), (510, [1.0, None]), (520, [float("nan")] * 6), (530, [float("inf")] * 6), (540, [0.5]), (550, []), (None, [1.0] * 6), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cell", "2 AS x")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in covertree.top_k(df, "vec_id % 10 = 0", 5).collect())
    assert got == brute_top(rows, 5, 10)
    assert covertree.top_k(df.limit(0), "vec_id % 10 = 0").collect() == []


def test_search_query_prunes_nothing_that_counts(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries_search.op10_cover_tree_top_k(spark, SF).collect()) == brute_top(rows, 5, 50)


def test_tree_covers_its_points():
    points = np.random.default_rng(9).normal(size=(400, 5))
    todo = [covertree.tree(points, 10)]
    while todo:
        node = todo.pop()
        assert np.sqrt(((points[node.rows] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            todo += node.children


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for docs in (odd_docs, no_docs):
        at, here = docs, docs.count()
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            path = str(tmp_path / f"{here}-{i}")
            out.write.parquet(path)
            at = spark.read.parquet(path)
        assert {"doc_id", "shard", "slot"} <= set(at.columns)


def test_pipeline_decisions(spark):
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.accept_quality(spark, docs, SF).collect()
    classes = {d: c for d, c, _ in brute_classes([(r.doc_id, r.text) for r in kept])}
    assert got and set(got) <= {d for d, c in classes.items() if d == c} and max(got.values()) <= 3
