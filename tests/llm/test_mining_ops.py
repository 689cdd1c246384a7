"""Exact dedup, vector codes and phrase mining against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from llm_rows import PASSAGE, SF

from tradeloom.llm import grace_dedup, phrases, queries_codes, queries_dedup, queries_phrases, vector_codes

# Exact dedup


def brute_equal(rows):
    """(doc_id, keep_id, group_size, digest) of each row, and how many rows of each group stay."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(d)
    out = []
    for body, ids in groups.items():
        least = min((d for d in ids if d is not None), default=None)
        out += [(d, least, len(ids), hashlib.sha256(body.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str), Counter(o[3] for o in out)


def check_equal(docs, rows, **options):
    got = grace_dedup.deduplicate(docs, **options).collect()
    want, groups = brute_equal(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter(groups.keys()) and all(r.doc_id == r.keep_id for r in kept)


SPACED = [
    (9, "a b"), (4, "a \t b"), (7, "a\x0b\x0cb"), (3, " a b"), (8, "a b "), (5, "a\xa0b"), (6, "a\x1cb"), (2, ""), (1, None), (0, "  "), (10, " "),
    (11, PASSAGE), (11, PASSAGE), (None, PASSAGE), (None, "only without id"), (None, "only without id"), (12, "x " * 40_000), (13, "x\n" * 40_000),
]


@pytest.mark.parametrize("table_bytes, hot", [(grace_dedup.TABLE_BYTES, grace_dedup.HOT), (400, 4096), (400, 3), (1 << 20, 2)])
def test_dedup_equals_brute_force_at_every_table_size(spark, make_docs, table_bytes, hot):
    rng = random.Random(3)
    rows = SPACED + [(100 + i, f"text {rng.randrange(30)} of  many") for i in range(200)] + [(400 + i, "one hot text") for i in range(60)]
    check_equal(make_docs(rows).repartition(7), rows, table_bytes=table_bytes, hot=hot)


def test_texts_with_equal_hashes_stay_apart(spark, make_docs, monkeypatch):
    monkeypatch.setattr(grace_dedup, "content_hash", lambda body: 1)
    rows = [(i, f"text {i % 5}") for i in range(40)]
    check_equal(make_docs(rows).repartition(5), rows, table_bytes=700)


def test_dedup_of_odd_and_empty_tables(odd_docs, no_docs):
    check_equal(odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert grace_dedup.deduplicate(no_docs).collect() == []
    assert {(r.doc_id, r.text[:3]) for r in grace_dedup.kept_texts(odd_docs).collect()} >= {(1, "one"), (3, ""), (5, "wor")}


def test_dedup_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries_dedup.op11_grace_dedup(spark, SF).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_equal(rows)[0]
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


# Vector codes

VECTORS = "vec_id long, embedding array<double>, label int, error int, code string"


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes by id, and the codebooks, with Python integers and every distance evaluated."""
    from fractions import Fraction
    from math import floor, isfinite

    fine = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in fine), default=0) // parts)
    cut = [[[floor(Fraction(x) * scale) for x in (list(v) + [0.0] * (parts * width))[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in fine]
    order = sorted(range(len(fine)), key=lambda k: (fine[k][0] is None, fine[k][0] or 0, fine[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[nearest(c[p], books[p])[1]].append(c[p])
            for e, xs in mine.items():
                books[p][e] = [sum(column) // len(xs) for column in zip(*xs)]
    out = []
    for (i, _, label), c in zip(fine, cut):
        found = [nearest(x, book) for x, book in zip(c, books)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return sorted(out, key=str), books


def check_codes(spark, rows):
    docs = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], VECTORS)
    made = vector_codes.encode(docs)
    want, books = brute_codes(rows)
    got = sorted(((r.vec_id, r.label, r.code, r.error) for r in made.coded.collect()), key=str)
    assert got == [(i, label, code, e if e < 2**63 else None) for i, label, code, e in want]
    assert made.codebooks == books
    by_label = Counter()
    for _, label, _, e in want:
        by_label[label] += e
    assert all(r.label_error == (by_label[r.label] if by_label[r.label] < 2**63 else None) for r in vector_codes.label_errors(made.coded).collect())
    return made


def test_codes_equal_brute_force_and_skip_distances(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    rows = [(int(i), (centres[i % 20] + rng.normal(size=64) / 50).tolist(), int(i % 4) if i % 7 else None) for i in range(300)]
    made = check_codes(spark, rows)
    assert made.evaluated[0] < 0.5 * 300 * 8 * 16


@pytest.mark.parametrize("rows", [
    [], [(1, None, 0), (2, [], 0)], [(1, [0.5] * 16, 0), (1, [0.5] * 16, 0), (None, [0.25] * 16, None)],
    [(i, [0.0, -0.0, 1e-9, -1e-9] * 4, 1) for i in range(30)],
    [(i, [float(i % 3)] * (3 + i % 11), i % 2) for i in range(40)] + [(50, [None, 1.0], 0), (51, [float("nan")] * 8, 0), (52, [float("-inf")] * 8, 0)],
    [(i, [1e30 * (i % 5), -3.4e38, 0.1 * i, 2.0**60 + i] * 4, 0) for i in range(40)],
])
def test_codes_of_odd_tables(spark, rows):
    check_codes(spark, rows)


def test_codes_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, books = brute_codes(rows)
    got = queries_codes.op12_vector_codes(spark, SF).collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=str) == sorted(((i, c, e) for i, _, c, e in want), key=str)
    text = ",".join(str(x) for p in books for e in p for x in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


# Phrases


def brute_phrases(rows, least, share=100, longest=5):
    """{(lang, phrase): (a, l, r, n, score)} of the candidates that stay."""
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for i in range(len(words)):
                for j in range(i + 1, min(i + longest, len(words)) + 1):
                    f["und" if lang is None else lang, tuple(words[i:j])] += 1
    cands = {k for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = set()
    for lang, w in cands:
        for i, j in combinations(range(len(w) + 1), 2):
            if 1 < j - i < len(w) and 100 * f[lang, w] >= share * f[lang, w[i:j]]:
                inside.add((lang, w[i:j]))
    out = {}
    for lang, w in cands - inside:
        a = f[lang, w]
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang, " ".join(w)] = (a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)
    return out


def mined(docs, **options):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in phrases.mine(docs, **options).collect()}


@pytest.mark.parametrize("share, block_words", [(100, phrases.BLOCK_WORDS), (60, 17)])
def test_phrases_equal_brute_force(spark, share, block_words, monkeypatch):
    rng = random.Random(1)
    vocabulary = ["The", "the", "of", "a", "é", "ä-b", "x\x00y", "Z", "deep", "blue", "sea"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\t", "\n", " "]) for _ in range(60)) for _ in range(80)]
    rows = [(t, rng.choice(["en", "de", None, "und", ""])) for t in texts] + [("the deep blue sea is wide " * 30, "en"), ("a a a a a a a", "de"), (None, "en"), ("", None), (". . !", "fr")]
    docs = spark.createDataFrame([(t, g, 1, 2, "q", 3) for t, g in rows], "text string, lang string, at long, block long, phrase string, n long").repartition(3)
    got = mined(docs, least=4, share=share, block_words=block_words)
    assert got == brute_phrases(rows, 4, share) and len(got) > 50


def test_long_texts_are_cut_between_pieces_only(spark, monkeypatch):
    text = ("one two three four. " * 3 + "five six seven ") * 200
    assert b"".join(phrases.slices(text)).split(b".") != []
    whole = list(phrases.slices(text))
    small = phrases.SLICE
    try:
        phrases.SLICE = 50
        parts = list(phrases.slices(text))
    finally:
        phrases.SLICE = small
    pieces = lambda found: [p.split() for d in found for p in d.split(b".") if p.split()]
    assert len(parts) > 100 and pieces(parts) == pieces(whole)
    docs = spark.createDataFrame([(text, "en"), ("word " * 100_000, "en")], "text string, lang string")
    assert mined(docs, least=100) == brute_phrases([(text, "en"), ("word " * 100_000, "en")], 100)


def test_phrases_of_empty_tables_and_ranks(spark, no_docs, make_docs):
    assert phrases.mine(no_docs).collect() == []
    assert phrases.mine(make_docs([(1, None), (2, ""), (3, "rare words only")])).collect() == []
    docs = make_docs([(1, "b a. c a. d a. " * 5)])
    ranked = phrases.best(phrases.mine(docs, least=2), 2).orderBy("rank").collect()
    assert [(r.rank, r.phrase) for r in ranked] == [(1, "b a"), (2, "c a")]


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    known = spark.createDataFrame([("en", ["a"], big), ("en", ["b"], big + 7), ("en", ["a", "b"], big - 1)], "lang string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 10**14 + 3)], "lang string, n long")
    (row,) = phrases.scored(known, totals).collect()
    assert row.score == 1000 * (big - 1) * (10**14 + 3) // (big * (big + 7))


def test_phrases_query_equals_brute_force(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_phrases(rows, 100)
    got = queries_phrases.op13_phrase_collocations(spark, SF).collect()
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in got} == want
