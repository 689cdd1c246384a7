"""Jaccard self-join of documents on word shingles with Bayesian pruning of candidates.

Documents with the same set of shingles are one text. Texts that share a MinHash
band are candidates. Candidates are grouped by the connected components of
shared bands, and inside a component pairs are compared a few MinHash values at a
time: after each step a pair is dropped if, given its agreements so far, the
posterior probability that it reaches the threshold is below the tolerance.
Pairs that remain are verified on their exact shingle sets.

A component's texts are dealt into blocks of bounded size, and pairs of blocks
are separate tasks, so a component of any size is spread. Tasks return links per
text and a spanning forest, never the pairs of a group.

Documents without words link to nothing. Null ids and repeated rows are
documents like others; an empty table gives no rows. A document shorter than a
shingle is one shingle of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch, row_key, small_batches, text_key
from tradeloom.llm.components import components
from tradeloom.llm.words import SHINGLE, WordHashes, mixed, shingle_set

THRESHOLD = 0.8
#: A pair just at 0.8 misses all 32 bands of 4 values with probability (1 - 0.8^4)^32, about 5e-8.
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
STEP = 16
TOLERANCE = 1e-9
#: A block of one component, and a bundle of small components, hold about this much.
BLOCK_TEXTS, BLOCK_BYTES = 512, 8_000_000
#: Pairs verified one by one; more are verified by products of incidence matrices.
FEW_PAIRS = 200

SEEDS = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of ``HASHES`` multiply-shift functions of the shingles."""
    factors, shifts = (SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(low), 1024):
        x = low[a : a + 1024, None] * factors + shifts
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(0), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(BAND_ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.astype(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def least_agreements(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: the fewest agreements with which a pair is kept.

    With a uniform prior on the similarity, the posterior after m of n agreements is Beta(m + 1, n - m + 1), and the
    probability that it is at least t is that of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving_pairs(left: np.ndarray, right: np.ndarray, same: bool, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures that pruning keeps; ``same``: both sides are one block, take each pair once."""
    counts = np.zeros((len(left), len(right)), np.int16)
    for h in range(STEP):
        counts += left[:, h, None] == right[None, :, h]
    keep = counts >= least[0]
    if same:
        keep = np.triu(keep, 1)
    i, j = np.nonzero(keep)
    agreed = counts[i, j].astype(np.int32)
    for k, a in enumerate(range(STEP, left.shape[1], STEP), 1):
        agreed = agreed + (left[i, a : a + STEP] == right[j, a : a + STEP]).sum(1)
        kept = agreed >= least[k]
        i, j, agreed = i[kept], j[kept], agreed[kept]
    return i, j


def verified(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's exact similarity reaches the threshold."""
    sizes_l, sizes_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    if len(i) <= FEW_PAIRS:
        common = np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:
        rows_l, rows_r = np.unique(i), np.unique(j)
        values = np.concatenate([*(left[a] for a in rows_l), *(right[b] for b in rows_r)])
        owner = np.repeat(np.arange(len(rows_l) + len(rows_r)), [*sizes_l[rows_l], *sizes_r[rows_r]])
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((len(rows_l), len(rows_r)), np.float32)
        width, last = 4096, int(column[-1]) + 1 if len(column) else 0
        for a in range(0, last, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            has = np.zeros((len(rows_l) + len(rows_r), width), np.float32)
            has[owner[lo:hi], column[lo:hi] - a] = 1
            total += has[: len(rows_l)] @ has[len(rows_l) :].T
        common = total[np.searchsorted(rows_l, i), np.searchsorted(rows_r, j)].astype(np.int64)
    # Compared in whole numbers of shingles; the small term keeps exact ties at the threshold in.
    return common + 1e-9 >= threshold * (sizes_l[i] + sizes_r[j] - common)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each of ``n`` nodes' components."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def describe(docs: DataFrame) -> DataFrame:
    """(row key, text key, doc_id, node, n shingles, bands) of every document; node and bands are null without words."""
    small_batches(docs.sparkSession)
    rows = docs.select(row_key().alias("key"), text_key().alias("text_key"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            nodes, sizes, bands = [], [], []
            for text in batch.column(3).to_pylist():
                s = shingle_set(text, table)
                nodes.append(fingerprint(s) if len(s) else None)
                sizes.append(len(s))
                bands.append(band_keys(minhashes(s)) if len(s) else None)
            columns = [*batch.columns[:3], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "text_key", "doc_id", "node", "n", "bands"]
    return rows.mapInArrow(run, "key long, text_key long, doc_id long, node binary, n long, bands array<long>")


def candidate_groups(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): components of texts that share a band, of two texts or more."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    # A band's least text leads it; bands with one text say nothing.
    leaders = scratch.write(rows.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("other")).filter("leader != other").select("band", "leader"))
    edges = rows.join(leaders, "band").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    found = components(edges, scratch)
    scratch.drop(leaders)
    return found


def shingle_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Shingle sets and signatures of ``members`` (key, text_key, node, ...), read from the texts again."""
    rows = docs.select(row_key().alias("key"), text_key().alias("text_key"), "text").join(members, ["key", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = WordHashes(), set()
        for batch in batches:
            keep, sets, signatures = [], [], []
            for at, (text, node) in enumerate(zip(batch.column("text").to_pylist(), batch.column("node").to_pylist())):
                if node in seen:  # the same row again
                    continue
                s = shingle_set(text, table)
                if fingerprint(s) == node:
                    seen.add(node)
                    keep.append(at)
                    sets.append(s.tobytes())
                    signatures.append(minhashes(s).tobytes())
            if keep:
                kept = batch.take(pa.array(keep))
                columns = [kept.column(c) for c in ("node", "root", "blocks", "block", "copies")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary()), pa.array(signatures, pa.binary())], names)

    names = ["node", "root", "blocks", "block", "copies", "shingles", "signature"]
    return rows.mapInArrow(run, "node binary, root binary, blocks long, block long, copies long, shingles binary, signature binary")


def compare_group(rows: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame:
    """Links and labels of the texts in one task: a pair of blocks, or several whole components."""
    least = least_agreements(threshold, tolerance)
    out = []
    for _, part in rows.groupby(["root", "first", "second"], sort=False):
        part = part.drop_duplicates("node").sort_values("node", ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in part["shingles"]]
        signatures = np.stack([np.frombuffer(b, np.uint32) for b in part["signature"]])
        block, first, second = part["block"].to_numpy(), part["first"].iloc[0], part["second"].iloc[0]
        l = np.flatnonzero(block == first)
        r = l if first == second else np.flatnonzero(block == second)
        i, j = surviving_pairs(signatures[l], signatures[r], first == second, least)
        good = verified([sets[a] for a in l], [sets[a] for a in r], i, j, threshold)
        i, j = l[i[good]], r[j[good]]
        copies = part["copies"].to_numpy()
        links = np.bincount(i, copies[j], len(part)) + np.bincount(j, copies[i], len(part))
        nodes = part["node"].to_numpy()
        label = nodes[forest(len(part), i, j)]
        linked = links > 0
        out.append(pd.DataFrame({"node": nodes[linked], "label": label[linked], "links": links[linked].astype(np.int64)}))
    return pd.concat(out, ignore_index=True)


def links_and_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, text_key, doc_id, root, class_id, n_links) of every row of ``docs`` (doc_id, text).

    ``root`` names the class also where all its ids are null; it is null for documents without words.
    ``n_links`` counts the other rows, copies included, whose similarity reaches the threshold; ``class_id`` is the least
    doc_id connected to the row by links, or its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    described = scratch.write(describe(docs))
    with_words = described.filter("node is not null")
    # One row per distinct text: its first row to fetch it by, its copies, its least id.
    first = F.min(F.struct("key", "text_key"))
    nodes = scratch.write(with_words.groupBy("node").agg(first.alias("at"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    groups = candidate_groups(nodes.select("node", "bands"), scratch)
    # The bands are as large as all the rest and have done their work.
    fat = [described, nodes]
    described = scratch.write(described.select("key", "text_key", "doc_id", "node"))
    nodes = scratch.write(nodes.drop("bands"))
    scratch.drop(*fat)
    scratch.settle()

    sizes = groups.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES))
    sizes = scratch.write(sizes.select("root", "texts", "shingles", blocks.alias("blocks")))
    small = sizes.filter("blocks = 1").agg(F.sum("shingles"), F.sum("texts")).first()
    bundles = max(1, -(-(small[0] or 0) * 8 // BLOCK_BYTES), -(-(small[1] or 0) // BLOCK_TEXTS))

    members = groups.join(sizes.select("root", "blocks"), "root").join(nodes.select("node", "at", "copies"), "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select("at.key", "at.text_key", "node", "root", "blocks", "block", "copies")
    members = scratch.write(members)
    texts = scratch.write(shingle_rows(docs, members))
    scratch.drop(members, sizes)
    scratch.settle()

    # A block meets every block of its component once: block b goes to the pairs (b, i) and (i, b).
    paired = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("other")
    bundle = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(-1)
    task_root = F.when(F.col("blocks") > 1, F.col("root"))
    paired = paired.withColumns({"bundle": bundle, "task_root": task_root})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return compare_group(rows, threshold, tolerance)

    linked = scratch.write(paired.groupBy("bundle", "task_root", "first", "second").applyInPandas(compare, "node binary, label binary, links long"))
    scratch.drop(texts)
    scratch.settle()
    totals = linked.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(linked.select(F.col("node").alias("a"), F.col("label").alias("b")), scratch)
    facts = nodes.select("node", "copies", "least_id").join(labels, "node", "left").join(totals, "node", "left")
    facts = scratch.write(facts.select("node", "copies", "least_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    classes = scratch.write(facts.groupBy("root").agg(F.min("least_id").alias("class_id")))
    facts = scratch.write(facts.join(classes, "root").select("node", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    out = described.join(facts, "node", "left")
    result = scratch.write(out.select("key", "text_key", "doc_id", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    scratch.drop(described, nodes, linked, facts)
    scratch.settle()
    return result


def keep_one_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of each class, that with the least (id, text hash). Of documents without words, one of each id stays."""
    scratch = Scratch(docs.sparkSession, "ngram")
    classes = links_and_classes(docs.select("doc_id", "text"), threshold, tolerance)
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "key", "text_key")  # rows with an id first
    alone = F.when(F.col("root").isNull(), at)
    kept = scratch.write(classes.groupBy("root", alone.alias("alone")).agg(F.min(at).alias("at")).select("at.key", "at.text_key"))
    keyed = docs.withColumns({"__key": row_key(), "__text": text_key()})
    chosen = keyed.join(kept.select(F.col("key").alias("__key"), F.col("text_key").alias("__text")), ["__key", "__text"], "left_semi")
    return chosen.dropDuplicates(["__key", "__text"]).select(*docs.columns)
