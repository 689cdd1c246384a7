"""Benchmark items inside documents, found by greedy string tiling.

Words of documents that start a run of five words of some item are seeds; they
pair documents with items. For each pair, running Karp-Rabin matching finds equal
word runs of falling length, and the longest that do not overlap are marked as
tiles in both texts. An item whose tiles cover the threshold share of its words
is in the document, also if its sentences were put in another order; so is an
item of which the document holds a stated number of words in a row, whatever
their share.

The items are a stated query set: they are read in blocks of bounded bytes, and
every block meets all documents in one scan without a shuffle. Items without
words are in no document; an item shorter than five words must occur whole. Null
texts have no words; repeated documents are separate rows, repeated items count
once. Empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tradeloom.llm.common import nullable, small_batches
from tradeloom.llm.words import words

LEAST_TILE = 5
COVERAGE = 0.6
#: An item with one tile of so many words is leaked, however long it is.
LEAKED_RUN = 50
#: Bytes of item text that one scan of the documents carries along.
BLOCK_BYTES = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Numbers of the items' words; any other word is 0."""

    def __missing__(self, word: str) -> int:
        return 0


class RunningHash:
    """Karp-Rabin hashes of the windows of any length over one sequence, modulo 2^64."""

    def __init__(self, ids: np.ndarray) -> None:
        self.powers = np.cumprod(np.full(len(ids) + 1, BASE)) * np.uint64(pow(int(BASE), -1, 2**64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * self.powers[:-1] if len(ids) else ids.astype(np.uint64))])

    def windows(self, k: int, top: int) -> np.ndarray:
        """Hash of every window of ``k``, brought to the common power ``top``."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        lift = power_run(top)[::-1][:n]
        return (self.sums[k:] - self.sums[:n]) * lift


def power_run(top: int) -> np.ndarray:
    out = np.full(top + 1, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Items:
    """A block of items with their words as numbers and the seeds that lead to them."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.vocabulary, self.ids, self.least, self.names = Vocabulary(), [], [], []
        self.seeds: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, text in rows:
            tokens = words(text)
            if not tokens:
                continue
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens], np.uint32)
            least, at = min(LEAST_TILE, len(ids)), len(self.ids)
            self.names.append(name)
            self.ids.append(ids)
            self.least.append(least)
            for p in range(len(ids) - least + 1):
                found = self.seeds[least][ids[p : p + least].tobytes()]
                if not found or found[-1] != at:
                    found.append(at)
        self.seeds = {k: dict(v) for k, v in self.seeds.items()}

    def candidates(self, ids: np.ndarray) -> dict[int, list[int]]:
        """Items that share a seed with the document, and the seeds' places in it."""
        out: dict[int, list[int]] = defaultdict(list)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for k, seeds in self.seeds.items():
            for p in np.flatnonzero(known[k:] - known[:-k] == k).tolist():
                for item in seeds.get(ids[p : p + k].tobytes(), ()):
                    out[item].append(p)
        return out

    def leaked(self, text: str | None, coverage: float, run: int) -> list[tuple[int, int, int, float]]:
        """(item, tiles, words matched, share of the item's words) of each item that the text holds."""
        tokens = words(text)
        ids = np.fromiter(map(self.vocabulary.__getitem__, tokens), np.uint32, len(tokens))
        out = []
        for item, places in self.candidates(ids).items():
            near = neighbourhood(ids, np.array(places), self.least[item])
            lengths = tiles(self.ids[item], near, self.least[item])
            share = sum(lengths) / len(self.ids[item])
            if share >= coverage or max(lengths, default=0) >= run:
                out.append((self.names[item], len(lengths), sum(lengths), share))
        return out


def neighbourhood(ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The document's words under seeds; each gap between them becomes one 0, which no item holds."""
    under = np.zeros(len(ids) + 1, np.int64)
    under[np.unique((places[:, None] + np.arange(k)).reshape(-1))] = 1
    keep = under[:-1] | (np.diff(under, prepend=0)[:-1] == -1)
    return np.where(under[:-1] == 1, ids, 0)[keep == 1]


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[int]:
    """Lengths of the tiles, longest first within each search length."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    hash_i, hash_t, top = RunningHash(item), RunningHash(text), max(len(item), len(text))
    length, out = max(least, min(len(item), len(text))), []
    while True:
        matches = maximal(item, text, hash_i.windows(length, top), hash_t.windows(length, top), free_i, free_t, length)
        longest = max((m[0] for m in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        marked = False
        for n, i, t in matches:
            if free_i[i : i + n].all() and free_t[t : t + n].all() and (item[i : i + n] == text[t : t + n]).all():
                free_i[i : i + n] = free_t[t : t + n] = False
                out.append(n)
                marked = True
        if marked:
            continue  # what an overlap has left may still hold a match of this length
        if length == least:
            return out
        length = max(least, length // 2)


def maximal(item: np.ndarray, text: np.ndarray, of_item: np.ndarray, of_text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(length, item start, text start) of maximal equal runs of free words, longest first.

    A run starts where the windows of ``k`` words are equal and the words before them are not, so only such places are
    paired: a word that is repeated over and over gives pairs at the ends of its stretches and not one for every two places.
    """
    open_i, open_t = all_free(free_i, k), all_free(free_t, k)
    i_at, t_at = np.flatnonzero(open_i), np.flatnonzero(open_t)
    if not len(i_at) or not len(t_at):
        return []
    # A place without a free word before it starts a run with any other.
    before_i = np.where((i_at > 0) & free_i[i_at - 1], item[i_at - 1].astype(np.int64) + 2, 0)
    before_t = np.where((t_at > 0) & free_t[t_at - 1], text[t_at - 1].astype(np.int64) + 2, 1)
    _, rank = np.unique(np.concatenate([of_item[i_at], of_text[t_at]]), return_inverse=True)
    span = int(max(before_i.max(), before_t.max())) + 1
    key_i, key_t = rank[: len(i_at)] * span + before_i, rank[len(i_at) :] * span + before_t
    order = np.argsort(key_i, kind="stable")
    i_at, key_i = i_at[order], key_i[order]
    window_i, window_t = key_i // span, key_t // span
    parts = [
        (np.searchsorted(window_i, window_t, "left"), np.searchsorted(key_i, key_t, "left")),
        (np.searchsorted(key_i, key_t, "right"), np.searchsorted(window_i, window_t, "right")),
    ]
    t = np.concatenate([np.repeat(t_at, high - low) for low, high in parts])
    i = i_at[np.concatenate([np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low) for low, high in parts])]
    length = extended(item, text, of_item, of_text, (open_i, open_t), (free_i, free_t), i, t, k)
    found = zip(length.tolist(), i.tolist(), t.tolist())
    return sorted(found, key=lambda m: (-m[0], m[1], m[2]))


def extended(item: np.ndarray, text: np.ndarray, of_item: np.ndarray, of_text: np.ndarray, windows: tuple, words_: tuple, i: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    """Length of the runs that start with equal windows at ``i`` and ``t``: window by window, then word by word."""
    length = np.full(len(i), k)
    for step, (free_i, free_t), (a, b) in ((k, windows, (of_item, of_text)), (1, words_, (item, text))):
        live = np.arange(len(i))
        while len(live):
            x, y = i[live] + length[live], t[live] + length[live]
            inside = (x < len(free_i)) & (y < len(free_t))
            live, x, y = live[inside], x[inside], y[inside]
            same = free_i[x] & free_t[y] & (a[x] == b[y])
            live = live[same]
            length[live] += step
    return length


def all_free(free: np.ndarray, k: int) -> np.ndarray:
    if len(free) < k:
        return np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(free)])
    return total[k:] - total[:-k] == k


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The items in broadcast blocks of bounded text."""
    spark, rows, size = items.sparkSession, [], 0
    for row in items.select("item_id", "text").filter("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        rows.append((row.item_id, row.text))
        size += len(row.text.encode())
        if size >= block_bytes:
            yield spark.sparkContext.broadcast(rows)
            rows, size = [], 0
    yield spark.sparkContext.broadcast(rows)


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, run: int = LEAKED_RUN) -> DataFrame:
    """(doc_id, item_id, tiles, matched_words, coverage) of every document that holds an item, once per row and item."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "item_id", "tiles", "matched_words", "coverage"]
    schema = "doc_id long, item_id long, tiles int, matched_words int, coverage double"
    parts = []
    for block in item_blocks(items, block_bytes):

        def find(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            found = Items(block.value)
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(*(c.to_pylist() for c in batch.columns)) for hit in found.leaked(text, coverage, run)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names)

        parts.append(docs.select("doc_id", "text").mapInArrow(find, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, run: int = LEAKED_RUN) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index("text"), nullable(docs.schema)
    for block in item_blocks(items, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            found = Items(block.value)
            for batch in batches:
                keep = [not found.leaked(text, coverage, run) for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs
