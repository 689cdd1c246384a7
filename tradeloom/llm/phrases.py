"""Phrase collocations by SETM: set-oriented mining with sorted occurrence relations.

Texts are lower-cased (A-Z only), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``.

SETM keeps, for every phrase length, a relation of all occurrences of frequent phrases, sorted by piece and position:

1. tasks number the words of their rows and write the words' relation in blocks of bounded size, one language each.
   Places grow by one within a piece and by more between pieces, so that one number holds piece and position. Words are
   counted per block, then by group over all blocks; occurrences of words that are not frequent leave the
   relation in a semi-join;
2. the relation of length k is merge-joined with itself at adjacent places: a phrase of k+1 words is two
   overlapping phrases of k words, which must both be frequent. The pairs are counted per block, then by group, and the
   relation of length k+1 keeps the occurrences of frequent pairs by a semi-join;
3. this ends at the greatest length, or when no phrase is frequent any more.

Group-count and semi-join share one exchange: a block sends one row per different phrase, the rows of a group meet and
are added up, and those of frequent groups go back to their blocks. So a phrase that stands everywhere has one row
per block, of the several hundred thousand that a block sends. The relation itself moves only by block. A block's words
are bounded, but for one piece that is longer (a piece is never cut). A phrase has an exact id, the least place
where its group was sent from; nothing is hashed. Relations and frequent groups are written before they are read, so a
lost executor costs its tasks only.

Null texts count as empty, null languages as ``und``. Languages or texts without words give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch

LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Words of a block, bytes of a text that are taken at once, and rows of an output batch.
BLOCK_WORDS, SLICE, OUT_ROWS = 1 << 20, 1 << 20, 1 << 16
NO_LANG = "und"

ENDS = frozenset(b".,;:!?\x0a\x0b\x0c\x0d")
PLAIN = bytes(46 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bits of a phrase's number in its block, and of a block's number in its task.
IN_BLOCK, IN_TASK = 32, 12

_BLOCK = "block long, lang string, words array<string>, counts array<long>, ids binary"
_RELATION = "block long, places binary, ids binary, phrases binary"
_PAIRS = "sent long, left long, right long, n long"


class Numbers(dict):
    """Words numbered as they come; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def slices(text: str) -> Iterator[bytes]:
    """A text with its words apart and a point for every end of a piece, cut at such ends into bounded slices."""
    data = text.encode("utf-8", "surrogatepass").translate(PLAIN)
    start = 0
    while start < len(data):
        end = data.find(b".", start + SLICE) if start + SLICE < len(data) else -1
        end = len(data) if end < 0 else end + 1
        yield data[start:end].replace(b".", b" . ") + b" ."
        start = end


class Block:
    def __init__(self) -> None:
        self.numbers, self.ids, self.size = Numbers(), [], 0

    def add(self, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        counts = np.bincount(ids, minlength=len(self.numbers))
        words = [w.decode("utf-8", "surrogatepass") for w in self.numbers]
        columns = [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([words[1:]], pa.list_(pa.string())), pa.array([counts[1:]], pa.list_(pa.int64())), pa.array([packed(ids)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "lang", "words", "counts", "ids"])


def _blocks(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_blocks = TaskContext.get().partitionId() << IN_TASK, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for data in slices(text.as_py()):
                    block = open_blocks.setdefault(lang, Block())
                    block.add(data.split())
                    if block.size >= block_words:
                        yield block.row(number, lang)
                        number += 1
                        del open_blocks[lang]
        for lang, block in open_blocks.items():
            yield block.row(number, lang)
            number += 1

    return run


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 byte by byte, all the lowest bytes first, so that compression finds the zeros of the highest."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _kept(places: np.ndarray, ids: np.ndarray, at: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The occurrences whose number is in ``at``, numbered anew in the order of ``at``."""
    size = int(max(ids.max(initial=0), at.max(initial=0))) + 1
    new = np.full(size, -1, np.int64)
    new[at] = np.arange(len(at))
    ids = new[ids]
    found = ids >= 0
    return places[found], ids[found], phrases


def _relation(block: int, places: np.ndarray, ids: np.ndarray, phrases: np.ndarray) -> pa.Table:
    columns = [[block], [packed(np.diff(places, prepend=0))], [packed(ids)], [phrases.astype(np.int64).tobytes()]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "places", "ids", "phrases"])


def _found(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("at").to_numpy(), table.column("id").to_numpy()


def _frequent_words(block: pa.Table, found: pa.Table) -> pa.Table:
    """Semi-join of a block's words with the frequent ones."""
    at, phrases = _found(found)
    ids = unpacked(block.column("ids")[0].as_py()).astype(np.int64)
    return _relation(block.column("block")[0].as_py(), *_kept(np.arange(len(ids)), ids, at + 1, phrases))


def _adjacent(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a sorted relation with itself at the next place: places, the pairs as one key of two block numbers, and the block's phrases."""
    gaps, ids, phrases = unpacked(row["places"]), unpacked(row["ids"]), np.frombuffer(row["phrases"], np.int64)
    places = np.cumsum(gaps, dtype=np.int64)
    next_to = np.flatnonzero(gaps[1:] == 1)
    keys = ids[next_to].astype(np.int64) * max(len(phrases), 1) + ids[next_to + 1]
    return places[next_to], keys, phrases


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            _, keys, phrases = _adjacent(row)
            keys, counts = np.unique(keys, return_counts=True)
            for s in range(0, len(keys), OUT_ROWS):
                part = keys[s : s + OUT_ROWS]
                left, right = phrases[part // len(phrases)], phrases[part % len(phrases)]
                columns = [(row["block"] << IN_BLOCK) + np.arange(s, s + len(part)), left, right, counts[s : s + OUT_ROWS]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sent", "left", "right", "n"])


def _frequent_pairs(relation: pa.Table, found: pa.Table) -> pa.Table:
    """Semi-join of a block's joined occurrences with the frequent pairs."""
    row, (at, phrases) = relation.to_pylist()[0], _found(found)
    places, keys, _ = _adjacent(row)
    return _relation(row["block"], *_kept(places, np.searchsorted(np.unique(keys), keys), at, phrases))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with ``least`` occurrences or more (lang, words, f), and the words of each language (lang, n)."""
    work = Scratch(docs.sparkSession, "phrases")
    given = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = work.write(given.mapInArrow(_blocks(block_words), _BLOCK))
    totals = work.write(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).filter("n > 0"))
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    words = words.select((F.shiftleft("block", IN_BLOCK) + F.col("at")).alias("sent"), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    marked = work.write(_frequent(words, ["lang", "word"], least))
    work.settle()
    levels = [work.write(marked.filter("sent = id").select("id", "lang", F.array("word").alias("words"), "f"))]
    relation = work.write(_by_block(blocks.select("block", "ids"), marked, _frequent_words)) if longest > 1 else None
    work.drop(blocks, marked)
    work.settle()
    for length in range(2, longest + 1):
        marked = work.write(_frequent(relation.mapInArrow(_pairs, _PAIRS), ["left", "right"], least))
        work.settle()
        before = levels[-1]
        left = before.select(F.col("id").alias("left"), "lang", "words")
        right = before.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"))
        found = marked.filter("sent = id").join(left, "left").join(right, "right")
        levels.append(work.write(found.select("id", "lang", F.array_append("words", F.col("last")).alias("words"), "f")))
        old = [relation, marked]
        if length < longest:
            relation = work.write(_by_block(relation, marked, _frequent_pairs))
        work.drop(*old)
        work.settle()
    if longest > 1 and length < longest:
        work.drop(relation)
    return reduce(DataFrame.unionAll, [level.select("lang", "words", "f") for level in levels]), totals


def _frequent(sent: DataFrame, group: list[str], least: int) -> DataFrame:
    """The rows (sent, group, n) of groups that add up to ``least`` or more, with the sum ``f`` and the group's ``id``."""
    whole = Window.partitionBy(*group)
    return sent.withColumns({"f": F.sum("n").over(whole), "id": F.min("sent").over(whole)}).filter(F.col("f") >= least).drop("n")


def _by_block(relation: DataFrame, marked: DataFrame, semi_join) -> DataFrame:
    found = marked.select(F.shiftright("sent", IN_BLOCK).alias("of"), F.col("sent").bitwiseAND((1 << IN_BLOCK) - 1).alias("at"), "id")
    return relation.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_where_found(semi_join), _RELATION)


def _where_found(semi_join):
    def run(relation: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows:
            empty = np.zeros(0)
            return _relation(0, empty, empty, empty).slice(0, 0)
        return semi_join(relation, found)

    return run


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(phrases: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates (two words or more) that are no part of an equally frequent longer one: lang, phrase, a, l, r, n, score, cut.

    The score is the least ``floor(1000 * a * n / (l * r))`` over all cuts, exact in decimals; ties go to the first cut.
    """
    known = phrases.select("lang", _joined(F.col("words")).alias("phrase"), "words", "f")
    candidates = known.filter(F.size("words") > 1).withColumnRenamed("f", "a")
    size = F.size("words")
    inner = F.expr("flatten(transform(sequence(2, greatest(size(words) - 1, 2)), k -> transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))")
    parts = candidates.filter(size > 2).select("lang", F.explode(inner).alias("part"), "a").groupBy("lang", _joined(F.col("part")).alias("phrase")).agg(F.max("a").alias("longer"))
    whole = candidates.join(parts, ["lang", "phrase"], "left").filter(~F.coalesce(100 * F.col("longer") >= share * F.col("a"), F.lit(False))).drop("longer")
    cut = whole.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.select("lang", "phrase", "a", "cut", _joined(F.slice("words", F.lit(1), F.col("cut"))).alias("first"), _joined(F.slice("words", F.col("cut") + 1, size - F.col("cut"))).alias("rest"))
    side = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(1000BD * cast(a AS decimal(17, 0)) * cast(n AS decimal(17, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    cut = cut.withColumn("score", score.cast("long"))
    least = F.min_by(F.struct("cut", "l", "r", "score"), F.struct("score", "cut")).alias("c")
    return cut.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score", "c.cut")


def best(collocations: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language: by score, then frequency, then in the order of UTF-8 bytes."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return collocations.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All collocations of ``docs`` (text, lang), see :func:`scored`."""
    phrases, totals = frequent_phrases(docs, longest, least, block_words)
    return scored(phrases, totals, share)
