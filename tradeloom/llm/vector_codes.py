"""Product codes of vectors: exact integer codebooks, with LAESA pivots to skip distance evaluations.

A component ``x`` becomes the integer ``floor(SCALE * x)`` and a vector is cut into ``PARTS`` equal consecutive parts.
Every part position has a codebook of ``ENTRIES`` integer entries, which starts as that part of the vectors with the
least ids. A round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and
replaces an entry by the componentwise floor of its parts' mean; an entry without parts stays.

LAESA: a few of the starting entries are fixed as pivots. The distances of all parts to them are computed once and
stored beside the parts. A round computes only the few distances from entries to pivots; the largest difference
``|d(part, pivot) - d(entry, pivot)|`` is a lower bound on ``d(part, entry)``. Entries are taken in the order of
their bounds, the integer distance is evaluated exactly, and a part is done when the next bound exceeds the best distance.

Tasks read the stored parts and return sums and counts per entry, which Spark adds up: the driver sees
``PARTS * ENTRIES`` rows a round whatever the input. All arithmetic is exact: doubles hold the integers while squared
distances stay below 2**53, and Python integers take over for larger components.

Vectors that are null or hold null or non-finite components take no part. Vectors of different lengths are
extended by zeros to the length of the longest, rounded up to a multiple of ``PARTS``. Null ids come last among the
starting vectors, equal ids are ordered by their components; with fewer than ``ENTRIES`` vectors the codebooks are that
short. An error beyond 64 bits is NULL. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
#: Largest squared distance that doubles add up exactly, rows worked on together, and groups that meet before the last sum.
EXACT, ROWS, GROUPS = 2.0**53, 4096, 32
#: Relative room for the rounding of distances in a bound.
SLACK = 1e-9

_SUMS = "part int, entry int, n long, evaluated long, sums array<string>"


@dataclass
class Codes:
    """The coded vectors, the final codebooks by part and entry, and the distances evaluated per round."""

    coded: DataFrame
    codebooks: list[list[list[int]]]
    evaluated: list[int] = field(default_factory=list)


def usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles where these are exact, else as Python integers."""
    if not x.size or np.abs(x).max() * scale < 2.0**52:
        return np.floor(x * scale)
    whole = np.frompyfunc(lambda v: int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)), 1, 1)
    return whole(x)


def exact(width: int, *arrays: np.ndarray) -> bool:
    """Whether squared distances between rows of these arrays are exact in doubles."""
    if any(a.dtype == object for a in arrays):
        return False
    most = sum(float(np.abs(a).max()) if a.size else 0.0 for a in arrays)
    return width * most * most < EXACT


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact: as doubles or as Python integers."""
    if not exact(a.shape[-1], a, b):
        whole = np.frompyfunc(int, 1, 1)
        a, b = (x if x.dtype == object else whole(x) for x in (a, b))
    d = a - b
    return (d * d).sum(-1) if d.shape[-1] else np.zeros(d.shape[:-1])


def as_float(d: np.ndarray) -> np.ndarray:
    """Squared distances as doubles; those beyond 1e300 count as that, which no bound between them exceeds."""
    return d if d.dtype != object else np.minimum(d, 10**300).astype(float)


def roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every row of ``a`` to every row of ``b`` as doubles."""
    return np.sqrt(as_float(squared(a[:, None, :], b[None, :, :])))


def nearest(parts: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, entry_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each part's nearest entry, and the number of distances evaluated."""
    n, k = len(parts), len(book)
    if entry_to_pivots.size:
        bound = np.abs(to_pivots[:, None, :] - entry_to_pivots[None, :, :]).max(2)
        bound = bound - SLACK * (to_pivots.max(1)[:, None] + entry_to_pivots.max(1)[None, :])
    else:
        bound = np.zeros((n, k))
    order = np.argsort(bound, axis=1, kind="stable")
    plain = exact(parts.shape[1], parts, book)
    best = np.full(n, np.inf) if plain else np.full(n, None, dtype=object)
    reach, index, live, evaluated = np.full(n, np.inf), np.full(n, k), np.arange(n), 0
    for step in range(k):
        entry = order[live, step]
        live = live[bound[live, entry] <= reach[live]]
        if not len(live):
            break
        entry = order[live, step]
        d = squared(parts[live], book[entry])
        evaluated += len(live)
        if step:
            closer = (d < best[live]) | ((d == best[live]) & (entry < index[live]))
            closer = closer.astype(bool)
            at, d, entry = live[closer], d[closer], entry[closer]
        else:
            at = live
        best[at], index[at] = d, entry
        reach[at] = np.sqrt(as_float(d)) * (1 + SLACK)
    return index, best, evaluated


class Books:
    """Codebooks by part position, their pivots, and the entries' distances to them."""

    def __init__(self, entries: list[np.ndarray], pivots: list[np.ndarray]) -> None:
        self.entries, self.pivots = entries, pivots
        self.to_pivots = [roots(e, p) for e, p in zip(entries, pivots)]


def spread_out(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries that lie far from each other: the first one, then always the one farthest from those taken."""
    taken = [0]
    while len(taken) < min(count, len(entries)):
        away = roots(entries, entries[taken]).min(1)
        if away.max() <= 0:
            break
        taken.append(int(away.argmax()))
    return entries[taken]


def cut(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as rows of ``width`` doubles."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < ends[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int, parts: int, scale: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Bounded blocks of rows: the batch, its integer parts by position, and the stored distances (part, row, pivot) if there are any."""
    for whole in batches:
        for s in range(0, whole.num_rows, ROWS):
            batch = whole.slice(s, ROWS)
            x = integers(cut(batch.column("embedding"), width), scale)
            stored = None
            if "to_pivots" in batch.schema.names:
                flat = np.frombuffer(b"".join(batch.column("to_pivots").to_pylist()))
                stored = flat.reshape(batch.num_rows, parts, -1).transpose(1, 0, 2)
            yield batch, np.split(x, parts, axis=1), stored


def _with_distances(width: int, parts: int, scale: int, pivots: list[np.ndarray], most: int):
    """Store every part's distances to the pivots of its position; fewer pivots are filled up with zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts, _ in _blocks(batches, width, parts, scale):
            out = np.zeros((batch.num_rows, parts, most))
            for j, (c, p) in enumerate(zip(cuts, pivots)):
                out[:, j, : len(p)] = roots(c, p)
            yield batch.append_column("to_pivots", pa.array([r.tobytes() for r in out], pa.binary()))

    return run


def _assigned(cuts: list[np.ndarray], stored: np.ndarray, books: Books) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    for j, c in enumerate(cuts):
        yield j, *nearest(c, stored[j][:, : len(books.pivots[j])], books.entries[j], books.to_pivots[j])


def _entry_sums(width: int, parts: int, scale: int, books: Books):
    """Count and component sums of the parts assigned to every entry, one row per entry and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, evaluated = {}, {}, {}
        for _, cuts, stored in _blocks(batches, width, parts, scale):
            for j, index, _, asked in _assigned(cuts, stored, books):
                evaluated[j] = evaluated.get(j, 0) + asked
                for e in np.unique(index):
                    mine = cuts[j][index == e]
                    counts[j, e] = counts.get((j, e), 0) + len(mine)
                    # A block has few rows, so its sums stay exact in doubles; totals are Python integers.
                    added = [int(v) for v in (mine if exact(len(mine) * 4, mine) else np.frompyfunc(int, 1, 1)(mine)).sum(0)]
                    sums[j, e] = [a + b for a, b in zip(sums.get((j, e), [0] * len(added)), added)]
        asked = [evaluated.pop(j, 0) for j, _ in counts]
        columns = [
            pa.array([int(j) for j, _ in counts], pa.int32()), pa.array([int(e) for _, e in counts], pa.int32()), pa.array(list(counts.values()), pa.int64()),
            pa.array(asked, pa.int64()), pa.array([[str(v) for v in sums[key]] for key in counts], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "evaluated", "sums"])

    return run


def _add(rows):
    """Rows of one entry added up; the sums are written out in decimal, as they may pass 64 bits."""
    total = [sum(map(int, column)) for column in zip(*rows["sums"])]
    first = rows.iloc[:1][["part", "entry"]]
    return first.assign(n=rows["n"].sum(), evaluated=rows["evaluated"].sum(), sums=[[str(v) for v in total]])


def _moved(stored: DataFrame, width: int, parts: int, scale: int, books: Books) -> tuple[Books, int]:
    partial = stored.mapInArrow(_entry_sums(width, parts, scale, books), _SUMS)
    some = partial.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).groupBy("part", "entry", "some").applyInPandas(_add, _SUMS)
    entries, evaluated = [e.copy() for e in books.entries], 0
    for r in some.groupBy("part", "entry").applyInPandas(_add, _SUMS).collect():
        mean = [int(v) // r["n"] for v in r["sums"]]
        small = all(abs(v) < 2**52 for v in mean) and entries[r["part"]].dtype != object
        if not small and entries[r["part"]].dtype != object:
            entries[r["part"]] = np.frompyfunc(int, 1, 1)(entries[r["part"]])
        entries[r["part"]][r["entry"]] = mean
        evaluated += r["evaluated"]
    return Books(entries, books.pivots), evaluated


def _code_rows(width: int, parts: int, scale: int, books: Books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts, stored in _blocks(batches, width, parts, scale):
            codes, errors = np.zeros((batch.num_rows, parts), np.uint8), [0] * batch.num_rows
            for j, index, distance, _ in _assigned(cuts, stored, books):
                codes[:, j] = index
                errors = [a + int(b) for a, b in zip(errors, distance)]
            code = pa.array([c.tobytes().hex() for c in codes], pa.string())
            error = pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, error], names=["vec_id", "label", "code", "error"])

    return run


def _starting(vectors: DataFrame, width: int, entries: int, scale: int) -> np.ndarray:
    """The vectors of the least ids; Spark keeps that many rows of each partition only."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    x = np.zeros((len(rows), width))
    for row, r in zip(x, rows):
        row[: len(r["embedding"])] = r["embedding"]
    return integers(x, scale)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, scale: int = SCALE) -> Codes:
    """Codes of all usable ``vectors`` (vec_id, embedding, label): coded is vec_id, label, code (two hex digits a part), error."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte per part: 1 to 256 entries")
    work = Scratch(vectors.sparkSession, "codes")
    fine = usable(vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>")))
    longest = fine.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    start = _starting(fine, width, entries, scale)
    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    if not len(start):
        return Codes(vectors.sparkSession.createDataFrame([], schema), [[] for _ in range(parts)])
    first = np.split(start, parts, axis=1)
    books = Books(first, [spread_out(e, pivots) for e in first])
    fixed = _with_distances(width, parts, scale, books.pivots, max(map(len, books.pivots)))
    stored = work.write(fine.mapInArrow(fixed, f"{fine.schema.toDDL()}, to_pivots binary"))
    counts = []
    for _ in range(rounds):
        books, evaluated = _moved(stored, width, parts, scale, books)
        counts.append(evaluated)
    coded = work.write(stored.mapInArrow(_code_rows(width, parts, scale, books), schema))
    work.drop(stored)
    return Codes(coded, [[[int(v) for v in row] for row in e] for e in books.entries], counts)


def books_digest(codebooks: list[list[list[int]]]) -> str:
    return sha256(",".join(str(v) for part in codebooks for entry in part for v in entry).encode()).hexdigest()


def _total(c: str) -> Column:
    """Sum that is NULL beyond 64 bits or if a row's error is."""
    return F.when(F.count(c) == F.count("*"), F.sum(F.col(c).cast("decimal(38,0)"))).try_cast("long")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over equal labels, nulls together."""
    sums = Scratch(coded.sparkSession, "labels").write(coded.groupBy(F.col("label").alias("_label")).agg(_total("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
