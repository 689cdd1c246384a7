"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors are dealt to the nearest of a bounded number of pivots, and a pivot's
vectors to chunks of bounded size, so that a pivot with very many vectors is
spread over tasks. A task builds a cover tree over its chunk. Queries are
vectors of the same space: they are grouped by the pivot they are nearest to, and
every group has a cover tree of its own.

For a query node (centre q, radius r) and a data node (centre d, radius s) no
inner product exceeds q.d + r|d| + s|q| + rs. A first pass searches the queries'
own pivots and gives every query a k-th score to beat; the second pass sends a
group only to pivots whose bound reaches the group's worst k-th score, and
inside a task node pairs are pruned by the same bound. Pairs that could tie are
kept, so the result is exact and ties go to the smaller id.

Vectors that are null, without an id, or hold a null or a component that is not finite take no
part. Shorter vectors count as filled up with zeros. Repeated ids are separate
candidates, but no row of a query's own id is its candidate. An empty table
gives no rows. Components are whole numbers; inner products are exact as long as they
stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch

#: Bound of the sample that pivots are chosen from, and of the pivots.
SAMPLE, PIVOTS = 8192, 128
CHUNK_ROWS, GROUP_ROWS, LEAF = 4096, 256, 48
#: Queries that one task gets at most, about.
BIN_ROWS = 16384
#: Pivots searched first to find scores to beat.
NEAR = 2
#: Radii of neighbouring tree levels differ by this factor.
BASE = 1.3


def as_matrix(blobs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width))
    for row, b in zip(out, blobs):
        v = np.frombuffer(b, np.float64)
        row[: len(v)] = v
    return out


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, vector) of usable rows: floor(scale * x) of every component as doubles in one binary."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("double"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("x"))


class Node:
    """Points ``rows`` within ``radius`` of ``centre``; every child's points lie within its own smaller radius."""

    __slots__ = ("rows", "centre", "norm", "radius", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: int, distance: np.ndarray, leaf: int) -> None:
        self.rows, self.centre = rows, points[centre]
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.radius = float(distance.max())
        self.children: list[Node] = []
        if len(rows) > leaf and self.radius > 0:
            self.split(points, centre, distance, leaf)

    def split(self, points: np.ndarray, centre: int, distance: np.ndarray, leaf: int) -> None:
        """Cover the points with balls of the next level's radius around points that lie at least that far apart.

        The node's own centre comes first; each further centre is the point farthest from all so far. A ball's points
        are those nearest to its centre.
        """
        reach = self.radius / BASE
        nearest, owner, centres = distance.copy(), np.zeros(len(self.rows), np.int64), [centre]
        most = max(2, len(self.rows) // leaf)
        while len(centres) < most:
            far = int(nearest.argmax())
            if nearest[far] <= reach:
                break
            new = int(self.rows[far])
            d = np.sqrt(np.maximum(((points[self.rows] - points[new]) ** 2).sum(1), 0))
            closer = d < nearest
            nearest[closer], owner[closer] = d[closer], len(centres)
            centres.append(new)
        if len(centres) == 1:
            return
        for i, c in enumerate(centres):
            mine = owner == i
            if mine.any():
                self.children.append(Node(points, self.rows[mine], c, nearest[mine], leaf))


def tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    d = np.sqrt(((points - points[0]) ** 2).sum(1))
    return Node(points, np.arange(len(points)), 0, d, leaf)


class Best:
    """The k best (score, id) of each query, and the k-th score to beat."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.kth = floor.copy()
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (queries ``rows`` by ``ids``); a query's own id is no candidate."""
        scores = np.where(self.ids[rows][:, None] == ids[None, :], -np.inf, scores)
        hit = np.flatnonzero((scores >= self.kth[rows][:, None]).any(1))
        if not len(hit):
            return
        at = rows[hit]
        all_scores = np.concatenate([self.scores[at], scores[hit]], 1)
        all_ids = np.concatenate([self.found[at], np.broadcast_to(ids, (len(hit), len(ids)))], 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[at] = np.take_along_axis(all_scores, order, 1)
        self.found[at] = np.take_along_axis(all_ids, order, 1)
        self.kth[at] = np.maximum(self.kth[at], self.scores[at, -1])


def search(queries: np.ndarray, query_tree: Node, data: np.ndarray, data_ids: np.ndarray, data_tree: Node, best: Best) -> int:
    """Dual-tree traversal, best bound first among a node's children; returns the number of leaf pairs compared."""
    def bound(q: Node, d: Node) -> float:
        return float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius

    compared, stack = 0, [(bound(query_tree, data_tree), query_tree, data_tree)]
    while stack:
        limit, q, d = stack.pop()
        if limit + 1e-6 * (1 + abs(limit)) < best.kth[q.rows].min():
            continue
        if not q.children and not d.children:
            best.offer(q.rows, queries[q.rows] @ data[d.rows].T, data_ids[d.rows])
            compared += 1
            continue
        split_q = bool(q.children) and (not d.children or q.radius > d.radius)
        pairs = [(c, d) for c in q.children] if split_q else [(q, c) for c in d.children]
        stack.extend(sorted(((bound(a, b), a, b) for a, b in pairs), key=lambda p: p[0]))
    return compared


def assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, x) as (vec_id, vector, cell, distance): the nearest pivot of each."""
    width = pivots.shape[1]
    squares = (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = np.zeros((len(lists), width))
            lengths = np.diff(lists.offsets.to_numpy())
            x[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
            d = squares[None, :] - 2 * x @ pivots.T
            cell = d.argmin(1)
            gap = np.sqrt(np.maximum(((x - pivots[cell]) ** 2).sum(1), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell, pa.int64()), pa.array(gap, pa.float64())], ["vec_id", "vector", "cell", "distance"])

    return rows.mapInArrow(run, "vec_id long, vector binary, cell long, distance double")


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` points of the sample, each the farthest from those before: the top level of the cover tree."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lookup(counts: dict[int, int], n: int) -> Column:
    """The count of a row's cell, 1 where it has none."""
    return F.get(F.array(*[F.lit(int(counts.get(c, 1))) for c in range(n)]), F.col("cell").cast("int")).cast("long")


def query_bins(counts: dict[int, int], n: int, most: int = BIN_ROWS) -> tuple[list[int], list[int]]:
    """First bin and number of bins of each cell's queries: cells share a bin until it is full, a large cell has several."""
    first, number, bin_, filled = [], [], 0, 0
    for c in range(n):
        here = counts.get(c, 0)
        if filled and filled + here > most:
            bin_, filled = bin_ + 1, 0
        first.append(bin_)
        number.append(max(1, -(-here // most)))
        bin_, filled = (bin_ + number[-1], 0) if here > most else (bin_, filled + here)
    return first, number


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with ranks from 1; a task keeps its own k best before the shuffle."""
    order = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, embedding): for each row where ``is_query`` holds, its
    k best of all rows with another id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cover")
    rows = scratch.write(quantised(vectors, scale))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").collect()  # at most SAMPLE rows
    pivots = spread_pivots(np.stack([np.pad(np.array(r.x, float), (0, width - len(r.x))) for r in sample]), PIVOTS)
    placed = scratch.write(assign(rows, pivots))

    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()  # one row per pivot
    radius, present = np.zeros(len(pivots)), np.zeros(len(pivots), bool)
    for c in cells:
        radius[c.cell], present[c.cell] = c.radius, True
    chunks = lookup({c.cell: -(-c.n // CHUNK_ROWS) for c in cells}, len(pivots))
    data = scratch.write(placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), chunks)).select("cell", "part", "vec_id", "vector"))
    # Queries get a number of their own, as ids may repeat, and groups of bounded size inside their cell.
    asked = placed.filter(is_query).withColumn("query_row", F.monotonically_increasing_id())
    counts = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row per pivot
    groups = lookup({c: -(-n // GROUP_ROWS) for c, n in counts.items()}, len(pivots))
    first_bin, bins = query_bins(counts, len(pivots))
    spread = F.pmod(F.xxhash64("vec_id", "vector"), groups)
    bin_of = F.get(F.array(*map(F.lit, first_bin)), F.col("cell").cast("int")) + F.pmod(F.xxhash64("query_row"), F.get(F.array(*map(F.lit, bins)), F.col("cell").cast("int")))
    queries = scratch.write(asked.withColumns({"share": spread, "bin": bin_of.cast("long")}).select("query_row", F.col("vec_id").alias("query_id"), "vector", "cell", "share", "bin"))
    norms = np.sqrt((pivots**2).sum(1))

    def routed(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        """Queries once for every cell to search: the nearest ones, or all others whose bound is not below the score to beat."""
        for batch in batches:
            x = as_matrix(list(batch["vector"]), width)
            dots = x @ pivots.T
            d = np.where(present[None, :], norms[None, :] ** 2 - 2 * dots, np.inf)
            near = np.zeros(d.shape, bool)
            np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :NEAR], True, 1)
            near &= present[None, :]
            if not first:
                limit = dots + np.sqrt((x**2).sum(1))[:, None] * radius[None, :]
                near = ~near & present[None, :] & (limit + 1e-6 * (1 + np.abs(limit)) >= batch["floor"].to_numpy()[:, None])
            row, cell = np.nonzero(near)
            yield batch.iloc[row].rename(columns={"cell": "home"}).assign(cell=cell)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            points, ids = as_matrix(list(right["vector"]), width), right["vec_id"].to_numpy()
            data_tree = tree(points)
            for _, group in left.groupby(["home", "share"], sort=False):
                x = as_matrix(list(group["vector"]), width)
                own = group["query_id"].to_numpy()
                best = Best(own, group["floor"].to_numpy(), k)
                search(x, tree(x), points, ids, data_tree, best)
                q, slot = np.nonzero(np.isfinite(best.scores))
                out.append(pd.DataFrame({"query_row": group["query_row"].to_numpy()[q], "query_id": own[q], "vec_id": best.found[q, slot], "score": best.scores[q, slot].astype(np.int64)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_row", "query_id", "vec_id", "score")})

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        columns = "query_row long, query_id long, vector binary, home long, share long, bin long, floor double, cell long"
        sent = scratch.write(asked.mapInPandas(lambda it: routed(it, first), columns))
        # A chunk is repeated for the bins of queries that are sent to its cell; those queries for the cell's chunks.
        routes = scratch.write(sent.select("cell", "bin").distinct())
        there = data.join(routes, "cell").groupBy("cell", "part", "bin")
        here = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).groupBy("cell", "part", "bin")
        return scratch.write(here.cogroup(there).applyInPandas(meet, "query_row long, query_id long, vec_id long, score long"))

    start = searched(queries.withColumn("floor", F.lit(float("-inf"))).select("query_row", "query_id", "vector", "cell", "share", "bin", "floor"), True)
    floors = best_of(start, k).filter(F.col("rank") == k).select("query_row", F.col("score").cast("double").alias("floor"))
    raised = queries.join(floors, "query_row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = searched(raised.select("query_row", "query_id", "vector", "cell", "share", "bin", "floor"), False)
    return best_of(start.unionAll(rest), k).select("query_id", "rank", "vec_id", "score")
