"""Connected components by contraction, with joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of its component.

    Each round points every node at its least neighbour, follows the pointers to
    their ends by doubling, and replaces the edges by edges between ends. Every
    component with an edge left at least halves, so there are at most
    logarithmically many rounds. A node with very many edges is only ever an
    aggregation key with partial sums or the small side of a join.
    """
    edges = scratch.write(edges.filter(F.col("a") != F.col("b")).select("a", "b"))
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("end")).select(F.col("a").alias("node"), "end"))
        while True:
            step = ends.select(F.col("node").alias("end"), F.col("end").alias("next"))
            jumped = scratch.write(ends.join(step, "end").select("node", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")))
            moved = not jumped.filter("moved").isEmpty()
            scratch.drop(ends)
            ends = jumped
            if not moved:
                break
        written, ends = ends, ends.select("node", "end")
        if found is None:
            following = ends.withColumnRenamed("end", "root")
        else:
            later = ends.select(F.col("node").alias("root"), "end")
            following = found.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
        older, found = found, scratch.write(following)
        if older is not None:
            scratch.drop(older)
        a, b = (ends.select(F.col("node").alias(c), F.col("end").alias(f"to_{c}")) for c in "ab")
        moved_edges = edges.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        fewer = scratch.write(moved_edges.filter("a != b").distinct())
        scratch.drop(edges, written)
        edges = fewer
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
