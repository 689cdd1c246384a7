"""Mix sources to target weights by systematic sampling.

Each source gets a target share of all words. A document's expected number of
copies is its source's target divided by the source's size. Documents are put in
a total order, expected copies are added up along it within the source, one
random offset is added, and a document is emitted once per whole number that the
running sum crosses. Ordered by size, a source's taken words differ from its
target by about one document.

Null sources form a source of their own, last in the order of sources. A null
text has no words. Repeated rows are separate documents. An empty table gives
no rows; a source without words has target 0 and takes nothing.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Expected copies are exact decimals, so their running sums do not depend on the order of addition.
COPIES = "decimal(14,12)"


def word_count(column: str = "text") -> Column:
    """Number of runs of characters other than space, tab, line feed, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat along the sources in code-point order, null last. Targets
    share the sum of all sizes by weight and stop at ``most`` times a source's
    size; the excess is shared again by weight among the others until none is
    above. Sources that stop are those with the smallest cap per weight: in that
    order, a source stops if its cap is at most its share of what is left, so
    one running sum decides all of them.
    """
    by_name = W.orderBy(F.col("source").cast("binary").asc_nulls_last())  # one row per source
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * float(most)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", cap)
    whole = W.partitionBy()
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    earlier = by_cap.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "rank": F.row_number().over(by_cap),
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)),
        "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
    })
    share = F.col("left") / F.col("left_weight")
    ranked = ranked.withColumn("stops", F.col("cap") <= share * F.col("weight"))
    # From the first source that does not stop on, all others get the same share per weight.
    level = F.min(F.when(~F.col("stops"), F.struct("rank", share.alias("share")))).over(whole)["share"]
    target = F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def offset(seed: int) -> float:
    """The one random offset, as a decimal of 12 places below 1."""
    return f"{random.Random(seed).randrange(10**12) / 10**12:.12f}"


def count_copies(df: DataFrame, order: list[str], size: str = "size", weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """``df`` (with ``source`` and ``size``) plus ``source_size``, ``target`` and ``copies``, which replace columns of these names.

    ``order`` makes the order within a source total together with the size;
    rows that agree in it are told apart by their scan position. Expected copies
    are the same for all documents of a source, so the running sum up to a row
    is its position times the rate. Positions come from one range partitioning,
    which splits a source of any size over many tasks. It samples its range bounds
    first, so ``df`` is computed twice: pass a written table if it is costly.
    """
    df = df.drop("source_size", "target", "copies")
    scratch = Scratch(df.sparkSession, "mix")
    numbered = df.withColumn("__seq", F.monotonically_increasing_id())
    sizes = df.groupBy("source").agg(F.sum(size).alias("source_size"))
    targets = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).cast(COPIES)

    total_order = ["source", size, *order, "__seq"]
    ranged = numbered.repartitionByRange(*total_order).sortWithinPartitions(*total_order)
    position = F.monotonically_increasing_id()
    placed = scratch.write(ranged.withColumn("__at", position))
    scratch.settle()
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"__part": part, "__local": local})

    # One row per partition and source in it: partitions plus sources in all.
    runs = placed.groupBy("__part", "source").agg(F.count("*").alias("__rows"), F.min("__local").alias("__first"))
    earlier = W.partitionBy("source").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("__start", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    rates = targets.withColumn("__rate", rate)
    same = runs["source"].eqNullSafe(rates["source"])
    runs = scratch.write(runs.join(rates, same).select(runs["__part"], runs["source"], "__first", "__start", "source_size", "target", "__rate"))
    here = (placed["__part"] == runs["__part"]) & placed["source"].eqNullSafe(runs["source"])
    joined = placed.join(runs, here).drop(runs["source"]).drop(runs["__part"])

    n = (F.col("__start") + F.col("__local") - F.col("__first")).cast("decimal(16,0)")
    shift = F.lit(offset(seed)).cast(COPIES)
    crossed = F.floor((n + 1) * F.col("__rate") + shift) - F.floor(n * F.col("__rate") + shift)
    return joined.withColumn("copies", crossed.cast("long")).select(*df.columns, "source_size", "target", "copies")


def mix(docs: DataFrame, order: list[str], weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """The mixed documents themselves: every row as often as it was drawn."""
    counted = count_copies(docs.withColumn("__size", word_count()), order, "__size", weights, most, seed)
    repeated = counted.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*docs.columns)
