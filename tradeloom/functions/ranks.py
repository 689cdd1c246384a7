"""Exact positions, cumulative counts and quantiles without a single-task window.

A total order is made by range partitioning. The partition number is frozen in
a written table, positions inside a partition are local, and the offsets of the
partitions are a running sum over one row per partition. Quantiles need no
order: histograms are refined around the wanted ranks until few values are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradeloom.functions.joins import attach
from tradeloom.session import Workspace, materialise

#: Bins of a histogram pass, and values of an interval that are few enough to be sorted as one array.
BINS, FEW = 2048, 4096


def positions(df: DataFrame, order: list, name: str = "row_index") -> DataFrame:
    """0-based position of every row in a total order.

    ``order`` must identify rows; equal keys cannot be split by range.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_local", F.col("_id").bitwiseAND((1 << 33) - 1))
        .drop("_id")
    )
    placed = materialise(placed, "positions")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    starts = F.broadcast(starts)  # one row per range partition, whatever the data
    return placed.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def cumulative_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct (keys, value) with ``n`` rows, ``before`` rows below it and ``total`` rows in the group.

    Equal values are merged before the sort, so neither a heavy group nor a
    heavy value ends up in one task.
    """
    counted = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "cumulative")
    parts = ranged.groupBy("_part", *keys).agg(F.sum("n").alias("_t"))
    group = W.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).withColumn("total", F.sum("_t").over(group))
    below = W.partitionBy("_part", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    out = local.join(parts.drop("_t"), ["_part", *keys])
    return out.withColumn("before", F.col("_start") + F.col("_below")).select(*keys, value, "n", "before", "total")


def pick_quantiles(counts: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], nearest: bool = False) -> DataFrame:
    """Quantile columns from :func:`cumulative_counts`, linear between neighbours or the nearest rank."""
    aggregates, finals = [], []
    for i, (name, p) in enumerate(quantiles.items()):
        at = (F.col("total") - 1) * F.lit(float(p))
        lo = F.floor(at + 0.5) if nearest else F.floor(at)
        hi = lo if nearest else F.ceil(at)
        for tag, k in (("lo", lo), ("hi", hi)):
            here = (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
            aggregates.append(F.max(F.when(here, F.col(value))).alias(f"_{tag}{i}"))
        aggregates.append(F.max(at - F.floor(at)).alias(f"_w{i}"))
        finals.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(name))
    return counts.groupBy(*keys).agg(*aggregates).select(*keys, *finals)


def _bin(x: Column, low: Column, high: Column, log: bool) -> Column:
    """Number of the bin of ``x`` between ``low`` and ``high``, which have bins of their own; it never falls as ``x`` grows."""
    def scaled(c: Column) -> Column:
        finite = F.greatest(F.least(c, F.lit(1.7e308)), F.lit(-1.7e308))
        return F.signum(finite) * F.log1p(F.abs(finite)) if log else finite / 2

    share = F.coalesce(F.try_divide(scaled(x) - scaled(low), scaled(high) - scaled(low)), F.lit(0.0))
    inner = F.greatest(F.least(F.floor(share * (BINS - 2)), F.lit(BINS - 3)), F.lit(0)) + 1
    return F.when(x == low, 0).when(x == high, BINS - 1).otherwise(inner).cast("int")


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """Exact quantiles of ``value`` per key group as doubles; NULL and NaN are left out. For few groups.

    Each pass counts the values of the intervals that hold a wanted rank in ``BINS`` bins, partly before the shuffle,
    and goes on with the bin of the rank; an interval of ``FEW`` values or less is sorted as one array. The values
    themselves are never shuffled by rank, so neither heavy groups nor heavy values matter. The first pass bins
    on a logarithmic scale, later ones on a linear one, which always tells the ends of an interval apart.
    """
    by = [f"_k{i}" for i in range(len(keys))] or ["_all"]
    groups = [F.col(k).alias(b) for k, b in zip(keys, by)] or [F.lit(1).alias("_all")]
    x = F.col("_x")
    with Workspace(df.sparkSession, "quantiles") as work:
        values = work.write(df.select(*groups, F.col(value).cast("double").alias("_x")).filter(x.isNotNull() & ~F.isnan(x)))
        sizes = work.write(values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high")))

        def rank(p: float, up: bool) -> Column:
            at = (F.col("n") - 1) * F.lit(float(p))
            return (F.floor(at + 0.5) if nearest else F.ceil(at) if up else F.floor(at)).cast("long")

        ranks = F.explode(F.array_distinct(F.array(*[rank(p, up) for p in wanted.values() for up in (False, True)])))
        targets = work.write(sizes.select(*by, ranks.alias("k"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")))
        log = True
        while True:
            broad = targets.filter((F.col("low") < F.col("high")) & (F.col("inside") > FEW))
            if broad.isEmpty():
                break
            spans = broad.select(*by, "low", "high", "before").distinct()
            met = attach(values, spans, by, "inner").filter(x.between(F.col("low"), F.col("high")))
            bins = met.groupBy(*by, "before", _bin(x, F.col("low"), F.col("high"), log).alias("bin")).agg(F.count("*").alias("inside"), F.min("_x").alias("low"), F.max("_x").alias("high"))
            earlier = W.partitionBy(*by, "before").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most BINS rows
            bins = bins.select(*by, F.col("before").alias("_from"), "low", "high", "inside", (F.col("before") + F.coalesce(F.sum("inside").over(earlier), F.lit(0))).alias("before"))
            there = (F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("inside"))
            found = attach(bins, broad.select(*by, F.col("before").alias("_from"), "k"), [*by, "_from"], "inner").filter(there)
            narrow = targets.join(broad.select(*by, "k"), [*by, "k"], "left_anti")
            columns = [*by, "k", "low", "high", "before", "inside"]
            old, targets, log = targets, work.write(narrow.select(*columns).unionAll(found.select(*columns))), False
            work.drop(old)
        several = targets.filter("low < high")
        spans = several.select(*by, "low", "high", "before").distinct()
        sorted_values = attach(values, spans, by, "inner").filter(x.between(F.col("low"), F.col("high"))).groupBy(*by, "before").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
        picked = attach(several.select(*by, "k", "before"), sorted_values, [*by, "before"], "inner").select(*by, "k", F.element_at("_xs", (F.col("k") - F.col("before") + 1).cast("int")).alias("v"))
        picked = picked.unionAll(targets.filter("low = high").select(*by, "k", F.col("low").alias("v")))
        met = attach(picked, sizes.select(*by, "n"), by, "inner")
        ends = [F.max(F.when(F.col("k") == rank(p, up), F.col("v"))).alias(f"_{i}{up}") for i, p in enumerate(wanted.values()) for up in (False, True)]
        weights = [F.lit(0.0) if nearest else (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))) for p in wanted.values()]
        ends_of = [(F.col(f"_{i}False"), F.col(f"_{i}True")) for i in range(len(wanted))]
        out = [F.when(low == high, low).otherwise(low + (high - low) * w).alias(name) for name, w, (low, high) in zip(wanted, weights, ends_of)]
        return materialise(met.groupBy(*by if keys else []).agg(F.max("n").alias("n"), *ends).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *out), "quantiles")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the least in ``order``, then in the other columns.

    ``min_by`` over a struct keeps one row per key and partition, where a
    ``row_number`` window would sort the whole group.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [c for c in order if c in rest] + [c for c in rest if c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in ranked]).select(*df.columns)
