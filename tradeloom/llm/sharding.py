"""Contiguous shards of nearly equal bytes from prefix sums over range partitions.

Rows are range-partitioned in a total order. Every partition adds up its own
bytes and rows; the running sum over these totals (one row per partition) gives
each partition its start, and a window inside the partition gives each row its
own. A row goes to the shard in whose share of all bytes its midpoint falls.

Rows that agree in all ordering columns are split over partitions by their scan
position, so a row repeated very often does not end up in one task. Empty
tables give no rows. Null ids sort first and null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradeloom.llm.common import Scratch

#: Bytes of a row besides its text.
ROW_BYTES = 8


def text_size(column: str = "text", extra: int = ROW_BYTES):
    """UTF-8 bytes of a text plus a fixed amount per row; a null text has none of its own."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long") + F.lit(extra)


def assign_shards(df: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1, rising with ``order``) and ``slot``
    (0, 1, ... inside the shard).

    A shard's bytes differ from the equal share by at most one row at each end.
    Columns called ``shard`` or ``slot`` are replaced.
    Only what ``df`` carries is shuffled: pass ids and sizes, not texts, and
    join texts afterwards if they are needed. Range bounds are sampled first, so
    ``df`` is computed twice: pass a written table if it is costly.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    df = df.drop("shard", "slot")
    scratch = Scratch(df.sparkSession, "shards")
    numbered = df.withColumn("__seq", F.monotonically_increasing_id())
    total_order = [*order, size, "__seq"]
    ranged = numbered.repartitionByRange(*total_order).withColumn("__part", F.spark_partition_id())
    placed = scratch.write(ranged)

    totals = placed.groupBy("__part").agg(F.sum(size).alias("__bytes"), F.count("*").alias("__rows"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = totals.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(earlier), F.lit(0)).alias("__byte_start"),
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__row_start"),
        F.sum("__bytes").over(W.partitionBy()).alias("__all_bytes"),
    )
    inside = W.partitionBy("__part").orderBy(*total_order)
    before = F.coalesce(F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    summed = placed.withColumns({"__before": before, "__index": F.row_number().over(inside) - 1})
    # One row per range partition, whatever the data: safe to broadcast.
    summed = summed.join(F.broadcast(starts), "__part")
    middle = 2 * (F.col("__byte_start") + F.col("__before")) + F.col(size)
    share = F.floor(middle.cast("decimal(38,0)") * n_shards / (2 * F.col("__all_bytes")).cast("decimal(38,0)"))
    summed = summed.withColumns({
        "shard": F.least(F.lit(n_shards - 1), F.coalesce(share, F.lit(0))).cast("int"),
        "__row": F.col("__row_start") + F.col("__index"),
    })
    summed = scratch.write(summed)
    # One row per shard: safe to broadcast.
    firsts = F.broadcast(summed.groupBy("shard").agg(F.min("__row").alias("__first")))
    out = summed.join(firsts, "shard").withColumn("slot", F.col("__row") - F.col("__first"))
    return out.select(*df.columns, "shard", "slot")


def write_shards(df: DataFrame, path: str, files_per_shard: int = 16) -> None:
    """Write rows with a ``shard`` and ``slot`` as ``path/shard=N/``, each shard by several tasks in slot order."""
    salted = df.withColumn("__file", F.pmod(F.col("slot"), F.lit(files_per_shard)))
    dealt = salted.repartition("shard", "__file").sortWithinPartitions("shard", "slot").drop("__file")
    dealt.write.partitionBy("shard").parquet(path)
