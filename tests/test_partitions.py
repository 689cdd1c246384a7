"""Tasks of bounded size: shuffle partitions, buckets and files follow the data, not the session's fixed number."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalog import ingest
from tradeloom import session
from tradeloom.plans import star
from tradeloom.session import Workspace, widen_shuffles

WIDTH, ADVISORY = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def narrow(spark):
    """A session whose settings are put back."""
    held = {k: spark.conf.get(k) for k in (WIDTH, ADVISORY)}
    spark.conf.set(WIDTH, "2")
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.fixture
def orders(spark, tmp_path):
    """Two copies of an order's buyer and of a part, a line without an order, and a seller without a nation."""
    d = str(tmp_path / "tables")
    for name, rows, kind in (
        ("customer", [(1, 7), (1, 7), (2, None)], "c_custkey long, c_nationkey int"),
        ("supplier", [(1, 123), (2, None)], "s_suppkey long, s_nationkey int"),
        ("part", [(1, "SMALL", "Brand#3", 5), (1, "SMALL", "Brand#3", 5), (2, "odd", "Brand#3", 5)], "p_partkey long, p_type string, p_brand string, p_size int"),
        ("orders", [(1, 1, "1998-05-01"), (2, 2, "1999-05-01")], "o_orderkey long, o_custkey long, day string"),
        ("lineitem", [(1, 1, 1, 2.0, 10.5, 0.09, 0.02), (1, 1, 1, 1.0, 0.25, 0.01, 0.04), (2, 1, 1, 5.0, 1.0, 0.1, 0.0), (2, 2, 2, 1.0, 3.0, 0.0, 0.01), (9, 1, 1, 1.0, 1.0, 0.0, 0.0)],
         "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
    ):
        df = spark.createDataFrame(rows, kind)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.to_timestamp("day")).drop("day")
        df.write.parquet(f"{d}/{name}.parquet")
    return d


def test_partitions_grow_with_the_input_and_never_shrink(narrow, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    narrow.range(50_000).write.parquet(path)
    assert widen_shuffles(narrow, [path]) == 2
    monkeypatch.setattr(session, "INPUT_PER_PARTITION", 10_000)
    wide = widen_shuffles(narrow, [path])
    assert wide > 2 and narrow.conf.get(WIDTH) == str(wide)
    assert narrow.conf.get(ADVISORY) == str(session.SHUFFLED_PER_TASK)
    monkeypatch.setattr(session, "INPUT_PER_PARTITION", 1 << 30)
    assert widen_shuffles(narrow, [path]) == wide


def test_the_derived_panel_is_built_with_partitions_for_its_input(narrow, orders, monkeypatch):
    monkeypatch.setattr(session, "INPUT_PER_PARTITION", 500)
    star.stored_cells(narrow, orders)
    assert int(narrow.conf.get(WIDTH)) > 2


def test_cells_of_repeated_keys_and_missing_nations(spark, orders, rows):
    got = rows(star.cells(spark, orders), "reporter_country", "partner_country", "product_code", "year", "cents", "units", "n_lines", "tax_sum", "tax_min", "tax_max", "cut_min", "cut_max")
    assert got == sorted([
        ("123", "007", "020305", 1998, 4300, 12, 8, 24, 2, 4, 9, 9),
        ("123", None, "020305", 1999, 200, 10, 2, 0, 0, 0, 10, 10),
        (None, None, None, 1999, 300, 1, 1, 1, 1, 1, None, None),
    ], key=repr)


def test_lines_are_not_shuffled_to_meet_the_buyers(spark, orders):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = star.cells(spark, orders)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    by_buyer = [i for i, x in enumerate(lines) if "hashpartitioning(o_custkey" in x]
    assert len(by_buyer) == 2
    for at in by_buyer:
        below = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
        assert not any("l_extendedprice" in x for x in lines[at:below])


@pytest.mark.parametrize("schedule", [star.mfn, star.pref])
def test_cells_are_not_shuffled_to_meet_the_rates_of_chapters(spark, tmp_path, monkeypatch, schedule):
    """The rates of many cells are few; their real size is known, so the cells stay where they are."""
    path = str(tmp_path / "cells")
    spark.range(0, 50_000, 1, 2).select(
        F.lit("003").alias("reporter_country"), F.lit("019").alias("partner_country"), F.format_string("01%06d", "id").alias("product_code"), F.lit(1998).alias("year"),
        *[(F.col("id") % 7).alias(c) for c in ("tax_sum", "n_lines", "tax_min", "tax_max", "cut_min", "cut_max")],
    ).write.parquet(path)
    monkeypatch.setattr(star, "stored_cells", lambda spark, d: spark.read.parquet(path))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(64 << 10))
    try:
        made = schedule(spark, "unused")
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert made.count() == 50_000


@pytest.mark.parametrize(("rows", "files"), [(1, 1), (250_000, 3)])
def test_buckets_follow_the_rows(spark, rows, files):
    with Workspace(spark, "buckets") as work:
        table = work.write_bucketed(spark.range(1000).selectExpr("id % 97 AS k", "id"), "k", rows)
        assert table.select(F.input_file_name()).distinct().count() == files
        assert table.count() == 1000


def test_a_year_of_a_published_schedule_is_split_over_tasks(narrow):
    """One folder's rows are not dealt to one task."""
    narrow.conf.set(ADVISORY, "20000")
    rates = narrow.range(0, 40_000, 1, 4).select(
        F.lit(1998).alias("year"), F.lit("003").alias("reporter_country"), F.format_string("%06d", "id").alias("product_code"),
        F.lit(1.5).alias("tariff_rate"), F.lit(1.0).alias("min_rate"), F.lit(2.0).alias("max_rate"))
    scanned = ingest._raw_tariffs(narrow, rates, "AVEMFN")
    assert scanned.count() == 40_000
    assert scanned.select(F.input_file_name()).distinct().count() > 1
