"""Positions, quantiles, fills and skewed joins against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.functions import joins, ranks, windows
from tradeloom.operators import sample


def _skewed(n=3000, seed=1):
    """A third of the rows in one group, and in it one value that repeats."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdef"), n))
    x = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(size=n), 2))
    return pd.DataFrame({"id": np.arange(n), "g": g, "x": x})


def test_positions_are_a_permutation_in_order(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf).repartition(7)
    out = ranks.positions(df, ["x", "id"], "i").toPandas().sort_values("i")
    assert out["i"].tolist() == list(range(len(pdf)))
    assert out["id"].tolist() == pdf.sort_values(["x", "id"])["id"].tolist()


@pytest.mark.parametrize("p", [0.0, 0.01, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_match_numpy(spark, p):
    pdf = _skewed()
    pdf.loc[pdf.index % 50 == 0, "x"] = None
    df = spark.createDataFrame(pdf)
    got = {r.g: r.q for r in ranks.quantiles(df, ["g"], "x", {"q": p}).collect()}
    want = pdf.dropna().groupby("g")["x"].quantile(p).to_dict()
    assert got == pytest.approx(want)
    near = ranks.quantiles(df, [], "x", {"q": p}, nearest=True).first().q
    ordered = np.sort(pdf["x"].dropna())
    assert near == ordered[int(np.floor((len(ordered) - 1) * p + 0.5))]


def test_quantiles_leave_out_nan_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", None)], "g string, x double")
    assert [tuple(r) for r in ranks.quantiles(df, ["g"], "x", {"q": 0.5}).collect()] == [("a", 2.0)]


@pytest.mark.parametrize("few", [1, 5, 4096])
def test_quantiles_by_refined_histograms(spark, monkeypatch, few):
    """Values far apart, next to each other, infinite and repeated; small arrays force several passes."""
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.lognormal(0, 6, 500), -rng.lognormal(0, 6, 300), 1e15 + np.arange(60.0), [0.0] * 50, [-np.inf, np.inf, 1.7e308, -1.7e308, 5e-324]])
    df = spark.createDataFrame([("g" if i % 3 else None, float(v)) for i, v in enumerate(x)], "g string, x double").repartition(5)
    wanted = {f"q{i}": p for i, p in enumerate((0.0, 0.1, 0.37, 0.5, 0.93, 1.0))}
    row = ranks.quantiles(df, [], "x", wanted, nearest=True).first()
    ordered = np.sort(x)
    assert [row[q] for q in wanted] == [ordered[int(np.floor((len(x) - 1) * p + 0.5))] for p in wanted.values()]
    finite = df.filter("abs(x) < 1e300")
    row = ranks.quantiles(finite, [], "x", wanted).first()
    assert [row[q] for q in wanted] == pytest.approx(np.quantile(x[np.abs(x) < 1e300], list(wanted.values())))


def test_quantiles_shuffle_no_values(spark, monkeypatch):
    """Every shuffle of a pass is of bins: the plan's exchanges come after a partial count."""
    plans = []
    write = ranks.Workspace.write
    monkeypatch.setattr(ranks.Workspace, "write", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df))[1])
    monkeypatch.setattr(ranks, "FEW", 10)
    ranks.quantiles(spark.range(1000).selectExpr("cast(id as double) x"), [], "x", {"q": 0.5})
    assert len(plans) > 3 and not any("rangepartitioning" in p for p in plans)
    assert not any("hashpartitioning(_x" in p for p in plans)


def test_every_nth_with_null_keys(spark):
    df = spark.createDataFrame([(None, "a"), ("b", "b"), ("c", None), ("d", "d")], "k string, v string")
    assert sorted(r.v or "" for r in sample.every_nth(df, 2, ["k"]).collect()) == ["", "a"]


def test_cumulative_counts(spark):
    df = spark.createDataFrame([(1.0,)] * 3 + [(2.0,)] * 2 + [(5.0,)], "x double")
    out = sorted(tuple(r) for r in ranks.cumulative_counts(df, [], "x").collect())
    assert out == [(1.0, 3, 0, 6), (2.0, 2, 3, 6), (5.0, 1, 5, 6)]


SERIES = [("a", 2000, None), ("a", 2001, 2.0), ("a", 2002, None), ("a", 2005, None), ("a", 2006, 5.0), ("a", 2007, None), ("b", 2000, None), ("b", 2001, None)]


@pytest.mark.parametrize("unique", [True, False])
def test_fills(spark, unique):
    df = spark.createDataFrame(SERIES, "g string, year int, x double")

    def series(out):
        return [r.x for r in out.orderBy("g", "year").collect()]

    assert series(windows.fill_forward(df, ["g"], "year", "x", unique)) == [None, 2, 2, 2, 5, 5, None, None]
    assert series(windows.fill_both_ways(df, ["g"], "year", "x", unique)) == [2, 2, 2, 2, 5, 5, None, None]
    # By position: the gap of three years between 2002 and 2005 takes one step.
    assert series(windows.interpolate(df, ["g"], "year", "x", 0.0, unique)) == [0, 2, 3, 4, 5, 0, 0, 0]
    assert series(windows.interpolate(df, ["g"], "year", "x", None, unique)) == [None, 2, 3, 4, 5, None, None, None]


def test_fill_keeps_repeated_rows(spark):
    data = [("a", 2000, 1.0, 1), ("a", 2001, None, 2), ("a", 2001, None, 3), ("a", 2001, 9.0, 4), ("a", 2002, None, 5)]
    df = spark.createDataFrame(data, "g string, year int, x double, id int")
    assert [r.x for r in windows.fill_forward(df, ["g"], "year", "x").orderBy("id").collect()] == [1, 9, 9, 9, 9]


def test_index_and_rebase(spark):
    df = spark.createDataFrame([("a", 2000, 2.0), ("a", 2001, 3.0), ("b", 2001, 5.0), ("c", 2000, 0.0)], "g string, year int, x double")
    got = {(r.g, r.year): r.x_indexed for r in windows.index_to_base(df, ["g"], F.col("year") == 2000, ["x"]).collect()}
    assert got == {("a", 2000): 100, ("a", 2001): 150, ("b", 2001): None, ("c", 2000): None}
    got = {r.g + str(r.year): r.x_rebased for r in windows.rebase(df.filter("g <> 'c'"), F.col("year") == 2000, ["x"]).collect()}
    assert got == {"a2000": 100, "a2001": 150, "b2001": 250}


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_salted_join_equals_plain_join(spark, how, rows):
    df = spark.createDataFrame(_skewed(500))
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "g string, v int")
    assert rows(joins.attach(df, table, ["g"], how, salt=5)) == rows(joins.attach(df, table, ["g"], how))
    with pytest.raises(ValueError):
        joins.attach(df, table, ["g"], "full", salt=2)


def test_first_per_key(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y")], "k string, o int, v string")
    assert rows(ranks.first_per_key(df, ["k"], ["o"])) == [("a", 1, "y")]


def test_hot_keys_are_split(spark):
    """On large tables a heavy key of a lookup is shared by several tasks."""
    from tools.compare import LARGE
    from tradeloom.operators import trend

    n = 200_000
    code = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string"))
    df = spark.range(0, n, 1, 8).select(
        code.alias("product_code"), F.lit(2000).alias("year"), (F.col("id") % 7).cast("double").alias("value"), F.lit(2.0).alias("quantity"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    saved = {k: spark.conf.get(f"spark.sql.{k}") for k in LARGE}
    for k, v in LARGE.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        out = trend.detrend(df, df, {"value": "trend"})
        assert out.filter("product_code = 'hot'").agg(F.countDistinct("trend"), F.count("*")).first() == (1, (n + 2) // 3)
        done = out.select("text", "value_detrended")
        assert done.collect() and "SortMergeJoin(skew=true)" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.set(f"spark.sql.{k}", v)


def test_written_summary_is_broadcast_only_when_small(spark):
    df = spark.createDataFrame(_skewed(500))
    plan = lambda: joins.attach_summary(df, df.groupBy("g").agg(F.avg("x").alias("m")), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
