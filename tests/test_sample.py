from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import network, profile, sample

KEYS = ["year", "reporter_country", "partner_country", "product_code"]


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(0)
    n = 2000
    pdf = pd.DataFrame({"year": rng.integers(2000, 2004, n), "reporter_country": rng.choice(list("ABCDEF"), n, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]),
                        "partner_country": rng.choice(list("ABCDEF"), n), "product_code": rng.choice(["270900", "720610", "010111", "850110"], n), "value": np.round(rng.random(n) * 100, 2), "quantity": 1.0})
    pdf["product_code"] = pdf["product_code"].where(pdf["reporter_country"] != "B", "270900")
    pdf = pdf.groupby(KEYS, as_index=False).sum()
    return spark.createDataFrame(pdf).cache(), pdf


def test_trim_uses_untrimmed_bounds(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=800), "b": rng.normal(size=800)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 0.0)], "a double, b double"))
    out = sample.trim_outliers(df, ["a", "b"], 0.05, 0.9).toPandas()
    b = pd.concat([pdf["b"], pd.Series([0.0])])
    keep = pdf["a"].between(*pdf["a"].quantile([0.05, 0.9])) & pdf["b"].between(*b.quantile([0.05, 0.9]))
    assert len(out) == keep.sum() and np.isclose(out["a"].sum(), pdf.loc[keep, "a"].sum())
    with pytest.raises(ValueError):
        sample.trim_outliers(df, ["a"], 0.9, 0.1)


def test_top_countries(flows):
    df, pdf = flows
    totals = pdf.groupby("reporter_country")["value"].sum().add(pdf.groupby("partner_country")["value"].sum())
    best = set(totals.sort_values(ascending=False).index[:3])
    want = pdf[(pdf["value"] >= 20) & pdf["reporter_country"].isin(best) & pdf["partner_country"].isin(best)]
    assert sample.top_country_filter(df, 20, 3).count() == len(want)


def test_resource_exporters(flows):
    df, _ = flows
    assert {r.reporter_country for r in sample.resource_exporters(df, 99.0).collect()} == {"B"}
    with pytest.raises(ValueError):
        sample.resource_exporters(df, 101)


def test_select_sample(flows):
    df, pdf = flows
    out = sample.select_sample(df, include=["A", "B", "C"], exclude=["C"], years=[2000, 2001], resource_threshold=None, exclude_prefixes=["72"]).toPandas()
    want = pdf[pdf["reporter_country"].isin(["A", "B"]) & pdf["partner_country"].isin(["A", "B"]) & pdf["year"].isin([2000, 2001]) & ~pdf["product_code"].str.startswith("72")]
    assert sorted(map(tuple, out[KEYS].to_numpy())) == sorted(map(tuple, want[KEYS].to_numpy()))
    assert "B" not in {r[0] for r in sample.select_sample(df, top_n=4, selection_year=2000).select("reporter_country").distinct().collect()}
    for wrong in (dict(include=["A"], top_n=3), dict(top_n=3), dict(), dict(top_n=3, selection_year=2000, method="exports")):
        with pytest.raises(ValueError):
            sample.select_sample(df, **wrong)


def test_exact_sample_is_repeatable(flows, rows):
    df, pdf = flows
    a, b = sample.sample_exact(df, 100, KEYS), sample.sample_exact(df.repartition(3), 100, KEYS)
    assert a.count() == 100 and rows(a) == rows(b)
    assert rows(sample.sample_exact(df, 100, KEYS, seed=7)) != rows(a)
    assert sample.sample_exact(df, len(pdf) + 5, KEYS).count() == len(pdf)
    assert sample.sample_exact(df, len(pdf) - 1, KEYS).count() == len(pdf) - 1


def test_every_nth(flows):
    df, pdf = flows
    want = pdf.sort_values(KEYS).iloc[::7]
    got = sample.every_nth(df, 7, KEYS).toPandas().sort_values(KEYS)
    assert got[KEYS].to_numpy().tolist() == want[KEYS].to_numpy().tolist()


def test_product_table_and_prefixes_agree(spark, flows, rows):
    df, _ = flows
    table = spark.createDataFrame([("72",), ("27",)], "prefix string")
    assert rows(sample.exclude_products(df, table)) == rows(sample.exclude_products(df, ["72", "27"]))


def test_control_presets_and_labels(spark, flows):
    df, _ = flows
    treated = spark.createDataFrame([("720610",)], "product_code string")
    codes = {"USA": "A", "China": "C", "United Kingdom": "D"}
    out = profile.control_preset(df, treated, "china_to_us", 2000, 2003, codes, ["C", "D"]).toPandas()
    assert set(out["destination"]) == {"USA", "Rest of World"} and set(out["tariff_status"]) == {"Tariffed by US", "Non-Tariffed by US"}
    assert (out.loc[out["year"] == 2000, "value_indexed"] == 100).all()
    with pytest.raises(ValueError):
        profile.control_preset(df, treated, "moon", 2000)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert sorted((r.bin, r.low, r.high, r.n) for r in profile.histogram(df, "x", 2).collect()) == [(0, 0.0, 5.0, 1), (1, 5.0, 10.0, 2)]
    assert profile.histogram(spark.createDataFrame([(1.0,)], "x double"), "x", 3).count() == 0


def test_value_counts_skip_constants(spark, rows):
    df = spark.createDataFrame([("a", "k"), ("b", "k"), ("a", "k")], "x string, y string")
    assert rows(profile.value_counts(df, ["x", "y"])) == [("x", "a", 2), ("x", "b", 1)]


def test_network_levels(flows):
    df, pdf = flows
    df = df.withColumn("average_tariff_official", F.lit(2.0))
    assert network.edges(df, "total").count() == len(pdf.groupby(["year", "reporter_country", "partner_country"]))
    assert network.edges(df, "2-digit").filter("abs(weighted_tariff - 2) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        network.edges(df, "3-digit")
