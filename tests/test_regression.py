"""Absorbed least squares against dense dummy variables in numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import absorb, coefficients, design


def _sample(n=240, seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"i": rng.integers(0, 9, n), "t": rng.integers(0, 7, n), "k": rng.integers(0, 5, n), "c": rng.integers(0, 12, n)})
    pdf.loc[rng.random(n) < 0.4, "i"] = 0  # a heavy level
    pdf["x1"] = rng.normal(size=n) + 0.3 * pdf["i"]
    pdf["x2"] = rng.normal(size=n) + 0.2 * pdf["t"]
    pdf["y"] = 1.5 * pdf["x1"] - 0.7 * pdf["x2"] + 0.5 * pdf["i"] - 0.4 * pdf["t"] + 0.3 * pdf["k"] + rng.normal(size=n) * (1 + 0.5 * abs(pdf["x1"]))
    pdf.loc[n] = [99, 3, 1, 2, 0.4, 0.1, 2.0]  # a level with one row
    return pdf.astype({c: int for c in "itkc"})


def _dense(pdf, terms, effects, variance, cluster=None):
    """The same model with one column per level."""
    d = [pdf.groupby(e).ngroup() for e in effects]
    dummies = np.hstack([np.eye(g.max() + 1)[g] for g in d]) if d else np.ones((len(pdf), 1))
    x = pdf[terms].to_numpy(float)
    a = np.hstack([x, dummies])
    y = pdf["y"].to_numpy(float)
    e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    m = np.eye(len(y)) - dummies @ np.linalg.pinv(dummies)
    xt = m @ x
    bread = np.linalg.inv(xt.T @ xt)
    beta = bread @ xt.T @ (m @ y)
    counted = [g.max() + 1 for g, f in zip(d, effects) if not (cluster and set(cluster) <= set(f))]
    dof = len(y) - len(terms) - (sum(counted) - max(len(counted) - 1, 0) if effects else 1)
    n = len(y)
    if variance == "iid":
        v = bread * (e @ e) / dof
    elif variance == "hetero":
        v = bread @ (xt.T @ (xt * (e**2)[:, None])) @ bread * n / dof
    else:
        s = pd.DataFrame(xt * e[:, None]).groupby(pdf.groupby(cluster).ngroup().to_numpy()).sum().to_numpy()
        g = len(s)
        v = bread @ s.T @ s @ bread * g / (g - 1) * (n - 1) / dof
    return beta, np.sqrt(np.diag(v)), e, m @ y, dof


EFFECTS = {"none": [], "one": [["i"]], "two": [["i"], ["t"]], "pairs": [["i", "t"], ["k"]], "three": [["i"], ["t"], ["k"]]}


CASES = [
    ("none", "iid", None), ("one", "hetero", None), ("two", "iid", None), ("two", "cluster", ["c"]), ("two", "cluster", ["i"]),
    ("pairs", "hetero", None), ("three", "hetero", None), ("three", "cluster", ["c"]),
]


@pytest.mark.parametrize("name,variance,cluster", CASES)
def test_estimates_and_variances(spark, name, variance, cluster):
    pdf = _sample()
    fit = absorb.absorbing_ols(spark.createDataFrame(pdf), "y", ["x1", "x2"], EFFECTS[name], variance, cluster)
    beta, se, e, within, dof = _dense(pdf, ["x1", "x2"], EFFECTS[name], variance, cluster)
    got = fit.coefficients.orderBy("term").collect()
    assert (fit.rounds > 0) == (len(EFFECTS[name]) > 1)
    assert [r.estimate for r in got] == pytest.approx(beta, rel=1e-6)
    assert [r.std_error for r in got] == pytest.approx(se, rel=1e-6)
    s = fit.statistics.first()
    y = pdf["y"].to_numpy()
    assert (s.n, s.dof) == (len(pdf), dof)
    assert s.rmse == pytest.approx(np.sqrt(e @ e / len(pdf)))
    assert s.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean()))) and s.r2_within == pytest.approx(1 - e @ e / (within @ within))


def test_collinear_terms_are_reported(spark):
    pdf = _sample()
    df = spark.createDataFrame(pdf.assign(x3=pdf["x1"] * 2 - pdf["x2"], x4=pdf["i"] * 1.0))
    fit = absorb.absorbing_ols(df, "y", ["x1", "x2", "x3", "x4"], [["i"], ["t"]], "hetero")
    assert fit.dropped == ["x3", "x4"]
    got = {r.term: r for r in fit.coefficients.collect()}
    assert got["x3"].dropped and got["x3"].estimate is None
    assert got["x1"].estimate == pytest.approx(_dense(pdf, ["x1", "x2"], [["i"], ["t"]], "hetero")[0][0])


def test_rows_with_missing_values_leave_the_sample(spark):
    pdf = _sample()
    gaps = pdf.astype({"i": "Int64"}).astype(object)
    gaps.loc[0:19, "x1"], gaps.loc[20:29, "y"], gaps.loc[30:39, "i"], gaps.loc[40:44, "x2"], gaps.loc[45:46, "x2"] = None, None, None, float("nan"), float("inf")
    df = spark.createDataFrame(gaps.values.tolist(), "i int, t int, k int, c int, x1 double, x2 double, y double")
    fit = absorb.absorbing_ols(df, "y", ["x1", "x2"], EFFECTS["two"], "cluster", ["c"])
    beta, se, *_ = _dense(pdf.loc[47:].reset_index(drop=True), ["x1", "x2"], EFFECTS["two"], "cluster", ["c"])
    got = fit.coefficients.orderBy("term").collect()
    assert [r.estimate for r in got] == pytest.approx(beta, rel=1e-6) and [r.std_error for r in got] == pytest.approx(se, rel=1e-6)
    s = fit.statistics.first()
    assert (s.n, s.left_out) == (len(pdf) - 47, 47)


def test_level_ids_tell_null_keys_apart(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0, 2.0), ("a", None, 1.0, 3.0), (None, "a", 2.0, 5.0), ("a", "b", 3.0, 4.0), ("b", "b", 3.0, 4.0), ("b", "b", 5.0, 1.0)], "p string, q string, x double, y double")
    fit = absorb.absorbing_ols(pairs, "y", ["x"], [["p", "q"]], "iid")
    assert fit.statistics.first().n == 4


def test_samples_without_an_answer(spark):
    df = spark.createDataFrame(_sample())
    with pytest.raises(ValueError, match="no row"):
        absorb.absorbing_ols(df.filter("i < 0"), "y", ["x1"], [["i"]], "iid")
    with pytest.raises(ValueError, match="two clusters"):
        absorb.absorbing_ols(df.withColumn("one", F.lit(1)), "y", ["x1"], [["i"]], "cluster", ["one"])
    with pytest.raises(ValueError, match="degrees of freedom"):
        absorb.absorbing_ols(df.limit(3).withColumn("row", F.monotonically_increasing_id()), "y", ["x1"], [["row"]], "iid")
    with pytest.raises(absorb.NotConverged):
        absorb.absorbing_ols(df, "y", ["x1"], EFFECTS["three"], "iid", max_rounds=1)


def test_small_sample_rules(spark):
    df, levels = spark.createDataFrame(_sample()), {}
    for rule in absorb.SMALL_SAMPLE:
        levels[rule] = absorb.absorbing_ols(df, "y", ["x1"], [["i"], ["t"]], "cluster", ["i"], small_sample=rule).statistics.first().absorbed
    assert levels == {"none": 0, "non-nested": 7, "all": 10 + 7 - 1, "rank": 10 + 7 - 1}


def test_models_on_one_sample_equal_single_fits(spark):
    pdf = _sample()
    df = spark.createDataFrame(pdf)
    models = [absorb.Model("a", "y", ["x1"]), absorb.Model("b", "y", ["x1", "x2"]), absorb.Model("c", "x1", ["x2"])]
    for variance, cluster in (("hetero", None), ("cluster", ["c"])):
        together = absorb.fit_models(df, models, EFFECTS["two"], variance, cluster)
        for m, fit in zip(models, together):
            alone = absorb.absorbing_ols(df, m.outcome, m.terms, EFFECTS["two"], variance, cluster)
            assert fit.estimate == pytest.approx(alone.estimate) and fit.covariance == pytest.approx(alone.covariance)


def test_tables_of_a_fit_are_removed(spark):
    import os

    from tradeloom.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    absorb.absorbing_ols(spark.createDataFrame(_sample()), "y", ["x1"], EFFECTS["three"], "hetero")
    assert set(os.listdir(folder)) <= before and not [t for t in spark.catalog.listTables() if t.name.startswith("fit_")]


def test_arguments(spark):
    df = spark.createDataFrame(_sample())
    with pytest.raises(ValueError):
        absorb.absorbing_ols(df, "y", ["x1"], [["i"]], "robust")
    with pytest.raises(ValueError):
        absorb.absorbing_ols(df, "y", ["x1"], [["i"]], "cluster")


def test_cumulative_effects(spark):
    pdf = _sample()
    out = absorb.cumulative_effects(spark.createDataFrame(pdf), "y", ["x1"], [["i"], ["t"]], "hetero")
    got = {r.model: r.estimate for r in out.collect()}
    assert got["i"] == pytest.approx(_dense(pdf, ["x1"], [["i"]], "hetero")[0][0])
    assert got["i+t"] == pytest.approx(_dense(pdf, ["x1"], [["i"], ["t"]], "hetero")[0][0])


def test_longer_lists_of_effects_start_from_shorter_ones(spark):
    pdf = _sample()
    df = spark.createDataFrame(pdf)
    fits = absorb.cumulative_fits(df, "y", ["x1", "x2"], EFFECTS["three"], "hetero")
    for i, fit in enumerate(fits):
        beta, se, *_ = _dense(pdf, ["x1", "x2"], EFFECTS["three"][: i + 1], "hetero")
        assert fit.estimate == pytest.approx(beta, rel=1e-6) and np.sqrt(np.diag(fit.covariance)) == pytest.approx(se, rel=1e-6)
    assert fits[0].rounds == 0


def _blocks():
    """Rows of two blocks that share no level of i or t, and of one level of i alone."""
    rng = np.random.default_rng(3)
    rows = [(b * 10 + i, b * 10 + t) for b in range(2) for i in range(4) for t in range(3) for _ in range(2)] + [(99, 0), (99, 1)]
    pdf = pd.DataFrame(rows, columns=["i", "t"])
    return pdf.assign(k=pdf["t"] % 2, x1=rng.normal(size=len(pdf)), y=rng.normal(size=len(pdf)))


def _rank(pdf, effects):
    dummies = np.hstack([pd.get_dummies(pdf[e].astype(str).agg("-".join, axis=1)).to_numpy(float) for e in effects])
    return np.linalg.matrix_rank(dummies)


def test_rank_counts_the_blocks_of_levels(spark):
    pdf = _blocks()
    df = spark.createDataFrame(pdf)
    ranks = {rule: absorb.absorbing_ols(df, "y", ["x1"], [["i"], ["t"]], "iid", small_sample=rule).statistics.first() for rule in ("all", "rank")}
    assert ranks["rank"].absorbed == _rank(pdf, [["i"], ["t"]]) == ranks["all"].absorbed - 1
    assert ranks["rank"].dof == ranks["all"].dof + 1
    three = absorb.absorbing_ols(df, "y", ["x1"], [["i"], ["t"], ["k"]], "iid", small_sample="rank").statistics.first()
    assert three.absorbed >= _rank(pdf, [["i"], ["t"], ["k"]])
    sample = absorb.absorbing_ols(spark.createDataFrame(_sample()), "y", ["x1"], EFFECTS["two"], "iid", small_sample="rank").statistics.first()
    assert sample.absorbed == _rank(_sample(), EFFECTS["two"])


@pytest.mark.parametrize("edges, nodes, groups", [
    ([(i, i + 1) for i in range(40)], 41, 1), ([(0, 5), (5, 3), (8, 9), (9, 8), (12, 10), (11, 10)], 8, 3), ([(-3, 4), (4, -9), (7, 2)], 5, 2),
])
def test_linked_groups(spark, edges, nodes, groups):
    from tradeloom.session import Workspace

    with Workspace(spark, "fit") as work:
        assert absorb.linked_groups(spark.createDataFrame(edges, "a long, b long"), nodes, work) == groups


def test_chains_of_singletons_leave(spark):
    pdf = _sample()
    # 99 and 100 are alone in i; without 100, 200 is alone in t, without that 101 is alone in i, and so on.
    chain = pd.DataFrame([(100, 200), (101, 200), (101, 201), (102, 201), (102, 3)], columns=["i", "t"]).assign(k=0, c=1, x1=1.0, x2=[0.5, 2.0, 0.1, 0.4, 9.0], y=[3.0, 1.0, 4.0, 1.0, 5.0])
    df = spark.createDataFrame(pd.concat([pdf, chain], ignore_index=True)[list(pdf.columns)])
    kept = absorb.absorbing_ols(df, "y", ["x1", "x2"], [["i"], ["t"]], "hetero", singletons="drop")
    s = kept.statistics.first()
    assert (s.n, s.singletons, s.left_out) == (len(pdf) - 1, 6, 0)
    assert kept.estimate == pytest.approx(_dense(pdf[:-1], ["x1", "x2"], [["i"], ["t"]], "hetero")[0])
    with pytest.raises(ValueError, match="no row"):
        absorb.absorbing_ols(spark.createDataFrame(chain), "y", ["x2"], [["i"], ["t"]], "iid", singletons="drop")


@pytest.mark.parametrize("variance, cluster", [("hetero", None), ("cluster", ["c"])])
def test_families_equal_columns(spark, variance, cluster):
    pdf = _sample()
    names = [f"z_{j}" for j in range(5)]
    wide = pdf.assign(**{n: np.where(pdf["i"] % 6 == j, pdf["x1"], 0.0) for j, n in enumerate(names)})
    at = pdf["i"] % 6
    sparse = spark.createDataFrame(wide.assign(at=at)).withColumn("at", F.when(F.col("at") < 5, F.col("at")))
    one = absorb.absorbing_ols(sparse, "y", ["x2", *names], EFFECTS["two"], variance, cluster, families=[absorb.Family("at", "x1", names)])
    beta, se, *_ = _dense(wide, ["x2", *names], EFFECTS["two"], variance, cluster)
    assert one.estimate == pytest.approx(beta, rel=1e-6) and np.sqrt(np.diag(one.covariance)) == pytest.approx(se, rel=1e-6)


def test_a_round_shuffles_no_pairs(spark):
    """Pairs reach their joins from buckets: between a scan of pairs and its join there is no exchange."""
    from tradeloom.session import Workspace

    rows = absorb._with_level_ids(spark.createDataFrame(_sample()), EFFECTS["three"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with Workspace(spark, "fit") as work:
        sizes, levels = absorb._level_sizes(rows, EFFECTS["three"], work)
        system = absorb.Normal(rows, sizes, levels, work)
        moving = work.write(system.scale.select("h", F.lit(0).alias("c"), "n", "d", *[F.lit(1.0).alias(x) for x in "arp"]))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = absorb.next_state(system, moving)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = [(len(line) - len(line.lstrip(" :+-")), line) for line in plan.splitlines()]
    scans = [n for n, (_, line) in enumerate(lines) if "FileScan" in line and "fit_" in line]
    assert len(scans) == 3 and "SortMergeJoin" in plan
    for n in scans:
        depth = lines[n][0]
        for d, line in reversed(lines[:n]):
            if d < depth:
                depth = d
                assert "Exchange" not in line
                if "SortMergeJoin" in line:
                    break


def _trade(spark):
    data = [
        (2018, "156", "840", "p", 10.0, 1.0, 5.0), (2018, "156", "840", "p", 20.0, 0.0, 7.0), (2018, "156", "826", "p", 5.0, 2.0, 1.0), (2018, "999", "826", "p", 5.0, 2.0, 1.0),
        (2019, "156", "840", "p", 8.0, 1.0, 9.0), (2019, "156", "826", "p", 0.0, 1.0, 2.0), (2019, "156", "826", "q", 4.0, 1.0, 2.0), (2016, "156", "840", "p", 4.0, 1.0, None),
    ]
    return design.add_logs(spark.createDataFrame(data, "year int, reporter_country string, partner_country string, product_code string, value double, quantity double, average_tariff_official double"))


def test_interactions(spark, rows):
    made = design.interaction_panel(_trade(spark), "UK", ["826"], ["156"], [2018, 2019], "log_value")
    # Product q and 2016 have no treatment, one flow has no log value.
    assert rows(made.data, "year", "importer", "exporter", "tariff_us_china", "UK_2018", "UK_2019") == [
        (2018, "826", "156", 6.0, 6.0, 0.0), (2018, "826", "999", 6.0, 0.0, 0.0), (2018, "840", "156", 6.0, 0.0, 0.0), (2018, "840", "156", 6.0, 0.0, 0.0), (2019, "840", "156", 9.0, 0.0, 0.0)]
    assert made.labels == {"UK_2018": ("UK", 2018), "UK_2019": ("UK", 2019)}
    assert design.sample_report(_trade(spark), ["log_value", "log_quantity"]).first().asDict() == {"n_rows": 8, "dropped_by_log_value": 1, "dropped_by_log_quantity": 1}


def test_saturated_columns(spark):
    made = design.saturated_panel(_trade(spark), [2018, 2019], "log_value")
    assert made.terms == ["gamma_826_2018", "gamma_826_2019"] and made.labels["gamma_826_2019"] == ("826", 2019)
    assert design.spread(made).agg(F.sum("gamma_826_2018"), F.sum("gamma_826_2019")).first() == (6.0, 0.0)


def test_growth(spark, rows):
    data = [("A", "X", "p", 2000, 100.0), ("A", "X", "p", 2002, 100.0 * math.exp(0.2)), ("A", "X", "p", 2002, 999.0), ("A", "X", "p", 2004, -1.0), ("B", "X", "p", 2002, 1.0), ("B", "X", "p", 2004, 1.0), ("B", "Z", "p", 2002, 1.0), ("B", "Z", "p", 2004, 1.0)]
    df = spark.createDataFrame(data, "reporter_country string, partner_country string, product_code string, year int, value double")
    out = design.growth_panel(df, (2000, 2002), (2002, 2004), ["X"], {"CHN": "A", "USA": "B"}).collect()
    got = sorted((r.reporter_country, round(r.y, 9), r.PostEvent, r.is_CHN_exporter, r.is_USA_exporter) for r in out)
    assert got == [("A", 10.0, 0, 1, 0), ("B", 0.0, 1, 0, 1)]
    third = design.third_country_panel(df, "X", (2000, 2002), (2002, 2004), ["X", "Z"], {"CHN": "A", "USA": "B"})
    assert rows(third, "reporter_country", "partner_country", "is_CHN_exporter_X_importer", "is_USA_exporter_X_importer", "is_USA_exporter_nonX_importer") == [("A", "X", 1, 0, 0), ("B", "X", 0, 1, 0), ("B", "Z", 0, 0, 1)]
    for wrong in (dict(period1=(2002, 2002), period2=(2002, 2004)), dict(period1=(2000, 2002), period2=(2004, 2002))):
        with pytest.raises(ValueError):
            design.growth_panel(df, importers=["X"], **wrong)
    with pytest.raises(ValueError):
        design.third_country_panel(df, "Q", (2000, 2002), (2002, 2004), ["X"])
    products = design.multiply(third, ["is_USA_exporter_X_importer"])
    assert products.terms == ["is_USA_exporter_X_importer_x_PostEvent"]


TIDY = "model string, term string, country string, year int, estimate double, std_error double, ci_low double, ci_high double, dropped boolean"


def test_coefficient_tables(spark, rows):
    value = spark.createDataFrame([("v", "gamma_826_2018", "826", 2018, -0.04, 0.01, -0.06, -0.02, False), ("v", "gamma_826_2019", "826", 2019, -0.08, 0.02, -0.12, -0.04, False), ("v", "gamma_124_2019", "124", 2019, None, None, None, None, True)], TIDY)
    quantity = spark.createDataFrame([("q", "gamma_276_2018", "276", 2018, 0.4, 0.1, 0.2, 0.6, False), ("q", "gamma_276_2021", "276", 2021, 9.0, 9.0, 9.0, 9.0, False)], TIDY)
    merged = coefficients.weighted_averages({"value": value, "quantity": quantity})
    got = {r.country: r for r in merged.collect()}
    assert got["826"]["average_coefficient_value"] == pytest.approx(-7.0) and got["826"]["linear_std_error_value"] == pytest.approx(1.75)
    assert got["276"]["average_coefficient_quantity"] == pytest.approx(10.0) and got["276"]["average_coefficient_value"] is None
    extra = spark.createDataFrame([("826", 1.0), ("840", 2.0)], "country string, average_coefficient_value double")
    assert rows(coefficients.append_missing(merged, extra), "country") == [("276",), ("826",), ("840",)]
    single = [r for r in coefficients.elasticity(value).collect() if r.year == 2019][0]
    assert (single.elasticity, single.bound_low, single.bound_high) == pytest.approx((-8.0, -4.0, -12.0))
    several = [r for r in coefficients.elasticity_of_models([value, quantity]).collect() if r.year == 2019][0]
    assert (several.elasticity, several.bound_low, several.bound_high) == pytest.approx((0.08, 0.04, 0.12))
    assert set(coefficients.side_by_side([value, quantity]).columns) == {"term", "v", "q"}
    named = coefficients.with_name_parts(value.drop("country", "year"))
    assert rows(named, "country", "year") == [("124", 2019), ("826", 2018), ("826", 2019)]
    stacked = coefficients.per_country(["826"], lambda c: value)
    assert rows(coefficients.coefficients_wide(stacked, {"gamma_826_2018": "a", "gamma_826_2019": "b"})) == [("826", -0.04, -0.08)]


def test_residuals_both_ways(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 4.0, 7.0], "y": [2.0, 3.0, 9.0, 10.0]})
    out = coefficients.residuals_both_ways(spark.createDataFrame(pdf), "x", "y").toPandas()
    b, a = np.polyfit(pdf["x"], pdf["y"], 1)
    c, e = np.polyfit(pdf["y"], pdf["x"], 1)
    assert np.allclose(sorted(out["y_residuals"]), sorted(pdf["y"] - a - b * pdf["x"])) and np.allclose(sorted(out["x_residuals"]), sorted(pdf["x"] - e - c * pdf["y"]))
