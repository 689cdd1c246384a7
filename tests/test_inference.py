from __future__ import annotations

import itertools
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import inference
from tradeloom.operators.students_t import t_quantile, two_sided_p


def test_student_t_against_tables():
    # Published two-sided 5% points of the t distribution.
    for df, point in ((1, 12.7062047), (2, 4.30265273), (10, 2.22813885), (30, 2.04227246), (1000, 1.96233910)):
        assert t_quantile(0.975, df) == pytest.approx(point, rel=1e-7)
        assert two_sided_p(point, df) == pytest.approx(0.05, rel=1e-6)
    assert two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert two_sided_p(1.0, 1) == pytest.approx(0.5)
    assert two_sided_p(1.959963985, 1e7) == pytest.approx(0.05, rel=1e-4)


def _frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def test_t_test(spark):
    x = np.array([1.0, 2.0, 4.0, 5.5, -1.0])
    row = inference.t_test(_frame(spark, [*x, None]), "x").first()
    assert row["n"] == 5 and row["t"] == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(5)))
    assert inference.t_test(_frame(spark, [3.0]), "x").first()["t"] is None


def _signed_rank(values):
    """Ranks by comparing every pair."""
    x = np.array(values, float)
    size = np.abs(x)
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    up, down = rank[x > 0].sum(), rank[x < 0].sum()
    n, z = len(x), int((x == 0).sum())
    ties = sum(c**3 - c for v, c in ((v, (size == v).sum()) for v in set(size[size > 0])))
    centre = n * (n + 1) / 4 - z * (z + 1) / 4
    spread = np.sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - ties / 2) / 24)
    stat = (min(up, down) - centre) / spread
    p = 2 * NormalDist().cdf(-abs(stat))
    if not z and not ties and n <= 16:  # every choice of signs, one by one
        sums = [sum(r for r, chosen in zip(range(1, n + 1), signs) if chosen) for signs in itertools.product((0, 1), repeat=n)]
        p = min(1.0, 2 * sum(s <= min(up, down) for s in sums) / len(sums))
    return n - z, up, down, stat, p


@pytest.mark.parametrize("values", [[1, -2, 3, 4, -5, 6, 7], [0, 0, 1, 1, -1, 2, -2, 2, 3, 0], [5, 5, 5, -5], [4.0], [-1, 2], [0.5 * i * (-1) ** (i // 3) for i in range(1, 14)], list(itertools.chain(range(-20, 40, 3), [0] * 5))])
def test_signed_rank(spark, values):
    row = inference.signed_rank(_frame(spark, [*values, None]), "x").first()
    n, up, down, z, p = _signed_rank(values)
    assert (row["n"], row["rank_sum_up"], row["rank_sum_down"]) == (n, up, down)
    assert row["z"] == pytest.approx(z) and row["p"] == pytest.approx(p)


def test_signed_rank_without_changes(spark):
    row = inference.signed_rank(_frame(spark, [0, 0]), "x").first()
    assert row["n"] == 0 and row["z"] is None


def test_exact_probabilities():
    assert inference.exact_p(0, 5) == 2 / 2**5 and inference.exact_p(7, 5) == 1.0
    assert sum(inference.exact_p(s, 50) <= 0.05 for s in range(50 * 51 // 2)) == 434 + 1  # published 5% point of n = 50


def test_quantile_points(spark):
    values = [3.0, 1.0, 2.0, 2.0, float("nan"), None, -5.0] + [float(v) for v in np.random.default_rng(1).normal(size=500)]
    got = inference.quantile_points(_frame(spark, values), "x").orderBy("position").collect()
    x = np.sort([v for v in values if v is not None and v == v])
    n = len(x)
    places = [1 - 0.5 ** (1 / n), *[(i - 0.3175) / (n + 0.365) for i in range(2, n)], 0.5 ** (1 / n)]
    assert [r.position for r in got] == list(range(1, n + 1)) and [r["sample"] for r in got] == x.tolist()
    assert [r.theoretical for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in places], rel=1e-12, abs=1e-14)


def test_normal_quantile_in_the_tails(spark):
    ps = [1e-300, 1e-100, 1e-20, 1e-11, 1e-5, 0.01, 0.074, 0.076, 0.5, 0.6, 0.93, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inference.normal_quantile(F.col("p")).alias("z")).collect()
    assert {r.p: r.z for r in got} == pytest.approx({p: NormalDist().inv_cdf(p) for p in ps}, rel=1e-12, abs=1e-15)


def test_normal_quantiles(spark):
    values = np.random.default_rng(0).normal(size=400)
    out = {round(r.probability, 2): (r.theoretical, r["sample"]) for r in inference.normal_quantiles(_frame(spark, values), "x", 9).collect()}
    assert out[0.5][0] == pytest.approx(0.0, abs=1e-12)
    for p, (t, s) in out.items():
        assert t == pytest.approx(NormalDist().inv_cdf(p)) and s == pytest.approx(np.quantile(values, p))
