"""Tests on one column of changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.columns import is_number
from tradeloom.functions.ranks import cumulative_counts, quantiles
from tradeloom.operators.students_t import two_sided_p

#: Up to so many values without ties and zeros have the exact null distribution.
EXACT_MOST = 50


def t_test(df: DataFrame, column: str, mean: float = 0.0) -> DataFrame:
    """One-sample t test of the mean; NULL statistic for fewer than two values."""
    x = F.col(column)
    row = df.filter(is_number(column)).agg(F.count(x), F.avg(x), F.stddev_samp(x)).first()
    n, avg, sd = row
    t = (avg - mean) / (sd / n**0.5) if n > 1 and sd else None
    p = two_sided_p(t, n - 1) if t is not None else None
    return df.sparkSession.createDataFrame([(n, avg, t, p)], "n long, mean double, t double, p double")


def signed_rank(df: DataFrame, column: str) -> DataFrame:
    """Two-sided Wilcoxon signed-rank test with zeros treated the Pratt way.

    Zeros take part in the ranking and are then left out. Ties share their mean
    rank. Ranks come from cumulative counts of distinct absolute values, so no
    task sees all rows. The p-value is exact for up to ``EXACT_MOST`` values
    without ties and zeros, see :func:`exact_p`; otherwise it is the normal
    approximation with corrections for ties and zeros.
    """
    sizes = df.filter(is_number(column)).select(F.abs(F.col(column)).alias("size"), F.signum(column).alias("sign"))
    ranked = cumulative_counts(sizes.select("size"), [], "size").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    signs = sizes.groupBy("size").agg(F.count_if(F.col("sign") > 0).alias("up"), F.count_if(F.col("sign") < 0).alias("down"))
    r, n = F.col("rank"), F.col("n").cast("double")
    live = F.col("size") > 0
    row = ranked.join(signs, "size").agg(
        F.sum("n"), F.coalesce(F.sum(F.when(~live, F.col("n"))), F.lit(0)), F.sum(F.when(live, r * F.col("up"))), F.sum(F.when(live, r * F.col("down"))),
        F.sum(F.when(live, n * n * n - n)),
    ).first()
    total, zeros, up, down, ties = [float(x or 0) for x in row]
    m = total - zeros
    z = p = None
    if m > 0:
        centre = total * (total + 1) / 4 - zeros * (zeros + 1) / 4
        spread = total * (total + 1) * (2 * total + 1) - zeros * (zeros + 1) * (2 * zeros + 1) - ties / 2
        if spread > 0:
            z = (min(up, down) - centre) / (spread / 24) ** 0.5
            p = 2 * NormalDist().cdf(-abs(z))
        if total <= EXACT_MOST and not zeros and not ties:
            p = exact_p(int(min(up, down)), int(m))
    return df.sparkSession.createDataFrame(
        [(int(m), up, down, min(up, down), z, p)], "n long, rank_sum_up double, rank_sum_down double, statistic double, z double, p double"
    )


def exact_p(statistic: int, n: int) -> float:
    """Two-sided probability of a rank sum this small: each of the ranks 1 to ``n`` counts or not, all subsets alike.

    ``ways[s]`` is the number of subsets of the ranks so far that add up to ``s``.
    """
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        ways = [w + (ways[s - rank] if s >= rank else 0) for s, w in enumerate(ways)]
    return min(1.0, 2 * sum(ways[: statistic + 1]) / 2**n)


def normal_quantiles(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """Exact sample quantiles beside normal quantiles on an even grid of probabilities."""
    grid = {f"q{i}": i / (points + 1) for i in range(1, points + 1)}
    picked = quantiles(df, [], column, grid)
    pairs = [F.struct(F.lit(p).alias("probability"), F.lit(NormalDist().inv_cdf(p)).alias("theoretical"), F.col(q).alias("sample")) for q, p in grid.items()]
    return picked.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


# Wichura's rational approximations of the normal quantile (AS 241, PPND16), numerator and denominator
# from the highest power down, for the centre, the near and the far tails.
CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
NEAR_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution for probabilities between 0 and 1."""
    def ratio_of(parts: Sequence[Sequence[float]], r: Column) -> Column:
        above, below = (reduce(lambda total, c: total * r + c, powers[1:], F.lit(powers[0])) for powers in parts)
        return above / below

    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5.0, ratio_of(NEAR_TAIL, r - 1.6)).otherwise(ratio_of(FAR_TAIL, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * ratio_of(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def quantile_points(df: DataFrame, column: str) -> DataFrame:
    """Every value beside the normal quantile of its place: ``position`` from 1, ``theoretical``, ``sample``.

    Places are Filliben's medians of the order statistics. Equal values take their places one after the other;
    they are merged before the order is made and spread out again after it.
    """
    counts = cumulative_counts(df.filter(is_number(column)).select(F.col(column).cast("double").alias("sample")), [], "sample")
    placed = counts.select("sample", "total", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("position"))
    n, i = F.col("total"), F.col("position")
    last = F.pow(F.lit(0.5), 1 / n)
    middle = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    return placed.select("position", normal_quantile(middle).alias("theoretical"), "sample")
