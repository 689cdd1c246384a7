"""Tariff changes, impulse responses and their statistics.

They run on the panel with products cut to chapters, which has several rows per
group and year.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from catalog.base import chapters, normal_p, query, rounded, sq, sqs, student_p
from tradeloom.operators import events, inference

T, P = "average_tariff_official", "unit_value"
FIRST, LAST = 1995, 2001
_G = "reporter_country, partner_country, product_code"
_USING = "USING (reporter_country, partner_country, product_code)"

_CELLS = f"""yearly AS (SELECT {_G}, year, avg({T}) AS tariff, avg({P}) AS price, sum(value) AS value, sum(quantity) AS quantity, min({P}) AS least FROM chapters GROUP BY ALL)"""
# Gap one year, price from one year before to two years after the start.
_CHANGES = f"""{_CELLS},
  changes AS (
    SELECT reporter_country, partner_country, product_code, a.year AS y1, b.tariff - a.tariff AS {T}_change, (b.tariff - a.tariff) / nullif(a.tariff, 0) AS {T}_perc_change,
      pe.price - ps.price AS {P}_change, (pe.price - ps.price) / nullif(ps.price, 0) * 100 AS {P}_perc_change, pe.value - ps.value AS value_change, pe.quantity - ps.quantity AS quantity_change,
      a.year || '-' || b.year AS {T}_change_range, ps.year || '-' || pe.year AS {P}_change_range
    FROM yearly a JOIN yearly b {_USING} JOIN yearly ps {_USING} JOIN yearly pe {_USING}
    WHERE b.year = a.year + 1 AND ps.year = a.year - 1 AND pe.year = a.year + 2 AND b.tariff - a.tariff <> 0 AND a.year BETWEEN {FIRST} AND {LAST - 1})"""
_NUMBERS = [f"{T}_change", f"{T}_perc_change", f"{P}_change", f"{P}_perc_change", "value_change", "quantity_change"]


def _changes(spark, d):
    return events.tariff_changes(chapters(spark, d), FIRST, LAST, 1, 2, T, P, years_before=1)


@query("tariff_changes", f"WITH {_CHANGES} SELECT {_G}, {sqs(*_NUMBERS, digits=3)}, {T}_change_range, {P}_change_range FROM changes")
def _(spark, d):
    return rounded(_changes(spark, d), *_NUMBERS, digits=3)


@query("tariff_changes_two_year_gap", f"""WITH {_CELLS} SELECT {_G}, {sq('b.tariff - a.tariff', f'{T}_change')}, {sq('b.price - a.price', f'{P}_change', 3)}, a.year || '-' || b.year AS {T}_change_range
    FROM yearly a JOIN yearly b {_USING} WHERE b.year = a.year + 2 AND a.year BETWEEN 1996 AND 1998 AND b.tariff - a.tariff <> 0""")
def _(spark, d):
    out = events.tariff_changes(chapters(spark, d), 1996, 2000, 2, 2, T, P)
    return rounded(rounded(out.select(*_G.split(", "), f"{T}_change", f"{P}_change", f"{T}_change_range"), f"{T}_change"), f"{P}_change", digits=3)


_EVENTS = f"""{_CELLS}, impulses AS (
    SELECT reporter_country, partner_country, product_code, a.year AS impulse_year, b.tariff - a.tariff AS tariff_change_at_impulse, a.least AS price_t0
    FROM yearly a JOIN yearly b {_USING} WHERE b.year = a.year + 1 AND a.year BETWEEN {FIRST} AND {LAST - 1} AND b.tariff - a.tariff <> 0),
  around AS (
    SELECT reporter_country, partner_country, product_code, impulse_year, tariff_change_at_impulse, p.year, p.{P}, p.{P} - price_t0 AS {P}_diff, p.year - impulse_year AS time_relative_to_impulse, p.value
    FROM impulses JOIN chapters p {_USING} WHERE p.year - impulse_year BETWEEN -1 AND 3)"""


@query("impulse_series", f"WITH {_EVENTS} SELECT {_G}, impulse_year, {sq('tariff_change_at_impulse', 'tariff_change_at_impulse')}, year, {sq(P, P)}, time_relative_to_impulse, value FROM around")
def _(spark, d):
    return rounded(events.impulse_series(chapters(spark, d), FIRST, LAST, 1, 4, T, P, years_before=1), "tariff_change_at_impulse", P)


def _differences(spark, d):
    return events.impulse_differences(chapters(spark, d), FIRST, LAST, 1, 4, T, P, years_before=1)


@query("impulse_differences", f"WITH {_EVENTS} SELECT {_G}, impulse_year, {sq('tariff_change_at_impulse', 'tariff_change_at_impulse')}, year, {sq(f'{P}_diff', f'{P}_diff')}, time_relative_to_impulse, value FROM around")
def _(spark, d):
    return rounded(_differences(spark, d), "tariff_change_at_impulse", f"{P}_diff")


_STATS = ["mean_price_diff", "median_price_diff", "std_price_diff", "mean_tariff_change_in_bin", "median_tariff_change_in_bin", "std_tariff_change_in_bin"]


# Changes are rounded before binning: a sum that differs in its last bit must not move an event across a cut.
@query("response_by_bin", f"""WITH {_EVENTS},
    fine AS (SELECT *, {sq('tariff_change_at_impulse', 'change', 6)} FROM around),
    single AS (SELECT {_G}, impulse_year, min(change) AS change FROM fine GROUP BY ALL),
    cuts AS (SELECT quantile_cont(change, [0.2, 0.4, 0.6, 0.8]) AS c FROM single),
    binned AS (SELECT s.*, CASE WHEN change <= c[1] THEN 'Q1' WHEN change <= c[2] THEN 'Q2' WHEN change <= c[3] THEN 'Q3' WHEN change <= c[4] THEN 'Q4' ELSE 'Q5' END AS tariff_change_bin FROM single s, cuts),
    bins AS (SELECT tariff_change_bin, avg(change) AS mean_tariff_change_in_bin, median(change) AS median_tariff_change_in_bin, coalesce(stddev_samp(change), 0) AS std_tariff_change_in_bin FROM binned GROUP BY 1),
    times AS (SELECT time_relative_to_impulse, tariff_change_bin, avg({P}_diff) AS mean_price_diff, median({P}_diff) AS median_price_diff, coalesce(stddev_samp({P}_diff), 0) AS std_price_diff, count(*) AS n_observations
      FROM fine JOIN binned USING (reporter_country, partner_country, product_code, impulse_year) GROUP BY ALL)
    SELECT time_relative_to_impulse, tariff_change_bin, n_observations, {sqs(*_STATS, digits=3)} FROM times JOIN bins USING (tariff_change_bin)""")
def _(spark, d):
    fine = rounded(_differences(spark, d), "tariff_change_at_impulse", digits=6)
    return rounded(events.response_by_bin(fine, f"{P}_diff"), *_STATS, digits=3)


@query("response_by_sign", f"""WITH {_EVENTS}, signed AS (SELECT *, CASE WHEN tariff_change_at_impulse < 0 THEN 'Decrease' ELSE 'Increase' END AS tariff_change_bin FROM around)
    SELECT time_relative_to_impulse, tariff_change_bin, count(*) AS n_observations, {sq(f'avg({P}_diff)', 'mean_price_diff', 3)} FROM signed GROUP BY ALL""")
def _(spark, d):
    signs = _differences(spark, d).withColumn("tariff_change_at_impulse", F.signum("tariff_change_at_impulse"))
    out = events.response_by_bin(signs, f"{P}_diff")
    return rounded(out.select("time_relative_to_impulse", "tariff_change_bin", "n_observations", "mean_price_diff"), "mean_price_diff", digits=3)


# Mean tariffs are rounded before they divide: a change that is nothing but a last bit is none.
_PASS = f"{P}_change / nullif(floor({T}_change * 1e6 + 0.50001) / 1e6, 0)"


@query("pass_through", f"WITH {_CHANGES} SELECT {_G}, {T}_change_range, {sq(_PASS, 'effective_passthrough', 4)} FROM changes")
def _(spark, d):
    clear = rounded(_changes(spark, d), f"{T}_change", digits=6)
    out = events.pass_through(clear, f"{P}_change", f"{T}_change")
    return rounded(out.select(*_G.split(", "), f"{T}_change_range", "effective_passthrough"), "effective_passthrough")


@query("pass_through_mean_and_median", f"WITH {_CHANGES} SELECT {sq(f'avg({_PASS})', 'mean', 4)}, {sq(f'median({_PASS})', 'median', 4)} FROM changes")
def _(spark, d):
    clear = rounded(_changes(spark, d), f"{T}_change", digits=6)
    out = events.mean_and_median(events.pass_through(clear, f"{P}_change", f"{T}_change"), "effective_passthrough")
    return rounded(out, "mean", "median")


@query("t_test_of_price_change", f"WITH {_CHANGES} SELECT count(*) AS n, {sq(f'avg({P}_change)', 'mean')}, {sq(f'avg({P}_change) / (stddev_samp({P}_change) / sqrt(count(*)))', 't', 5)}, {sq(student_p(f'(avg({P}_change) / (stddev_samp({P}_change) / sqrt(count(*))))', '(count(*) - 1)'), 'p', 5)} FROM changes")
def _(spark, d):
    return rounded(rounded(inference.t_test(_changes(spark, d), f"{P}_change"), "mean"), "t", "p", digits=5)


# Whole numbers, so that there are ties and zeros to rank.
@query("signed_rank_of_price_change", f"""WITH {_CHANGES}, x AS (SELECT floor({P}_change / 100 + 0.50001) AS v FROM changes),
    ranked AS (SELECT v, rank() OVER (ORDER BY abs(v)) + (count(*) OVER (PARTITION BY abs(v)) - 1) / 2.0 AS r FROM x),
    ties AS (SELECT sum(n * n * n - n) AS t FROM (SELECT count(*)::double AS n FROM x WHERE v <> 0 GROUP BY abs(v))),
    sums AS (SELECT count(*)::double AS n, (count(*) FILTER (v = 0))::double AS z, sum(r) FILTER (v > 0) AS up, sum(r) FILTER (v < 0) AS down FROM ranked),
    scored AS (SELECT *, (least(up, down) - (n * (n + 1) / 4 - z * (z + 1) / 4)) / sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - t / 2) / 24) AS score FROM sums, ties)
    SELECT (n - z)::bigint AS n, up AS rank_sum_up, down AS rank_sum_down, least(up, down) AS statistic, {sq('score', 'z', 6)}, {sq(normal_p('score'), 'p', 5)} FROM scored""")
def _(spark, d):
    whole = _changes(spark, d).withColumn("v", F.floor(F.col(f"{P}_change") / 100 + 0.50001).cast("double"))
    return rounded(rounded(inference.signed_rank(whole, "v"), "z", digits=6), "p", digits=5)


# One mean change per importer: few values without ties, whose subsets of ranks can be counted.
@query("signed_rank_by_importer", f"""WITH RECURSIVE {_CHANGES}, x AS (SELECT avg({P}_change) AS v FROM changes GROUP BY partner_country),
    ranked AS (SELECT v, rank() OVER (ORDER BY abs(v)) AS r FROM x), sums AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (v > 0), 0) AS up, coalesce(sum(r) FILTER (v < 0), 0) AS down FROM ranked),
    ways AS (SELECT 0 AS i, 0 AS s, 1::double AS w UNION ALL
      SELECT i + 1, s, sum(w) FROM (SELECT i, unnest([s, s + i + 1]) AS s, w FROM ways WHERE i < (SELECT n FROM sums)) GROUP BY ALL)
    SELECT n, up::double AS rank_sum_up, down::double AS rank_sum_down, least(up, down)::double AS statistic,
      {sq('least(1, 2 * (SELECT sum(w) FROM ways WHERE i = n AND s <= least(up, down)) / pow(2, n))', 'p', 7)} FROM sums""")
def _(spark, d):
    means = _changes(spark, d).groupBy("partner_country").agg(F.avg(f"{P}_change").alias("v"))
    return rounded(inference.signed_rank(means, "v").drop("z"), "p", digits=7)


def _power(x, parts):
    """A quotient of polynomials in SQL, by powers."""
    above, below = ("(" + " + ".join(f"{c!r} * pow({x}, {len(powers) - 1 - i})" for i, c in enumerate(powers)) + ")" for powers in parts)
    return f"{above} / {below}"


_TAIL = "sqrt(-ln(least(u, 1 - u)))"


@query("quantile_points_of_price_change", f"""WITH {_CHANGES}, placed AS (SELECT {P}_change AS sample, row_number() OVER (ORDER BY {P}_change) AS position, count(*) OVER () AS n FROM changes WHERE {P}_change IS NOT NULL),
    medians AS (SELECT position, sample, CASE WHEN position = n THEN pow(0.5, 1.0 / n) WHEN position = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (position - 0.3175) / (n + 0.365) END::double AS u FROM placed)
    SELECT position, {sq('sample', 'sample', 3)}, {sq(f"CASE WHEN abs(u - 0.5) <= 0.425 THEN (u - 0.5) * {_power('(0.180625 - (u - 0.5) * (u - 0.5))', inference.CENTRE)} WHEN {_TAIL} <= 5 THEN sign(u - 0.5) * {_power(f'({_TAIL} - 1.6)', inference.NEAR_TAIL)} ELSE sign(u - 0.5) * {_power(f'({_TAIL} - 5)', inference.FAR_TAIL)} END", 'theoretical', 6)} FROM medians""")
def _(spark, d):
    return rounded(rounded(inference.quantile_points(_changes(spark, d), f"{P}_change"), "sample", digits=3), "theoretical", digits=6)


_GRID = [i / 20 for i in range(1, 20)]
_GRID_SQL = ", ".join(f"({p}, {NormalDist().inv_cdf(p)!r}::double)" for p in _GRID)


@query("normal_quantiles_of_price_change", f"""WITH {_CHANGES}, grid(probability, theoretical) AS (VALUES {_GRID_SQL}),
    all_q AS (SELECT unnest({_GRID!r}) AS probability, unnest(quantile_cont({P}_change, {_GRID!r})) AS sample FROM changes)
    SELECT {sq('g.probability', 'probability')}, {sq('theoretical', 'theoretical', 6)}, {sq('sample', 'sample', 3)} FROM grid g JOIN all_q a ON g.probability = a.probability""")
def _(spark, d):
    out = inference.normal_quantiles(_changes(spark, d), f"{P}_change", points=19)
    return rounded(rounded(rounded(out, "probability"), "theoretical", digits=6), "sample", digits=3)
