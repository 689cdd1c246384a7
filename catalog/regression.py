"""Regression samples, absorbed fixed effects and coefficient tables.

Products are cut to chapters, so a pair trades a chapter in several rows a year.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYS, chapters, q, query, rounded, sq, sqs, student_p
from tradeloom.operators import absorb, coefficients, design
from tradeloom.plans import star

E, I = star.TARGET_EXPORTER, star.TARGET_IMPORTER  # noqa: E741
PAIR = (E, I)
YEARS = [1998, 1999, 2000]
T = "average_tariff_official"


def _data(spark, d):
    """Chapter rows with log outcomes and the tariff as a percentage."""
    return design.add_logs(chapters(spark, d)).withColumn(T, F.col(T) / 1e4)


_BASE = f"""base AS (SELECT * REPLACE ({T} / 1e4 AS {T}), ln(value) AS log_value, ln(quantity) AS log_quantity FROM chapters),
    rates AS (SELECT year, product_code, avg({T}) AS tau FROM base WHERE reporter_country = '{E}' AND partner_country = '{I}' GROUP BY ALL),
    treated AS (SELECT b.*, tau FROM base b JOIN rates r ON b.year = r.year AND b.product_code = r.product_code WHERE tau IS NOT NULL)"""
_ID = ", ".join(KEYS)


def _active(name, condition, years=YEARS):
    return ", ".join(sq(f"CASE WHEN {condition} AND year = {y} THEN tau ELSE 0.0 END", f"{name}_{y}") for y in years)


def _shown(fitted: design.Design, *more):
    return rounded(fitted.data.select(*KEYS, *more, *fitted.terms), *more, *fitted.terms)


@query("interaction_panel", f"WITH {_BASE} SELECT {_ID}, {sq('log_value', 'log_value')}, {_active('target', f'''partner_country IN ('{I}', '008') AND reporter_country = '{E}' ''')} FROM treated")
def _(spark, d):
    return _shown(design.interaction_panel(_data(spark, d), "target", [I, "008"], [E], YEARS, "log_value", treated_pair=PAIR), "log_value")


@query("interaction_panel_filtered", f"WITH {_BASE} SELECT {_ID}, {sq('log_value', 'log_value')}, {_active('target', f'''partner_country IN ('{I}') AND reporter_country = '{E}' ''')} FROM treated WHERE year IN (1998, 1999, 2000) AND product_code <> '84'")
def _(spark, d):
    made = design.interaction_panel(_data(spark, d), "target", [I], [E], YEARS, "log_value", F.col("product_code") != "84", True, PAIR)
    return _shown(made, "log_value")


_VARIANTS = {"tariff_interaction_US": f"partner_country = '{I}'", "tariff_interaction_ROW": f"partner_country <> '{I}'", "tariff_interaction_UK": "partner_country = '008'"}


@query("interaction_variants", f"WITH {_BASE} " + " UNION ALL ".join(
    f"SELECT '{n}' AS variant, year, count(*) AS n, {sq(f'''sum(CASE WHEN reporter_country = '{E}' AND {c} THEN tau ELSE 0 END)''', 'total', 2)} FROM treated WHERE year IN (1998, 1999, 2000) GROUP BY year"
    for n, c in _VARIANTS.items()))
def _(spark, d):
    made = design.interaction_variants(_data(spark, d), YEARS, "log_value", PAIR, third="008")
    parts = []
    for name, m in made.items():
        total = sum((F.col(t) for t in m.terms), F.lit(0.0))
        parts.append(m.data.groupBy("year").agg(F.count("*").alias("n"), F.sum(total).alias("total")).select(F.lit(name).alias("variant"), "year", "n", q("total", 2).alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("importer_split", f"""WITH {_BASE} SELECT {_ID}, {sq(f"CASE WHEN reporter_country = '{E}' THEN tau ELSE 0.0 END", 'tariff_x_target')}, {sq(f"CASE WHEN reporter_country <> '{E}' THEN tau ELSE 0.0 END", 'tariff_x_row')}
    FROM treated WHERE partner_country = '008'""")
def _(spark, d):
    return _shown(design.importer_split(_data(spark, d), "008", "log_value", E, PAIR))


@query("saturated_panel", f"""WITH {_BASE} SELECT partner_country AS country, {', '.join(sq(f"sum(CASE WHEN reporter_country = '{E}' AND year = {y} THEN tau ELSE 0 END)", f'gamma_{y}', 2) for y in YEARS)}
    FROM treated WHERE partner_country NOT IN ('{E}', '{I}') GROUP BY 1""")
def _(spark, d):
    made = design.saturated_panel(_data(spark, d), YEARS, "log_value", treated_pair=PAIR)
    sums = design.spread(made).agg(*[F.sum(t).alias(t) for t in made.terms])
    long = sums.unpivot([], made.terms, "term", "total")
    parts = F.split("term", "_")
    named = long.select(parts[1].alias("country"), parts[2].alias("y"), "total")
    return named.groupBy("country").agg(*[q(F.sum(F.when(F.col("y") == str(y), F.col("total"))), 2).alias(f"gamma_{y}") for y in YEARS])


_IMPORTERS = ["019", "008", "010", "011", "012", "013", "014", "015"]
_IN = ", ".join(f"'{c}'" for c in _IMPORTERS)
_GROWTH = f"""wide AS (SELECT reporter_country, partner_country, product_code, {', '.join(f'min(CASE WHEN year = {y} THEN value END) AS v{y}' for y in (1996, 1998, 2000))}
      FROM chapters WHERE partner_country IN ({_IN}) AND value > 0 AND year IN (1996, 1998, 2000) GROUP BY ALL),
    growth AS (SELECT reporter_country, partner_country, product_code, 100 * (ln(v1998) - ln(v1996)) / 2 AS y, 0 AS "PostEvent" FROM wide WHERE v1996 IS NOT NULL AND v1998 IS NOT NULL
      UNION ALL SELECT reporter_country, partner_country, product_code, 100 * (ln(v2000) - ln(v1998)) / 2, 1 FROM wide WHERE v1998 IS NOT NULL AND v2000 IS NOT NULL)"""
_PERIODS = (1996, 1998), (1998, 2000)
_TWO = {"CHN": E, "USA": "009"}


def _ints(df):
    return df.withColumns({c: F.col(c).cast("int") for c, t in df.dtypes if t == "tinyint"})


@query("growth_panel", f"""WITH {_GROWTH} SELECT reporter_country, partner_country, product_code, {sq('y', 'y')}, "PostEvent", (reporter_country = '{E}')::int AS "is_CHN_exporter", (reporter_country = '009')::int AS "is_USA_exporter" FROM growth""")
def _(spark, d):
    return _ints(rounded(design.growth_panel(chapters(spark, d), *_PERIODS, _IMPORTERS, _TWO), "y"))


@query("third_country_panel", f"""WITH {_GROWTH} SELECT reporter_country, partner_country, product_code, {sq('y', 'y')}, "PostEvent", """ + ", ".join(
    f"""(reporter_country = '{code}' AND partner_country {op} '008')::int AS "is_{name}_exporter_{label}_importer" """ for label, op in (("008", "="), ("non008", "<>")) for name, code in _TWO.items()) + " FROM growth")
def _(spark, d):
    return _ints(rounded(design.third_country_panel(chapters(spark, d), "008", *_PERIODS, _IMPORTERS, _TWO), "y"))


@query("sample_report", f"SELECT count(*) AS n_rows, count(*) FILTER ({T} IS NULL) AS dropped_by_{T}, 0::bigint AS dropped_by_log_value FROM chapters")
def _(spark, d):
    return design.sample_report(_data(spark, d), [T, "log_value"])


# One fixed effect (exporter and chapter) and one term: the fit in closed form.
_ONE = f"""{_BASE}, used AS (SELECT *, dense_rank() OVER (ORDER BY reporter_country, product_code) AS g FROM base WHERE {T} IS NOT NULL),
    within AS (SELECT *, {T} - avg({T}) OVER (PARTITION BY g) AS x, log_value - avg(log_value) OVER (PARTITION BY g) AS y FROM used),
    slope AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT g) AS k FROM within),
    errors AS (SELECT w.*, y - b * x AS e, b, sxx, n, n - 1 - k AS dof FROM within w, slope)"""
_EFFECT = ["reporter_country", "product_code"]
_SE = {
    "iid": "sqrt(sum(e * e) / any_value(dof) / any_value(sxx))",
    "hetero": "sqrt(sum(x * x * e * e) * any_value(n) / any_value(dof)) / any_value(sxx)",
}


def _one(spark, d, variance, cluster=None):
    data = design.usable(_data(spark, d), ["log_value", T])
    return absorb.absorbing_ols(data, "log_value", [T], [_EFFECT], variance, cluster)


for _v, _se in _SE.items():

    @query(f"absorb_one_effect_{_v}", f"WITH {_ONE} SELECT '{T}' AS term, {sq('any_value(b)', 'estimate', 8)}, {sq(_se, 'std_error', 8)}, {sq(f'any_value(b) / ({_se})', 't', 5)} FROM errors")
    def _(spark, d, variance=_v):
        table = _one(spark, d, variance).coefficients.select("term", "estimate", "std_error", "t")
        return rounded(rounded(table, "estimate", "std_error", digits=8), "t", digits=5)


@query("absorb_one_effect_cluster", f"""WITH {_ONE}, scores AS (SELECT partner_country, sum(x * e) AS s, any_value(b) AS b, any_value(sxx) AS sxx, any_value(n) AS n, any_value(dof) AS dof FROM errors GROUP BY 1)
    SELECT '{T}' AS term, {sq('any_value(b)', 'estimate', 8)}, {sq('sqrt(sum(s * s) * count(*) / (count(*) - 1) * (any_value(n) - 1) / any_value(dof)) / any_value(sxx)', 'std_error', 8)} FROM scores""")
def _(spark, d):
    table = _one(spark, d, "cluster", ["partner_country"]).coefficients.select("term", "estimate", "std_error")
    return rounded(table, "estimate", "std_error", digits=8)


@query("model_statistics", f"""WITH {_ONE} SELECT any_value(n) AS n, any_value(dof) AS dof, {sq('sqrt(sum(e * e) / any_value(n))', 'rmse', 6)}, {sq('1 - sum(e * e) / (var_pop(log_value) * any_value(n))', 'r2', 8)}, {sq('1 - sum(e * e) / sum(y * y)', 'r2_within', 8)} FROM errors""")
def _(spark, d):
    table = _one(spark, d, "iid").statistics.select("n", "dof", "rmse", "r2", "r2_within")
    return rounded(rounded(table, "rmse", digits=6), "r2", "r2_within", digits=8)


# Regions trade in every year, so demeaning both ways once is exact.
_REGIONS = f"""regions AS (SELECT a.n_regionkey AS seller, b.n_regionkey AS buyer, year, ln(sum(value)) AS y, sum({T} * value) / sum(CASE WHEN {T} IS NOT NULL THEN value END) AS x
      FROM enriched JOIN nation a ON reporter_country = lpad(a.n_nationkey::varchar, 3, '0') JOIN nation b ON partner_country = lpad(b.n_nationkey::varchar, 3, '0') GROUP BY ALL),
    within AS (SELECT x - avg(x) OVER (PARTITION BY seller, buyer) - avg(x) OVER (PARTITION BY year) + avg(x) OVER () AS x,
      y - avg(y) OVER (PARTITION BY seller, buyer) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS y FROM regions),
    errors AS (SELECT x, y - b * x AS e, b, sxx, n, dof FROM within, (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(*) - 1 - 25 - 7 + 1 AS dof FROM within))"""


def _regions(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("c"), "n_regionkey")
    seller = n.select(F.col("c").alias("reporter_country"), F.col("n_regionkey").alias("seller"))
    buyer = n.select(F.col("c").alias("partner_country"), F.col("n_regionkey").alias("buyer"))
    known = F.when(F.col(T).isNotNull(), F.col("value"))
    return star.enriched(spark, d).join(seller, "reporter_country").join(buyer, "partner_country").groupBy("seller", "buyer", "year").agg(
        F.ln(F.sum("value")).alias("y"), (F.sum(F.col(T) * F.col("value")) / F.sum(known)).alias("x"))


@query("absorb_two_effects_balanced", f"WITH {_REGIONS} SELECT 'x' AS term, {sq('any_value(b)', 'estimate', 7)}, {sq(_SE['hetero'], 'std_error', 7)} FROM errors")
def _(spark, d):
    fit = absorb.absorbing_ols(_regions(spark, d), "y", ["x"], [["seller", "buyer"], ["year"]], "hetero")
    return rounded(fit.coefficients.select("term", "estimate", "std_error"), "estimate", "std_error", digits=7)


# Two and three crossing effects: the SQL subtracts level means in turn until nothing moves any more.
def _swept(effects, keep="partner_country"):
    ids = ", ".join(f"dense_rank() OVER (ORDER BY {', '.join(e)}) AS g{i}" for i, e in enumerate(effects))
    gs = ", ".join(f"g{i}" for i in range(len(effects)))
    inner = f"(SELECT i, {keep}, {gs}, x, y, x AS x0, y AS y0 FROM sweep WHERE moved > 1e-10)"
    for f in range(len(effects)):
        inner = f"(SELECT i, {keep}, {gs}, x - avg(x) OVER (PARTITION BY g{f}) AS x, y - avg(y) OVER (PARTITION BY g{f}) AS y, x0, y0 FROM {inner})"
    levels = " + ".join(f"count(DISTINCT g{i})" for i in range(len(effects)))
    return f"""{_BASE}, sweep AS (SELECT 0 AS i, {keep}, {ids}, {T} AS x, log_value AS y, 1.0::double AS moved FROM base WHERE {T} IS NOT NULL
      UNION ALL SELECT i + 1, {keep}, {gs}, x, y, max(greatest(abs(x - x0), abs(y - y0))) OVER () FROM {inner}),
    within AS (SELECT * FROM sweep WHERE i = (SELECT max(i) FROM sweep)),
    slope AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(*) - 1 - ({levels}) + {len(effects) - 1} AS dof FROM within),
    errors AS (SELECT w.*, y - b * x AS e, b, sxx, n, dof FROM within w, slope)"""


_SQL_EFFECTS = [["partner_country", "year", "product_code"], ["partner_country", "reporter_country"], ["reporter_country", "year", "product_code"]]


@query("absorb_two_effects_hetero", f"WITH RECURSIVE {_swept(_SQL_EFFECTS[:2])} SELECT '{T}' AS term, {sq('any_value(b)', 'estimate', 7)}, {sq(_SE['hetero'], 'std_error', 7)} FROM errors")
def _(spark, d):
    data = design.usable(_data(spark, d), ["log_value", T])
    fit = absorb.absorbing_ols(data, "log_value", [T], _SQL_EFFECTS[:2], "hetero")
    return rounded(fit.coefficients.select("term", "estimate", "std_error"), "estimate", "std_error", digits=7)


@query("absorb_three_effects_cluster", f"""WITH RECURSIVE {_swept(_SQL_EFFECTS, 'product_code')}, scores AS (SELECT product_code, sum(x * e) AS s, any_value(b) AS b, any_value(sxx) AS sxx, any_value(n) AS n,
      any_value((SELECT count(*) - 1 - count(DISTINCT g1) FROM within)) AS dof FROM errors GROUP BY 1)
    SELECT '{T}' AS term, {sq('any_value(b)', 'estimate', 7)}, {sq('sqrt(sum(s * s) * count(*) / (count(*) - 1) * (any_value(n) - 1) / any_value(dof)) / any_value(sxx)', 'std_error', 7)} FROM scores""")
def _(spark, d):
    data = design.usable(_data(spark, d), ["log_value", T])
    fit = absorb.absorbing_ols(data, "log_value", [T], _SQL_EFFECTS, "cluster", ["product_code"])
    return rounded(fit.coefficients.select("term", "estimate", "std_error"), "estimate", "std_error", digits=7)


_TWO_WAY = [["importer", "year", "product_code"], ["importer", "exporter"]]
_THREE_WAY = [*_TWO_WAY, ["exporter", "year", "product_code"]]
_KEYS_OF = {"importer": "partner_country", "exporter": "reporter_country"}


# Models with several terms in SQL. A term's coefficient is that of its part which the other terms do not explain, and
# so is its robust variance; the parts come from sweeping terms out of each other in turn.
def _partialled(source, k, over):
    """``source`` with r0, r1, ...: each term less what the others explain."""
    for m in range(k):
        made = []
        for j in range(k):
            order = [*[i for i in range(k) if i != j], j]
            x = f"x{order[m]}"
            less = [f"CASE WHEN sum(o{j}_{n} * o{j}_{n}) OVER {over} > 1e-12 THEN sum({x} * o{j}_{n}) OVER {over} / sum(o{j}_{n} * o{j}_{n}) OVER {over} * o{j}_{n} ELSE 0 END" for n in range(m)]
            made.append(" - ".join([x, *less]) + f" AS o{j}_{m}")
        source = f"(SELECT *, {', '.join(made)} FROM {source})"
    return f"(SELECT *, {', '.join(f'o{j}_{k - 1} AS r{j}' for j in range(k))} FROM {source})"


_NUMBERED = "partner_country AS imp, dense_rank() OVER (PARTITION BY partner_country ORDER BY reporter_country) AS h, "


# Student's t for the degrees of freedom at hand: the upper 2.5% point by its expansion around the normal one.
_Z = 1.959963984540054
_T975 = f"({_Z} + ({_Z}^3 + {_Z}) / (4 * df) + (5 * {_Z}^5 + 16 * {_Z}^3 + 3 * {_Z}) / (96 * df^2) + (3 * {_Z}^7 + 19 * {_Z}^5 + 17 * {_Z}^3 - 15 * {_Z}) / (384 * df^3))"


# Both two-way effects contain the importer: its exporters' effects are the answer of one small system, which is
# solved by elimination. S = N - M' N_g^-1 M holds the exporters, the columns beside it are one right side per variable.
def _eliminated(vs, kept=""):
    """CTEs that make ``within`` from ``used`` (imp, h, g0, g1, raw and ``vs``), where h numbers the exporters of an importer."""
    sums = lambda by, name: f"(SELECT imp, {by}, count(*)::double AS n, {', '.join(f'sum({v}) AS s_{v}' for v in vs)} FROM used GROUP BY ALL) {name}"
    sides = " UNION ALL ".join(f"SELECT imp, h, {-1 - i}, s_{v} - coalesce((SELECT sum(m * b.s_{v} / b.n) FROM overlap c JOIN by_g b ON b.imp = c.imp AND b.g0 = c.g0 WHERE c.imp = by_h.imp AND c.h = by_h.h), 0) FROM by_h" for i, v in enumerate(vs))
    effects = ", ".join(f"max(CASE WHEN j = {-1 - i} THEN v END) AS b_{v}" for i, v in enumerate(vs))
    return f"""overlap AS MATERIALIZED (SELECT imp, g0, h, count(*)::double AS m FROM used GROUP BY ALL),
    by_g AS MATERIALIZED (SELECT * FROM {sums('g0', 'x')}), by_h AS MATERIALIZED (SELECT * FROM {sums('h', 'x')}),
    met AS (SELECT a.imp, a.h AS i, b.h AS j, sum(a.m * b.m / n) AS v FROM overlap a JOIN overlap b ON a.imp = b.imp AND a.g0 = b.g0 JOIN by_g g ON g.imp = a.imp AND g.g0 = a.g0 GROUP BY ALL),
    whole AS MATERIALIZED (SELECT a.imp, a.h AS i, b.h AS j, (CASE WHEN a.h = b.h THEN a.n ELSE 0 END) - coalesce(m.v, 0) AS v FROM by_h a JOIN by_h b ON a.imp = b.imp LEFT JOIN met m ON m.imp = a.imp AND m.i = a.h AND m.j = b.h
      UNION ALL {sides}),
    turned AS (SELECT 1 AS k, * FROM whole UNION ALL
      SELECT k + 1, imp, i, j, CASE WHEN coalesce(corner, 0) < 1e-9 THEN v WHEN i = k THEN v / corner ELSE v - side * line / corner END FROM (SELECT *,
        max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY imp) AS corner, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY imp, i) AS side, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY imp, j) AS line
        FROM turned WHERE k <= (SELECT max(h) FROM by_h))),
    solved AS (SELECT imp, i AS h, {effects} FROM turned WHERE k > (SELECT max(h) FROM by_h) GROUP BY ALL),
    within AS MATERIALIZED (SELECT imp, {kept}g0, g1, raw, {', '.join(f'{v} - avg({v}) OVER (PARTITION BY g0) AS {v}' for v in vs)}
      FROM (SELECT imp, {kept}g0, g1, raw, {', '.join(f'{v} - b_{v} AS {v}' for v in vs)} FROM used JOIN solved USING (imp, h)))"""


def _model(source, outcome, terms, effects, cluster=None, exact=False):
    """CTEs that end in ``coefs`` (term, estimate, std_error, t, p, ci_low, ci_high, n, dof and fit statistics) and need
    WITH RECURSIVE; ``terms`` maps names to expressions over ``source``. ``exact`` solves the two-way effects at once."""
    k, f = len(terms), len(effects)
    named = [[_KEYS_OF.get(c, c) for c in e] for e in effects]
    by = [_KEYS_OF.get(c, c) for c in cluster or []]
    ids = ", ".join(f"dense_rank() OVER (ORDER BY {', '.join(e)}) AS g{i}" for i, e in enumerate(named))
    gs, kept = ", ".join(f"g{i}" for i in range(f)), "".join(f"{c}, " for c in by)
    vs = [*[f"x{j}" for j in range(k)], "y"]
    inner = f"(SELECT i, {kept}{gs}, raw, {', '.join(vs)}, {', '.join(f'{v} AS {v}_0' for v in vs)} FROM sweep WHERE moved > 1e-11)"
    for g in range(f):
        inner = f"(SELECT i, {kept}{gs}, raw, {', '.join(f'{v} - avg({v}) OVER (PARTITION BY g{g}) AS {v}' for v in vs)}, {', '.join(f'{v}_0' for v in vs)} FROM {inner})"
    moved = ", ".join(f"abs({v} - {v}_0)" for v in vs)
    counted = [i for i, e in enumerate(named) if not (by and set(by) <= set(e))]
    levels = " + ".join(f"count(DISTINCT g{i})" for i in counted) or "0"
    # A term without a part of its own is left out.
    beta = ", ".join(f"CASE WHEN sum(r{j} * r{j}) OVER () > 1e-9 THEN sum(r{j} * y) OVER () / sum(r{j} * r{j}) OVER () END AS b{j}" for j in range(k))
    fitted = " + ".join(f"coalesce(b{j}, 0) * x{j}" for j in range(k))
    terms_kept = " - ".join(f"(b{j} IS NOT NULL)::int" for j in range(k))
    if by:
        spread = lambda j: f"(SELECT sum(s * s) * count(*) / (count(*) - 1) FROM (SELECT sum(r{j} * e) AS s FROM errors GROUP BY {', '.join(by)})) * (any_value(n) - 1) / any_value(dof)"
        df = f"(SELECT count(*) - 1 FROM (SELECT DISTINCT {', '.join(by)} FROM errors))"
    else:
        spread, df = (lambda j: f"sum(r{j} * r{j} * e * e) * any_value(n) / any_value(dof)"), "any_value(dof)"
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS term, any_value(b{j}) AS estimate, CASE WHEN any_value(b{j}) IS NOT NULL THEN sqrt({spread(j)}) / sum(r{j} * r{j}) END AS std_error, {df}::double AS df, any_value(n) AS n, any_value(dof) AS dof,"
        f" sum(e * e) AS rss, sum(y * y) AS tss_within, var_pop(raw) * any_value(n) AS tss FROM errors" for j, name in enumerate(terms))
    swept = f"""sweep AS (SELECT 0 AS i, {kept}{gs}, raw, {', '.join(vs)}, 1.0::double AS moved FROM used
      UNION ALL SELECT i + 1, {kept}{gs}, raw, {', '.join(vs)}, max(greatest({moved})) OVER () FROM {inner}),
    within AS (SELECT * FROM sweep WHERE i = (SELECT max(i) FROM sweep))"""
    return f"""used AS (SELECT {kept}{_NUMBERED if exact else ''}{ids}, {', '.join(f'({x})::double AS x{j}' for j, x in enumerate(terms.values()))}, {outcome} AS y, {outcome} AS raw FROM {source}),
    {_eliminated(vs, kept) if exact else swept},
    sized AS (SELECT count(*) AS n, count(*) - ({levels}) + {max(len(counted) - 1, 0)} AS dof_all FROM within),
    errors AS (SELECT *, dof_all - {terms_kept} AS dof, y - ({fitted}) AS e FROM (SELECT *, {beta} FROM {_partialled('within', k, '()')}), sized),
    raw_coefs AS ({rows}),
    coefs AS (SELECT *, {student_p('t', 'df')} AS p, estimate - {_T975} * std_error AS ci_low, estimate + {_T975} * std_error AS ci_high FROM (SELECT *, estimate / std_error AS t FROM raw_coefs))"""


def _years_of(condition, name="direct"):
    return {f"{name}_{y}": f"CASE WHEN {condition} AND year = {y} THEN tau ELSE 0.0 END" for y in YEARS}


_COEFS = f"{sqs('estimate', 'std_error', digits=6)}, {sqs('t', digits=4)}, {sqs('p', 'ci_low', 'ci_high', digits=5)}"
_DIRECT = _years_of(f"partner_country = '{I}' AND reporter_country = '{E}'")
_DIRECT_SQL = f"WITH RECURSIVE {_BASE}, {_model('treated', 'log_value', _DIRECT, _TWO_WAY)} "


def _tidy(table, *more):
    out = table.select("term", *more, "estimate", "std_error", "t", "p", "ci_low", "ci_high")
    return rounded(rounded(rounded(out, "estimate", "std_error", digits=6), "t", digits=4), "p", "ci_low", "ci_high", digits=5)


def _direct(spark, d, outcome="log_value", importers=(I,)):
    return design.interaction_panel(_data(spark, d), "direct", list(importers), [E], YEARS, outcome, treated_pair=PAIR)


@query("direct_effect_two_way", _DIRECT_SQL + f"SELECT term, {_COEFS} FROM coefs")
def _(spark, d):
    m = _direct(spark, d)
    return _tidy(absorb.absorbing_ols(m.data, "log_value", m.terms, _TWO_WAY, "hetero", labels=m.labels).coefficients)


@query("direct_effect_three_way_clustered", f"WITH RECURSIVE {_BASE}, {_model('treated', 'log_value', _DIRECT, _THREE_WAY, ['product_code', 'importer'])} SELECT term, {_COEFS} FROM coefs")
def _(spark, d):
    m = _direct(spark, d)
    return _tidy(absorb.absorbing_ols(m.data, "log_value", m.terms, _THREE_WAY, "cluster", ["product_code", "importer"], labels=m.labels).coefficients)


@query("direct_effect_statistics", _DIRECT_SQL + f"SELECT DISTINCT n, dof, {sq('sqrt(rss / n)', 'rmse', 6)}, {sq('1 - rss / tss', 'r2', 7)}, {sq('1 - rss / tss_within', 'r2_within', 7)} FROM coefs WHERE term = 'direct_1998'")
def _(spark, d):
    m = _direct(spark, d)
    table = absorb.absorbing_ols(m.data, "log_value", m.terms, _TWO_WAY, "hetero").statistics.select("n", "dof", "rmse", "r2", "r2_within")
    return rounded(rounded(table, "rmse", digits=6), "r2", "r2_within", digits=7)


def _cumulative(n):
    return f"SELECT '{'+'.join('^'.join(e) for e in _THREE_WAY[:n])}' AS model, term, {_COEFS} FROM (WITH RECURSIVE {_model('treated', 'log_value', _DIRECT, _THREE_WAY[:n])} SELECT * FROM coefs)"


@query("cumulative_fixed_effects", f"WITH {_BASE} {_cumulative(1)} UNION ALL {_cumulative(2)} UNION ALL {_cumulative(3)}")
def _(spark, d):
    m = _direct(spark, d)
    return _tidy(absorb.cumulative_effects(m.data, "log_value", m.terms, _THREE_WAY, "hetero"), "model")


def _saturated(spark, d, outcome):
    m = design.saturated_panel(_data(spark, d), YEARS, outcome, treated_pair=PAIR)
    return absorb.absorbing_ols(m.data, outcome, m.terms, _TWO_WAY, "hetero", labels=m.labels, model=outcome, families=m.families).coefficients


# The saturated model in SQL: an importer's terms meet only its own rows and levels, so each importer has three terms of its own.
def _saturated_sql(outcome):
    xs = [f"CASE WHEN reporter_country = '{E}' AND partner_country NOT IN ('{E}', '{I}') AND year = {y} THEN tau ELSE 0.0 END" for y in YEARS]
    ids = "dense_rank() OVER (ORDER BY partner_country, year, product_code) AS g0, dense_rank() OVER (ORDER BY partner_country, reporter_country) AS g1"
    own = "sum(r{j} * r{j}) OVER w > 1e-9 * sum(raw{j} * raw{j}) OVER w AND sum(raw{j} * raw{j}) OVER w > 0"
    beta = ", ".join(f"CASE WHEN {own.format(j=j)} THEN sum(r{j} * y) OVER w / sum(r{j} * r{j}) OVER w END AS b{j}" for j in range(3))
    rows = " UNION ALL ".join(
        f"SELECT imp AS country, {y} AS year, any_value(b{j}) AS estimate, sqrt(sum(r{j} * r{j} * e * e) * any_value(n) / any_value(dof)) / sum(r{j} * r{j}) AS std_error FROM errors WHERE b{j} IS NOT NULL GROUP BY imp" for j, y in enumerate(YEARS))
    carried = "raw0, raw1, raw2, "
    return f"""(WITH RECURSIVE used AS (SELECT {_NUMBERED}{ids}, {', '.join(f'{x} AS x{j}, {x} AS raw{j}' for j, x in enumerate(xs))}, {outcome} AS y, {outcome} AS raw FROM treated),
    {_eliminated(['x0', 'x1', 'x2', 'y'], carried)},
    fitted AS (SELECT *, {beta} FROM {_partialled('within', 3, '(PARTITION BY imp)')} WINDOW w AS (PARTITION BY imp)),
    sized AS (SELECT count(*) AS n, count(*) - count(DISTINCT g0) - count(DISTINCT g1) + 1 - (SELECT sum((c0 > 0)::int + (c1 > 0)::int + (c2 > 0)::int) FROM (SELECT imp, count(b0) AS c0, count(b1) AS c1, count(b2) AS c2 FROM fitted GROUP BY imp)) AS dof FROM fitted),
    errors AS (SELECT *, y - (coalesce(b0, 0) * x0 + coalesce(b1, 0) * x1 + coalesce(b2, 0) * x2) AS e FROM fitted, sized)
    {rows})"""


def _averaged_sql(name, source):
    weight = "CASE year " + " ".join(f"WHEN {y} THEN {w}" for y, w in _WEIGHTS.items()) + " END"
    return f"(SELECT country, 100 * sum(estimate * {weight}) AS average_coefficient_{name}, 100 * sum(std_error * {weight}) AS linear_std_error_{name} FROM {source} GROUP BY country)"


def _direct_sql(outcome):
    return f"(SELECT '{I}' AS country, right(term, 4)::int AS year, estimate, std_error FROM (WITH RECURSIVE {_model('treated', outcome, _DIRECT, _TWO_WAY, exact=True)} SELECT * FROM coefs))"


_WEIGHTS = {1998: 0.25, 1999: 0.75, 2000: 0.0}
_AVERAGED = [f"{x}_{o}" for o in ("value", "quantity") for x in ("average_coefficient", "linear_std_error")]
_AVERAGES_SQL = " UNION ALL ".join(
    f"SELECT country, {sqs(*_AVERAGED, digits=4)} FROM {_averaged_sql('value', make('log_value'))} FULL JOIN {_averaged_sql('quantity', make('log_quantity'))} USING (country)"
    for make in (_saturated_sql, _direct_sql))


@query("average_coefficients_by_country", f"WITH {_BASE} {_AVERAGES_SQL}")
def _(spark, d):
    merged = coefficients.weighted_averages({o: _saturated(spark, d, f"log_{o}") for o in ("value", "quantity")}, _WEIGHTS)
    direct = {}
    for o in ("value", "quantity"):
        m = _direct(spark, d, f"log_{o}")
        direct[o] = absorb.absorbing_ols(m.data, f"log_{o}", m.terms, _TWO_WAY, "hetero", labels={t: (I, y) for t, (_, y) in m.labels.items()}).coefficients
    return rounded(coefficients.append_missing(merged, coefficients.weighted_averages(direct, _WEIGHTS)), *_AVERAGED)


@query("elasticity_by_year", _DIRECT_SQL + f"SELECT 'model' AS model, term, right(term, 4)::int AS year, {sq('estimate * 100', 'elasticity', 4)}, {sq('ci_high * 100', 'bound_low', 3)}, {sq('ci_low * 100', 'bound_high', 3)} FROM coefs")
def _(spark, d):
    m = _direct(spark, d)
    table = coefficients.elasticity(absorb.absorbing_ols(m.data, "log_value", m.terms, _TWO_WAY, "hetero", labels=m.labels).coefficients)
    return rounded(rounded(table, "elasticity"), "bound_low", "bound_high", digits=3)


@query("coefficients_with_name_parts", _DIRECT_SQL + f"SELECT term, 'direct' AS country, right(term, 4)::int AS year, {sq('estimate', 'estimate', 6)} FROM coefs")
def _(spark, d):
    m = _direct(spark, d)
    table = absorb.absorbing_ols(m.data, "log_value", m.terms, _TWO_WAY, "hetero").coefficients.drop("country", "year")
    return rounded(coefficients.with_name_parts(table, r"([a-z]+)_(\d{4})").select("term", "country", "year", "estimate"), "estimate", digits=6)


def _by_country(spark, d):
    """One model per importer, all of them on one sample: three terms each, demeaned together."""
    data = design.usable(design.with_roles(design.treatment_rate(_data(spark, d), *PAIR)), ["log_value", design.TREATMENT])
    importers = [r[0] for r in data.select("importer").distinct().orderBy("importer").collect()]  # the country list
    made = design.importer_years(data, "direct", importers, YEARS, F.col("exporter") == E)
    models = [absorb.Model(c, "log_value", [f"direct_{c}_{y}" for y in YEARS], made.labels) for c in importers]
    fits = absorb.fit_models(made.data, models, [["exporter", "year", "product_code"]], "hetero", families=made.families)
    out = fits[0].coefficients
    for fit in fits[1:]:
        out = out.unionByName(fit.coefficients)
    return out


# One fixed effect: means of groups are enough. Each country's three terms are in rows of their own country column.
_COUNTRY_COEFS = f"""{_BASE}, countries AS (SELECT DISTINCT partner_country AS model FROM treated),
    flagged AS (SELECT c.model, dense_rank() OVER (ORDER BY reporter_country, year, product_code) AS g, log_value AS y,
      {', '.join(f"CASE WHEN partner_country = c.model AND reporter_country = '{E}' AND year = {y} THEN tau ELSE 0.0 END AS x{j}" for j, y in enumerate(YEARS))} FROM treated, countries c),
    within AS (SELECT model, g, y - avg(y) OVER w AS y, {', '.join(f'x{j} - avg(x{j}) OVER w AS x{j}, x{j} AS raw{j}' for j in range(3))} FROM flagged WINDOW w AS (PARTITION BY model, g)),
    sized AS (SELECT model, count(*) AS n, count(DISTINCT g) AS levels FROM within GROUP BY 1),
    errors AS (SELECT f.*, n, levels, n - levels - {' - '.join(f'(any_x{j})::int' for j in range(3))} AS dof,
      y - ({' + '.join(f'coalesce(b{j}, 0) * x{j}' for j in range(3))}) AS e
      FROM (SELECT *, {', '.join(f'CASE WHEN sum(r{j} * r{j}) OVER w > 1e-9 * sum(raw{j} * raw{j}) OVER w THEN sum(r{j} * y) OVER w / sum(r{j} * r{j}) OVER w END AS b{j}, sum(r{j} * r{j}) OVER w > 1e-9 * sum(raw{j} * raw{j}) OVER w AS any_x{j}' for j in range(3))}
            FROM {_partialled('within', 3, '(PARTITION BY model)')} WINDOW w AS (PARTITION BY model)) f JOIN sized USING (model)),
    raw_coefs AS ({' UNION ALL '.join(f"SELECT model, 'direct_' || model || '_{y}' AS term, {y} AS year, any_value(b{j}) AS estimate, sqrt(sum(r{j} * r{j} * e * e) * any_value(n) / any_value(dof)) / nullif(sum(r{j} * r{j}), 0) AS std_error, any_value(dof)::double AS df FROM errors GROUP BY model HAVING any_value(b{j}) IS NOT NULL" for j, y in enumerate(YEARS))}),
    coefs AS (SELECT *, estimate - {_T975} * std_error AS ci_low, estimate + {_T975} * std_error AS ci_high FROM raw_coefs)"""


@query("models_per_country", f"WITH {_COUNTRY_COEFS} SELECT model, term, year, {sqs('estimate', 'std_error', digits=6)}, {sqs('ci_low', 'ci_high', digits=5)} FROM coefs")
def _(spark, d):
    table = _by_country(spark, d).filter("NOT dropped").select("model", "term", "year", "estimate", "std_error", "ci_low", "ci_high")
    return rounded(rounded(table, "estimate", "std_error", digits=6), "ci_low", "ci_high", digits=5)


@query("elasticity_of_two_countries", f"WITH {_COUNTRY_COEFS} SELECT model, term, year, {sq('abs(estimate)', 'elasticity', 6)}, {sq('-ci_high', 'bound_low', 5)}, {sq('-ci_low', 'bound_high', 5)} FROM coefs")
def _(spark, d):
    table = coefficients.elasticity_of_models([_by_country(spark, d)])
    return rounded(rounded(table, "elasticity", digits=6), "bound_low", "bound_high", digits=5)


_CODES = [f"{c:03d}" for c in range(25)]  # every country of the test tables


@query("models_per_country_side_by_side", f"""WITH {_COUNTRY_COEFS} SELECT year, {', '.join(f"max(CASE WHEN model = '{c}' THEN {sq('estimate', 'x', 6).removesuffix(' AS x')} END) AS m_{c}" for c in _CODES)} FROM coefs GROUP BY year""")
def _(spark, d):
    table = rounded(_by_country(spark, d).filter("NOT dropped").withColumn("term", F.col("year")), "estimate", digits=6)
    wide = coefficients.side_by_side([table])
    return wide.select(F.col("term").alias("year"), *[(F.col(c) if c in wide.columns else F.lit(None).cast("double")).alias(f"m_{c}") for c in _CODES])


_EVENT_TERMS = {f"is_{name}_exporter_{label}_importer_x_PostEvent": f"""(reporter_country = '{code}' AND partner_country {op} '008')::int * "PostEvent" """ for label, op in (("008", "="), ("non008", "<>")) for name, code in _TWO.items()}
_EVENT_EFFECTS = [["reporter_country"], ["PostEvent"], ["partner_country"]]


@query("event_dummies_third_country", f"""WITH RECURSIVE {_GROWTH}, events AS (SELECT * RENAME (y AS growth) FROM growth), {_model('events', 'growth', _EVENT_TERMS, [['reporter_country'], ['"PostEvent"'], ['partner_country']])} SELECT term, {_COEFS} FROM coefs""")
def _(spark, d):
    panel = design.third_country_panel(chapters(spark, d), "008", *_PERIODS, _IMPORTERS, _TWO)
    m = design.multiply(panel, [c for c in panel.columns if c.startswith("is_")])
    return _tidy(absorb.absorbing_ols(m.data, "y", m.terms, _EVENT_EFFECTS, "hetero").coefficients)


# The panel itself, on six-digit products.
_SIX = f"""whole_panel AS (SELECT *, ln(value) AS log_value FROM enriched WHERE {T} IS NOT NULL)"""


@query("six_digit_two_way", f"WITH RECURSIVE {_SIX}, {_model('whole_panel', 'log_value', {T: T}, _TWO_WAY, exact=True)} SELECT term, {_COEFS} FROM coefs")
def _(spark, d):
    data = design.with_roles(design.add_logs(star.enriched(spark, d)))
    return _tidy(absorb.absorbing_ols(data, "log_value", [T], _TWO_WAY, "hetero").coefficients)


@query("rows_with_missing_keys_and_values", f"""WITH RECURSIVE gaps AS (SELECT * REPLACE (
      CASE WHEN year = 1996 AND product_code LIKE '01%' THEN NULL ELSE log_value END AS log_value, CASE WHEN reporter_country = '004' THEN NULL ELSE reporter_country END AS reporter_country,
      CASE WHEN partner_country = '005' THEN NULL ELSE {T} END AS {T}) FROM (SELECT * REPLACE ({T} / 1e4 AS {T}), ln(value) AS log_value FROM chapters)),
    sample AS (SELECT * FROM gaps WHERE log_value IS NOT NULL AND reporter_country IS NOT NULL AND {T} IS NOT NULL), {_model('sample', 'log_value', {T: T}, _TWO_WAY)}
    SELECT term, {_COEFS}, (SELECT count(*) FROM gaps) - n AS left_out FROM coefs""")
def _(spark, d):
    data = design.with_roles(_data(spark, d)).withColumns({
        "log_value": F.when(~((F.col("year") == 1996) & (F.substring("product_code", 1, 2) == "01")), F.col("log_value")),
        "exporter": F.when(F.col("exporter") != "004", F.col("exporter")), T: F.when(F.col("importer") != "005", F.col(T)),
    })
    fit = absorb.absorbing_ols(data, "log_value", [T], _TWO_WAY, "hetero")
    return _tidy(fit.coefficients).crossJoin(fit.statistics.select("left_out"))


_LINE = "lines AS (SELECT regr_slope(v, q) AS by_, regr_intercept(v, q) AS ay, regr_slope(q, v) AS bx, regr_intercept(q, v) AS ax FROM totals)"


@query("residuals_both_ways", f"""WITH totals AS (SELECT partner_country, ln(sum(value)) AS v, ln(sum(quantity)) AS q FROM flows GROUP BY 1), {_LINE}
    SELECT partner_country, {sq('v - (ay + by_ * q)', 'y_residuals', 7)}, {sq('q - (ax + bx * v)', 'x_residuals', 7)} FROM totals, lines""")
def _(spark, d):
    totals = star.flows(spark, d).groupBy("partner_country").agg(F.ln(F.sum("value")).alias("v"), F.ln(F.sum("quantity")).alias("q"))
    return rounded(coefficients.residuals_both_ways(totals, "q", "v").drop("v", "q"), "y_residuals", "x_residuals", digits=7)
