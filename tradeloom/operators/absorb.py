"""Least squares with absorbed fixed effects.

A row's terms are kept sparse, as (column number, value) pairs without zeros, and so is everything that is made of them:
sums per fixed-effect level, the levels' effects and the demeaned rows. A model with a term per country and
year costs what its rows' few non-zero terms cost, and the plans do not grow with the number of terms.

Level effects are solved in the same way at every size: the fixed effect with the most levels is eliminated, and the
system that is left, on the levels of the others, is solved by conjugate gradients as joins and sums over pairs of
levels. Pairs are stored twice, in buckets of either side, so that a round shuffles sums that belong to levels and
never the pairs. Only arrays of the size of the coefficient matrix reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tradeloom.functions.columns import is_number
from tradeloom.functions.joins import attach
from tradeloom.operators.students_t import t_quantile, two_sided_p
from tradeloom.session import Workspace, small_table

#: Conjugate gradients end when every column's residual has shrunk by this factor, or raise after so many rounds.
TOLERANCE, MAX_ROUNDS = 1e-10, 1000
#: Most terms of one model: its matrix of squares is inverted on the driver.
MAX_TERMS = 4096
SMALL_SAMPLE = ("none", "non-nested", "all", "rank")
SINGLETONS = ("keep", "drop")


class NotConverged(RuntimeError):
    """The level effects did not reach the tolerance in the allowed rounds."""


@dataclass
class Model:
    """One regression: its name, outcome, terms, and each term's country and year."""

    name: str
    outcome: str
    terms: list[str]
    labels: dict[str, tuple[str | None, int | None]] = field(default_factory=dict)


@dataclass
class Family:
    """Terms of which a row has at most one: column ``at`` holds its place in ``names``, NULL for none, and ``value`` its value."""

    at: str
    value: str
    names: list[str]


@dataclass
class Fit:
    """A fitted model: coefficient and statistics tables, and their numbers."""

    coefficients: DataFrame
    statistics: DataFrame
    terms: list[str]
    estimate: np.ndarray
    covariance: np.ndarray
    dropped: list[str] = field(default_factory=list)
    rounds: int = 0


# Sparse rows


def _numbered(models: list[Model], families: list[Family]) -> dict[str, int]:
    """A number per column: plain columns first, then every family's terms one after the other."""
    in_family = {n for f in families for n in f.names}
    plain = [c for c in dict.fromkeys(c for m in models for c in (m.outcome, *m.terms)) if c not in in_family]
    return {c: i for i, c in enumerate([*plain, *[n for f in families for n in f.names]])}


def _entries(numbers: dict[str, int], plain: list[str], families: list[Family]) -> Column:
    """A row's non-zero columns as an array of (c, v)."""
    parts = [F.struct(F.lit(numbers[c]).alias("c"), F.col(c).cast("double").alias("v")) for c in plain]
    parts += [F.struct((F.lit(numbers[f.names[0]]) + F.col(f.at)).cast("int").alias("c"), F.col(f.value).cast("double").alias("v")) for f in families if f.names]
    return F.filter(F.array(*parts), lambda e: e["c"].isNotNull() & (e["v"] != 0))


def _complete(plain: list[str], keys: list[str], families: list[Family]) -> Column:
    known = [*[is_number(c) for c in plain], *[F.col(c).isNotNull() for c in keys], *[F.col(f.at).isNull() | is_number(f.value) for f in families]]
    return reduce(lambda a, b: a & b, known, F.lit(True))


def _with_level_ids(data: DataFrame, effects: list[list[str]]) -> DataFrame:
    """A 64-bit id per fixed-effect level, as ``_g0, _g1, ...``; keys must not be NULL, as hashes skip NULLs."""
    return data.withColumns({f"_g{f}": F.xxhash64(F.lit(f), *[F.col(c) for c in keys]) for f, keys in enumerate(effects)})


# Level sums


def _level_sizes(rows: DataFrame, effects: list[list[str]], work: Workspace) -> tuple[DataFrame, list[int]]:
    """Rows of every level (f, g, n), and the number of levels per fixed effect.

    A second hash of the keys shows whether two levels share an id.
    """
    parts = []
    for f, keys in enumerate(effects):
        check = F.xxhash64(F.lit("check"), F.lit(f), *[F.col(c) for c in keys])
        level = rows.groupBy(F.col(f"_g{f}").alias("g")).agg(F.count("*").cast("double").alias("n"), (F.min(check) != F.max(check)).alias("clash"))
        parts.append(level.select(F.lit(f).alias("f"), "g", "n", "clash"))
    table = work.write(reduce(DataFrame.unionAll, parts))
    counts = {r["f"]: r for r in table.groupBy("f").agg(F.count("*").alias("n"), F.count_if("clash").alias("clashes")).collect()}
    shared = [effects[f] for f, r in counts.items() if r["clashes"]]
    if shared:
        raise ValueError(f"two levels of {shared} have the same 64-bit id")
    return table.drop("clash"), [counts[f]["n"] if f in counts else 0 for f in range(len(effects))]


def _level_sums(rows: DataFrame, count: int) -> DataFrame:
    """Sum of every column over every level, where the level has that column: (f, g, c, s)."""
    parts = []
    for f in range(count):
        entries = rows.select(F.col(f"_g{f}").alias("g"), F.explode("_x").alias("e"))
        parts.append(entries.groupBy("g", F.col("e.c").alias("c")).agg(F.sum("e.v").alias("s")).select(F.lit(f).alias("f"), "g", "c", "s"))
    return reduce(DataFrame.unionAll, parts)


def _pair_counts(rows: DataFrame, pairs: list[tuple[int, int]], a: str, b: str) -> DataFrame:
    """Rows shared by two levels, each pair of fixed effects in one direction."""
    both = F.explode(F.array(*[F.struct(F.col(f"_g{i}").alias(a), F.col(f"_g{j}").alias(b)) for i, j in pairs])).alias("l")
    return rows.select(both).groupBy(f"l.{a}", f"l.{b}").agg(F.count("*").cast("double").alias("m"))


def without_singletons(rows: DataFrame, count: int, work: Workspace) -> tuple[DataFrame, int]:
    """Rows without those that are alone in a level, again and again until every level has two rows or more; and how many left.

    Works on cells, the combinations of levels that occur; a row alone in a level is alone in its cell.
    """
    ids = [f"_g{f}" for f in range(count)]
    cells, gone = work.write(rows.groupBy(*ids).agg(F.count("*").alias("n"))), []
    while True:
        alone = []
        for g in ids:
            single = cells.groupBy(g).agg(F.sum("n").alias("t")).filter("t = 1").select(g)
            alone.append(cells.join(single, g, "left_semi").select(*ids))
        leaving = work.write(reduce(DataFrame.unionAll, alone).distinct())
        if leaving.isEmpty():
            break
        gone.append(leaving)
        before, cells = cells, work.write(cells.join(leaving, ids, "left_anti"))
        work.drop(before)
    if not gone:
        return rows, 0
    out = reduce(DataFrame.unionAll, gone)
    return rows.join(out, ids, "left_anti"), out.count()


def linked_groups(edges: DataFrame, nodes: int, work: Workspace) -> int:
    """Connected components of a graph with ``edges`` (a, b) on ``nodes`` nodes, none of them without an edge.

    Every node hooks onto its least smaller neighbour, hooks are followed to their ends, and the edges move there;
    each hook joins two components. Their number halves at least in every turn.
    """
    hooks = 0
    edges = work.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while not edges.isEmpty():
        jumps = work.write(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        hooks += jumps.count()
        while True:
            onward = jumps.select(F.col("node").alias("to"), F.col("to").alias("end"))
            further = work.write(attach(jumps, onward, ["to"]).select("node", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")))
            moved = further.filter("moved").isEmpty()
            work.drop(jumps)
            jumps = further
            if moved:
                break
        at = lambda end: jumps.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
        met = attach(attach(edges, at("a"), ["a"]), at("b"), ["b"]).select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        before, edges = edges, work.write(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
        work.drop(before, jumps)
    work.drop(edges)
    return nodes - hooks


def absorbed_rank(rows: DataFrame, levels: list[int], work: Workspace) -> int:
    """Rank of the dummies of all levels: exact for two fixed effects, at most too high by further dependences for three or more.

    Two effects lose one level per connected component of their graph; a further effect loses the components it has
    with the earlier effect that gives most.
    """
    rank = levels[0]
    for f in range(1, len(levels)):
        lost = [linked_groups(_pair_counts(rows, [(e, f)], "a", "b").select("a", "b"), levels[e] + levels[f], work) for e in range(f)]
        rank += levels[f] - max(lost)
    return rank


# Level effects


class Normal:
    """Normal equations of the level effects with the largest fixed effect eliminated: ``S = N - M' N_L^-1 M`` on the others' levels.

    ``g`` is a level of the largest effect, ``h`` one of the others. The pairs are kept in buckets of ``h``, where
    directions meet them, and in buckets of ``g``, where the sums at the largest effect's levels do.
    """

    def __init__(self, rows: DataFrame, sizes: DataFrame, levels: list[int], work: Workspace) -> None:
        self.largest = levels.index(max(levels))
        others = [f for f in range(len(levels)) if f != self.largest]
        self.of_g = sizes.filter(F.col("f") == self.largest).select("g", F.col("n").alias("n_g"))
        of_h = sizes.filter(F.col("f").isin(others)).select(F.col("g").alias("h"), "n")
        counted = attach(_pair_counts(rows, [(self.largest, f) for f in others], "g", "h"), self.of_g, ["g"], "inner")
        pairs = work.write(counted.select("g", "h", "m", (F.col("m") / F.col("n_g")).alias("share")))
        met = pairs.count()
        own = pairs.groupBy("h").agg(F.sum(F.col("m") * F.col("share")).alias("less"))
        left = F.col("n") - F.coalesce("less", F.lit(0.0))
        scale = F.when(left > 1e-9 * F.col("n"), left).otherwise(F.col("n"))  # a level that lies inside levels of the largest
        self.scale = work.write(of_h.join(own, "h", "left").select("h", "n", scale.alias("d")))
        self.by_h = work.write_bucketed(pairs.select("h", "g", "m"), "h", met)
        self.by_g = work.write_bucketed(attach(pairs, self.scale, ["h"], "inner").select("g", "h", "share", "n", "d"), "g", met)
        self.among = None
        if len(others) > 1:
            one_way = work.write(_pair_counts(rows, [(i, j) for i in others for j in others if i < j], "a", "b"))
            both = one_way.select(F.col("a").alias("from"), F.col("b").alias("h"), "m").unionAll(one_way.select(F.col("b").alias("from"), F.col("a").alias("h"), "m"))
            self.among = work.write_bucketed(attach(both, self.scale, ["h"], "inner"), "from", 2 * one_way.count())
            work.drop(one_way)
        work.drop(pairs)

    def across(self, values: DataFrame) -> DataFrame:
        """What ``S`` adds off its diagonal to ``values`` (h, c, p), before it is summed: (h, c, q, n, d)."""
        at_g = attach(self.by_h, values, ["h"], "inner").groupBy("g", "c").agg(F.sum(F.col("m") * F.col("p")).alias("u"))
        out = attach(self.by_g, at_g, ["g"], "inner").select("h", "c", (-F.col("share") * F.col("u")).alias("q"), "n", "d")
        if self.among is None:
            return out
        met = attach(self.among, values.withColumnRenamed("h", "from"), ["from"], "inner")
        return out.unionAll(met.select("h", "c", (F.col("m") * F.col("p")).alias("q"), "n", "d"))

    def right_side(self, sums: DataFrame) -> DataFrame:
        """(h, c, n, d, r): level sums of the others less their share of the largest effect's."""
        of_largest = sums.filter(F.col("f") == self.largest).select("g", "c", "s")
        less = attach(self.by_g, of_largest, ["g"], "inner").select("h", "c", (-F.col("share") * F.col("s")).alias("r"))
        own = sums.filter(F.col("f") != self.largest).select(F.col("g").alias("h"), "c", F.col("s").alias("r"))
        return attach(own.unionAll(less).groupBy("h", "c").agg(F.sum("r").alias("r")), self.scale, ["h"], "inner").select("h", "c", "n", "d", "r")

    def rest(self, sums: DataFrame, solved: DataFrame) -> DataFrame:
        """Effects (g, c, a) of the largest effect's levels, from those of all others."""
        taken = attach(self.by_h, solved, ["h"], "inner").select("g", "c", (-F.col("m") * F.col("a")).alias("s"))
        own = sums.filter(F.col("f") == self.largest).select("g", "c", "s")
        return attach(own.unionAll(taken).groupBy("g", "c").agg(F.sum("s").alias("s")), self.of_g, ["g"], "inner").select("g", "c", (F.col("s") / F.col("n_g")).alias("a"))


def next_state(system: Normal, moving: DataFrame) -> DataFrame:
    """One product: (h, c) with n, d, effect a, residual r, direction p and q = S p."""
    none = F.lit(0.0)
    met = system.across(moving.filter("p <> 0").select("h", "c", "p")).select("h", "c", "q", "n", "d", none.alias("a"), none.alias("r"), none.alias("p"))
    own = moving.select("h", "c", (F.col("n") * F.col("p")).alias("q"), "n", "d", "a", "r", "p")
    return own.unionAll(met).groupBy("h", "c").agg(*[F.max(x).alias(x) for x in "nd"], *[F.sum(x).alias(x) for x in "arpq"])


def _solve(system: Normal, sums: DataFrame, work: Workspace, tolerance: float, max_rounds: int, start: DataFrame | None) -> tuple[DataFrame, int]:
    """Effects (g, c, a) of all levels by conjugate gradients, column by column at once.

    Step lengths travel as a table with one row per column. ``start`` has effects to begin from; the
    tolerance is relative to the right side, wherever the rounds begin.
    """
    state = work.write(system.right_side(sums))
    first: dict[int, float] = {}
    begun = state.withColumn("a", F.lit(0.0))
    if start is not None:
        first = {r["c"]: r["rr"] or 1.0 for r in state.groupBy("c").agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rr")).collect()}
        given = work.write(attach(start.withColumnRenamed("g", "h"), system.scale, ["h"], "inner").select("h", "c", "n", "d", "a"))
        at = ["h", "c", "n", "d", "r", "a"]
        back = given.withColumn("r", -F.col("n") * F.col("a")).select(*at)
        crossed = system.across(given.select("h", "c", F.col("a").alias("p"))).select("h", "c", "n", "d", (-F.col("q")).alias("r"), F.lit(0.0).alias("a"))
        begun = begun.select(*at).unionAll(back).unionAll(crossed).groupBy("h", "c").agg(*[F.max(x).alias(x) for x in "nd"], *[F.sum(x).alias(x) for x in "ra"])
    moving = begun.withColumn("p", F.col("r") / F.col("d"))
    rounds = 0
    while True:
        written = work.write(next_state(system, moving))
        work.drop(state)
        state = written
        dots = [F.sum(F.col(a) * F.col(b) / F.col("d")).alias(a + b) for a, b in ("rr", "rq", "qq")]
        steps, worst = [], 0.0
        for x in state.groupBy("c").agg(*dots, F.sum(F.col("p") * F.col("q")).alias("pq")).collect():
            if start is None and not rounds:
                first[x["c"]] = x["rr"] or 1.0
            enough = tolerance**2 * first.get(x["c"], 1.0)
            live = x["rr"] > enough and x["pq"] > 0
            step = x["rr"] / x["pq"] if live else 0.0
            ahead = max(x["rr"] - 2 * step * x["rq"] + step * step * x["qq"], 0.0)
            done = not live or ahead <= enough
            steps.append((x["c"], step, 0.0 if done else ahead / x["rr"], 0.0 if done else 1.0))
            worst = worst if done else max(worst, ahead / first.get(x["c"], 1.0))
        # One row per column of the fit, so at most MAX_TERMS a model.
        stepped = state.join(F.broadcast(small_table(state.sparkSession, steps, "c int, step double, turn double, on double")), "c")
        stepped = stepped.select("h", "c", "n", "d", (F.col("a") + F.col("step") * F.col("p")).alias("a"), (F.col("r") - F.col("step") * F.col("q")).alias("r"), "p", "turn", "on")
        moving = stepped.select("h", "c", "n", "d", "a", "r", (F.col("on") * (F.col("r") / F.col("d") + F.col("turn") * F.col("p"))).alias("p"))
        rounds += 1
        if not worst:
            break
        if rounds >= max_rounds:
            raise NotConverged(f"level effects: residual {worst**0.5:.2g} of the first after {rounds} rounds, asked for {tolerance:.2g}")
    solved = work.write(moving.select("h", "c", "a"))
    work.drop(state)
    effects = work.write(solved.withColumnRenamed("h", "g").unionAll(system.rest(sums, solved)))
    work.drop(solved)
    return effects, rounds


# Demeaned rows


def _less_effects(effects: int, kept: list[str], k: int):
    """Rows' columns less their levels' effects, as ascending column numbers and values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols, vals = [], [], []
            for name in ("_x", *[f"_e{f}" for f in range(effects)]):
                lists = batch.column(name)
                flat = lists.flatten()
                at.append(np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy()))
                cols.append(flat.field("c").to_numpy())
                vals.append(flat.field("v").to_numpy() * (1.0 if name == "_x" else -1.0))
            key = np.concatenate(at) * k + np.concatenate(cols)
            order = np.argsort(key, kind="stable")
            key, v = key[order], np.concatenate(vals)[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            total = np.add.reduceat(v, starts) if len(starts) else np.zeros(0)
            offsets = pa.array(np.searchsorted(key[starts], np.arange(batch.num_rows + 1) * k), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((key[starts] % k).astype(np.int32), total)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *lists], names=[*kept, "_cols", "_vals"])

    return run


def _demeaned(rows: DataFrame, effects: DataFrame, count: int, kept: list[str], k: int, work: Workspace) -> DataFrame:
    """``kept`` columns and the demeaned columns; a level has at most one effect per column, a row's levels join one after the other."""
    packed = work.write(effects.groupBy("g").agg(F.collect_list(F.struct("c", F.col("a").alias("v"))).alias("e")))
    out = rows
    for f in range(count):
        out = attach(out, packed.select(F.col("g").alias(f"_g{f}"), F.col("e").alias(f"_e{f}")), [f"_g{f}"])
    given = out.select(*kept, "_x", *[f"_e{f}" for f in range(count)])
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema if f.name in kept)
    within = work.write(given.mapInArrow(_less_effects(count, kept, k), kinds + "_cols array<int>, _vals array<double>"))
    work.drop(packed)
    return within


def _patterns(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with the same columns: their numbers, the columns, and the values as a matrix."""
    lists = batch.column("_cols")
    sizes = lists.value_lengths().to_numpy()
    starts = np.cumsum(sizes) - sizes
    cols, vals = lists.flatten().to_numpy(), batch.column("_vals").flatten().to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        cells = starts[rows][:, None] + np.arange(size)
        found, which = np.unique(cols[cells], axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        for pattern, part in zip(found, np.split(order, np.cumsum(np.bincount(which.ravel()))[:-1])):
            yield rows[part], pattern, vals[cells[part]]


def _cells(blocks: dict) -> Iterator[pa.RecordBatch]:
    """Blocks of several matrices as rows (k, i, j, v)."""
    for (k, pattern), block in blocks.items():
        cols = np.frombuffer(pattern, np.int32)
        i, j = np.triu_indices(len(cols))
        columns = [np.full(len(i), k, np.int32), cols[i], cols[j], block[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "i", "j", "v"])


_CELLS = "k int, i int, j int, v double"


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of outer products of sparse rows: a task adds up one block for every set of columns that it meets."""
    blocks: dict = {}
    for batch in batches:
        for _, pattern, x in _patterns(batch):
            key = (0, pattern.astype(np.int32).tobytes())
            blocks[key] = blocks.get(key, 0) + x.T @ x
    yield from _cells(blocks)


def _matrices(cells: DataFrame) -> dict[int, dict[tuple[int, int], float]]:
    """Sums of cells on the driver: as many as the coefficient matrices have."""
    out: dict = {}
    for k, i, j, v in cells.groupBy("k", "i", "j").agg(F.sum("v").alias("v")).toPandas().itertuples(index=False):
        out.setdefault(k, {})[i, j] = v
    return out


def _dense(cells: dict, at: list[int]) -> np.ndarray:
    out, place = np.zeros((len(at), len(at))), {c: n for n, c in enumerate(at)}
    if len(at) ** 2 < len(cells):
        for a, i in place.items():
            for b, j in place.items():
                out[i, j] = cells.get((min(a, b), max(a, b)), 0.0)
        return out
    for (a, b), v in cells.items():
        if a in place and b in place:
            out[place[a], place[b]] = out[place[b], place[a]] = v
    return out


# Variances


class _Residuals:
    """Residuals of several models on rows with the same columns."""

    def __init__(self, models: list[dict]) -> None:
        self.models = [(m["y"], np.array(m["x"], np.int32), np.asarray(m["beta"], float)) for m in models]
        self.seen: dict = {}

    def of(self, pattern: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(model, its terms' places in the pattern, their numbers in the model, residuals)."""
        key = pattern.tobytes()
        if key not in self.seen:
            place = {c: n for n, c in enumerate(pattern.tolist())}
            self.seen[key] = [(place.get(y), np.array([place[c] for c in terms.tolist() if c in place], int), np.flatnonzero(np.isin(terms, pattern))) for y, terms, _ in self.models]
        for i, ((y, inside, which), (_, _, beta)) in enumerate(zip(self.seen[key], self.models)):
            e = x[:, y] if y is not None else np.zeros(len(x))
            yield i, inside, which, e - x[:, inside] @ beta[which]


def _row_scores(models: list[dict]):
    """Squared residuals (i = j = -1) and sums of squared scores of every model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        residuals, blocks, rss = _Residuals(models), {}, np.zeros(len(models))
        for batch in batches:
            for _, pattern, x in _patterns(batch):
                for i, inside, which, e in residuals.of(pattern, x):
                    rss[i] += e @ e
                    if len(inside):
                        own = x[:, inside] * e[:, None]
                        key = (i, which.astype(np.int32).tobytes())
                        blocks[key] = blocks.get(key, 0) + own.T @ own
        columns = [np.arange(len(models), dtype=np.int32), *[np.full(len(models), -1, np.int32)] * 2, rss]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "i", "j", "v"])
        yield from _cells(blocks)

    return run


def _cluster_scores(models: list[dict], offsets: list[int], cluster: list[str]):
    """Scores of rows as (cluster, number of model and term, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        residuals = _Residuals(models)
        for batch in batches:
            for rows, pattern, x in _patterns(batch):
                for i, inside, which, e in residuals.of(pattern, x):
                    if not len(inside):
                        continue
                    keys = batch.select(cluster).take(pa.array(np.repeat(rows, len(inside))))
                    columns = [pa.array(np.tile(offsets[i] + which, len(rows)).astype(np.int32)), pa.array((x[:, inside] * e[:, None]).ravel())]
                    yield pa.RecordBatch.from_arrays([*keys.columns, *columns], names=[*cluster, "_c", "_s"])

    return run


def _scores(within: DataFrame, models: list[dict], cluster: list[str] | None) -> tuple[list[np.ndarray], list[float], int | None]:
    """For each model the sum of squared scores, over rows or over clusters, and the sum of squared residuals."""
    cells = _matrices(within.select("_cols", "_vals").mapInArrow(_row_scores(models), _CELLS))
    rss = [cells[i].pop((-1, -1)) for i in range(len(models))]
    if not cluster:
        return [_dense(cells[i], list(range(len(m["x"])))) for i, m in enumerate(models)], rss, None
    groups = within.select(*cluster).distinct().count()
    offsets = np.cumsum([0, *[len(m["x"]) for m in models]]).tolist()
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in within.schema if f.name in cluster)
    rows = within.select(*cluster, "_cols", "_vals").mapInArrow(_cluster_scores(models, offsets, cluster), kinds + "_c int, _s double")
    sums = rows.groupBy(*cluster, "_c").agg(F.sum("_s").alias("_s")).groupBy(*cluster).agg(F.sort_array(F.collect_list(F.struct("_c", "_s"))).alias("_e"))
    gram = _matrices(sums.select(F.col("_e._c").alias("_cols"), F.col("_e._s").alias("_vals")).mapInArrow(_squares, _CELLS)).get(0, {})
    return [_dense(gram, list(range(offsets[i], offsets[i + 1]))) for i in range(len(models))], rss, groups


def independent_columns(gram: np.ndarray, scale: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Indices of columns that add something to the earlier ones, by elimination in order."""
    a = gram.copy()
    keep = []
    for j in range(len(a)):
        if a[j, j] > tolerance * max(scale[j], np.finfo(float).tiny):
            keep.append(j)
            a = a - np.outer(a[:, j], a[j, :]) / a[j, j]
    return keep


# Fits


@dataclass
class _Sample:
    """The rows of a fit with level ids and entries, and what is known of them."""

    rows: DataFrame
    numbers: dict[str, int]
    sizes: DataFrame
    levels: list[int]
    sums: DataFrame
    n: int
    left_out: int
    singletons: int
    moments: dict[int, tuple[float, float]]


def _sampled(data: DataFrame, models: list[Model], effects: list[list[str]], cluster: list[str] | None, families: list[Family], singletons: str, work: Workspace) -> _Sample:
    numbers = _numbered(models, families)
    in_family = {n for f in families for n in f.names}
    plain = [c for c in numbers if c not in in_family]
    most = max((len(m.terms) for m in models), default=0)
    if most > MAX_TERMS:
        raise ValueError(f"{most} terms in a model, at most {MAX_TERMS}")
    keys = list(dict.fromkeys([c for e in effects for c in e] + (cluster or [])))
    given, used = Observation(), Observation()
    rows = data.observe(given, F.count("*").alias("n")).filter(_complete(plain, keys, families)).observe(used, F.count("*").alias("n"))
    rows = _with_level_ids(rows.select(*keys, _entries(numbers, plain, families).alias("_x")), effects)
    rows = work.write(rows)
    n, alone = used.get["n"], 0
    left_out = given.get["n"] - n
    if singletons == "drop":
        rows, alone = without_singletons(rows, len(effects), work)
        rows, n = work.write(rows), n - alone
    if not n:
        raise ValueError("no row has all outcomes, terms and keys")
    sizes, levels = _level_sizes(rows, effects, work)
    entries = rows.select(F.explode("_x").alias("e")).groupBy("e.c").agg(F.sum("e.v").alias("s"), F.sum(F.col("e.v") * F.col("e.v")).alias("ss"))
    moments = {r["c"]: (r["s"], r["ss"]) for r in entries.collect()}
    return _Sample(rows, numbers, sizes, levels, work.write(_level_sums(rows, len(effects))), n, left_out, alone, moments)


def _level_effects(sample: _Sample, count: int, work: Workspace, tolerance: float, max_rounds: int, start: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Effects (g, c, a) of the levels of the first ``count`` fixed effects on every column: the least-squares fit of the columns on all levels."""
    sums, sizes = sample.sums.filter(F.col("f") < count), sample.sizes.filter(F.col("f") < count)
    if count == 1:
        return work.write(attach(sums.select("g", "c", "s"), sizes.select("g", "n"), ["g"], "inner").select("g", "c", (F.col("s") / F.col("n")).alias("a"))), 0
    return _solve(Normal(sample.rows, sizes, sample.levels[:count], work), sums, work, tolerance, max_rounds, start)


def fit_models(
    data: DataFrame,
    models: list[Model],
    effects: list[list[str]],
    variance: str,
    cluster: list[str] | None = None,
    small_sample: str = "non-nested",
    singletons: str = "keep",
    families: list[Family] | None = None,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
) -> list[Fit]:
    """Several models on one sample with the same absorbed effects: all their columns are demeaned together.

    The sample is the rows in which every outcome and term of every model is a
    finite number and no key of an effect or cluster is NULL; ``statistics`` has
    the number of rows left out. Each effect is a list of key columns. Terms may
    be columns or names of a :class:`Family`, which may be as many as a country and year list has.

    ``variance`` must be named: ``"iid"``, ``"hetero"`` (HC1) or ``"cluster"``
    (CRV1 over ``cluster``). Terms that are collinear with earlier terms or
    with the effects are dropped and reported with a NULL estimate.

    ``small_sample`` says which absorbed levels count as estimated: ``"all"``,
    ``"none"``, or those of effects whose keys do not include all cluster keys
    (``"non-nested"``; the same as all without clusters). One level per fixed
    effect beyond the first is taken as redundant. ``"rank"`` counts the rank of all levels instead, see
    :func:`absorbed_rank`. ``singletons="drop"`` takes rows out that are alone in a level, until there are none.

    Raises ``ValueError`` for a sample without rows, with fewer than two clusters,
    or without degrees of freedom, and ``NotConverged`` when the level effects
    are not found in ``max_rounds``. Tables written on the way are removed.
    """
    _check_choices(variance, cluster, small_sample, singletons)
    with Workspace(data.sparkSession, "fit") as work:
        sample = _sampled(data, models, effects or [[]], cluster, families or [], singletons, work)
        solved, rounds = _level_effects(sample, len(effects or [[]]), work, tolerance, max_rounds)
        return _fits(sample, models, effects, variance, cluster, small_sample, solved, rounds, work)


def _check_choices(variance, cluster, small_sample, singletons) -> None:
    if variance not in ("iid", "hetero", "cluster"):
        raise ValueError("variance is 'iid', 'hetero' or 'cluster'; there is no default")
    if (variance == "cluster") != bool(cluster):
        raise ValueError("cluster columns go with variance='cluster'")
    if small_sample not in SMALL_SAMPLE:
        raise ValueError(f"small_sample is one of {SMALL_SAMPLE}")
    if singletons not in SINGLETONS:
        raise ValueError(f"singletons is one of {SINGLETONS}")


def _fits(sample: _Sample, models, effects, variance, cluster, small_sample, solved_levels, rounds, work) -> list[Fit]:
    spark, n, numbers = sample.rows.sparkSession, sample.n, sample.numbers
    count, levels = len(effects or [[]]), sample.levels[: len(effects or [[]])]
    within = _demeaned(sample.rows, solved_levels, count, list(cluster or []), len(numbers), work)
    gram = _matrices(within.select("_cols", "_vals").mapInArrow(_squares, _CELLS)).get(0, {})

    solved = []
    for m in models:
        x, y = [numbers[t] for t in m.terms], numbers[m.outcome]
        squares = _dense(gram, [*x, y])
        kept = independent_columns(squares[:-1, :-1], np.array([sample.moments.get(c, (0.0, 0.0))[1] for c in x]))
        bread = np.linalg.inv(squares[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
        beta, tss = bread @ squares[kept, -1], squares[-1, -1]
        solved.append({"kept": kept, "bread": bread, "beta": beta, "x": [x[j] for j in kept], "y": y, "tss": tss, "rss": float(tss - beta @ squares[kept, -1])})
    # A nearly exact fit has lost its digits in the difference.
    meats, groups = None, None
    if variance != "iid" or any(s["rss"] < 1e-6 * s["tss"] for s in solved):
        meats, rss, groups = _scores(within, solved, cluster)
        for s, r in zip(solved, rss):
            s["rss"] = r
    work.drop(within)

    counted = [c for e, c in zip(effects, levels) if small_sample != "none" and not (small_sample == "non-nested" and cluster and set(cluster) <= set(e))]
    absorbed = (sum(counted) - max(len(counted) - 1, 0)) if effects else 1
    if small_sample == "rank" and effects:
        absorbed = absorbed_rank(sample.rows, levels, work)
    if variance == "cluster" and groups < 2:
        raise ValueError("clustered errors need two clusters or more")
    fits = []
    for i, (m, s) in enumerate(zip(models, solved)):
        k = len(s["kept"])
        dof = n - k - absorbed
        if dof <= 0:
            raise ValueError(f"{m.name}: {n} rows for {k} terms and {absorbed} absorbed levels leave no degrees of freedom")
        if variance == "iid":
            covariance, df_t = s["bread"] * s["rss"] / dof, dof
        elif variance == "hetero":
            covariance, df_t = s["bread"] @ meats[i] @ s["bread"] * n / dof, dof
        else:
            covariance, df_t = s["bread"] @ meats[i] @ s["bread"] * groups / (groups - 1) * (n - 1) / dof, groups - 1
        sum_y, sum_yy = sample.moments.get(s["y"], (0.0, 0.0))
        tss = sum_yy - sum_y * sum_y / n
        r2, r2_within = (1 - s["rss"] / t if t else None for t in (tss, s["tss"]))
        statistics = small_table(
            spark,
            [(m.name, n, sample.left_out, sample.singletons, k, absorbed, dof, float(np.sqrt(s["rss"] / n)), r2, r2_within, groups, variance, rounds)],
            "model string, n long, left_out long, singletons long, k int, absorbed long, dof long, rmse double, r2 double, r2_within double, clusters long,"
            " variance string, rounds int",
        )
        dropped = [t for j, t in enumerate(m.terms) if j not in s["kept"]]
        fits.append(Fit(_coefficients(spark, m, s, covariance, df_t), statistics, [m.terms[j] for j in s["kept"]], s["beta"], covariance, dropped, rounds))
    return fits


def _coefficients(spark, m: Model, s: dict, covariance: np.ndarray, df: int) -> DataFrame:
    se, width, rows = np.sqrt(np.diag(covariance)), t_quantile(0.975, df), []
    place = {j: i for i, j in enumerate(s["kept"])}
    for j, term in enumerate(m.terms):
        country, year = m.labels.get(term, (None, None))
        if j in place:
            b, e = float(s["beta"][place[j]]), float(se[place[j]])
            t = b / e if e > 0 else None
            p = two_sided_p(t, df) if t is not None else None
            rows.append((m.name, term, country, year, b, e, t, p, b - width * e, b + width * e, False))
        else:
            rows.append((m.name, term, country, year, None, None, None, None, None, None, True))
    return small_table(
        spark,
        rows,
        "model string, term string, country string, year int, estimate double, std_error double, t double, p double,"
        " ci_low double, ci_high double, dropped boolean",
    )


def absorbing_ols(
    data: DataFrame,
    outcome: str,
    terms: list[str],
    effects: list[list[str]],
    variance: str,
    cluster: list[str] | None = None,
    model: str = "model",
    labels: dict[str, tuple[str | None, int | None]] | None = None,
    **options,
) -> Fit:
    """``outcome`` on ``terms`` with the ``effects`` absorbed, see :func:`fit_models`."""
    return fit_models(data, [Model(model, outcome, terms, labels or {})], effects, variance, cluster, **options)[0]


def cumulative_fits(
    data: DataFrame, outcome: str, terms: list[str], effects: list[list[str]], variance: str, cluster: list[str] | None = None, small_sample: str = "non-nested",
    families: list[Family] | None = None, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS,
) -> list[Fit]:
    """The same model with the first, the first two, ... and all fixed effects, on one sample.

    Rows must have the keys of all effects. Level sums are taken once, and a longer list of effects starts from the
    effects that the shorter one found.
    """
    _check_choices(variance, cluster, small_sample, "keep")
    fits, solved = [], None
    with Workspace(data.sparkSession, "fit") as work:
        names = ["+".join("^".join(e) for e in effects[: i + 1]) for i in range(len(effects))]
        sample = _sampled(data, [Model(names[-1], outcome, terms)], effects, cluster, families or [], "keep", work)
        for i, name in enumerate(names):
            solved, rounds = _level_effects(sample, i + 1, work, tolerance, max_rounds, solved)
            fits += _fits(sample, [Model(name, outcome, terms)], effects[: i + 1], variance, cluster, small_sample, solved, rounds, work)
    return fits


def cumulative_effects(*args, **options) -> DataFrame:
    """Coefficients of :func:`cumulative_fits`, one block of rows per list of effects."""
    return reduce(DataFrame.unionByName, [fit.coefficients for fit in cumulative_fits(*args, **options)])
