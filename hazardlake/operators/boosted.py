"""Gradient-boosted proportional hazards (Newton boosting on the Breslow likelihood).

With w = exp(margin), S0(t) the sum of w over rows at risk, A(t) = sum d/S0 and
B(t) = sum d/S0**2 over event times up to t: gradient g = w A - event and curvature
h = w A - w**2 B. Rows with the same bins share one margin, so rows are collapsed once to
(bins, time, event) counts; rounds then work on counts and on one margin per cell. Splits know bins only, so
a round's tree grows from the sums of g and h per distinct bins, whatever the number of rows. A round's
row sample is one binomial draw per count, which is what drawing every row alone gives.

A fit of up to ``HELD_COUNTS`` counts runs all its rounds in one task, which holds the counts as arrays; the
rounds of larger ones are jobs over the counts. Both ways draw the same rows and grow the same trees.

Declared differences to other libraries: margins start at 0 (risks are relative anyway);
tied times share the whole risk set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import uniform_sql
from ..session import discard, materialize
from .encoding import EVENT, TIME
from .prefix import cut_points, running
from . import trees as tr
from .trees import (
    Binner, Codes, Ensemble, Node, add_total, dense, fit_binner, gradient_levels, grow, importance, leaf_of, node_table,
    nodes_from_table, spread,
)

BROADCAST_CELLS = 500_000
MIN_HESSIAN = 1e-16
#: Rounds after which the counts are written anew with their margins.
WRITE_EVERY = 10
#: Counts of a fit up to which one task runs all its rounds.
HELD_COUNTS = 8_000_000
#: Counts, and cells times features, that such a task works on at once.
CHUNK = 1 << 15
#: Rows up to which a count's draw takes one uniform a row.
PART = 64


@dataclass
class BoostedModel:
    binner: Binner
    nodes: list[Node]
    kind: str = "int"

    @property
    def ensemble(self) -> Ensemble:
        return Ensemble(self.nodes, self.binner)

    def node_table(self, spark: SparkSession) -> DataFrame:
        return node_table(spark, self.nodes, self.kind)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"cuts": self.binner.table(spark), "nodes": self.node_table(spark)}

    @staticmethod
    def from_tables(tables: dict[str, DataFrame]) -> BoostedModel:
        return BoostedModel(Binner.from_table(tables["cuts"]), nodes_from_table(tables["nodes"]))

    def margin(self, df: DataFrame, out: str = "margin", fit_col: str | None = None,
               replace: dict[str, str] | None = None) -> DataFrame:
        """Log-risk of each row; ``replace`` takes features from other columns."""
        coded = self.binner.transform(df, "__codes", replace, fit_col)
        return add_total(coded, self.ensemble, out, "__codes", fit_col).drop("__codes")

    def score(self, df: DataFrame, out: str = "risk", fit_col: str | None = None,
              replace: dict[str, str] | None = None) -> DataFrame:
        return self.margin(df, out, fit_col, replace).withColumn(out, F.exp(out))

    def importance(self, spark: SparkSession, kind: str = "weight", top: int = 20) -> DataFrame:
        return importance(self.node_table(spark), self.binner.features, kind, top)


def collapse(df: DataFrame, binner: Binner, fit_col: str | None) -> DataFrame:
    """(fit, codes, t, e) -> count: the only pass over the training rows."""
    fit = F.col(fit_col) if fit_col else F.lit(0)
    coded = binner.transform(df, fit_col=fit_col)
    return coded.select(
        fit.alias("fit"), "codes", F.col(TIME).cast("double").alias("t"), F.col(EVENT).cast("int").alias("e")
    ).groupBy("fit", "codes", "t", "e").agg(F.count(F.lit(1)).alias("m"))


def code_totals(counts: DataFrame) -> dict:
    """Codes of every fit's counts, each count adding one."""
    return {r[0]: r[1] for r in counts.groupBy("fit").agg(F.sum(F.size("codes") + 1)).collect()}


def _shares(share: float, part: int) -> list[float]:
    """Distribution function of Binomial(part, share) at 0 .. part - 1."""
    below, total = [], 0.0
    for k in range(part):
        total += math.comb(part, k) * share**k * (1 - share) ** (part - k)
        below.append(total)
    return below


def binomial_draw(count: str, share: float, seed: int, salt: int, *columns: str, part: int = PART) -> str:
    """SQL for a Binomial(count, share) draw; the draw depends on the columns' values only.

    Exact at all counts: the distribution function of ``part`` rows is inverted as often as the count
    holds so many, and what is left takes one uniform per row.
    """
    each = uniform_sql(seed, 2 * salt, "i", *columns)
    single = f"aggregate(sequence(1, cast({{n}} as int)), 0L, (a, i) -> a + if({each} < {share!r}D, 1, 0))"
    below = [f"{total!r}D" for total in _shares(share, part)]
    whole = uniform_sql(seed, 2 * salt + 1, "i", *columns)
    # Sharing the search over the cumulative shares: how many of them lie below the uniform.
    many = (
        f"aggregate(sequence(1, cast({count} div {part} as int)), 0L, (a, i) -> a +"
        f" aggregate(array({', '.join(below)}), 0, (b, c) -> b + if(c <= {whole}, 1, 0)))"
    )
    rest = f"if({count} % {part} = 0, 0L, {single.format(n=f'{count} % {part}')})"
    return f"if({count} < {part}, {single.format(n=count)}, {many} + {rest})"


def breslow_terms(weighted: DataFrame, cuts: Sequence[float] = ()) -> DataFrame:
    """(fit, t) -> A(t), B(t) from rows (fit, t, e, m, w)."""
    per_time = weighted.groupBy("fit", "t").agg(
        F.expr("sum(m * w) as s"), F.expr("cast(sum(m * e) as double) as d")
    ).withColumn("back", -F.col("t"))
    risk = running(per_time, ["fit"], "back", sums={"s0": "s"}, cuts=[-c for c in reversed(cuts)])
    steps = risk.selectExpr("fit", "t", "d / s0 as da", "d / (s0 * s0) as db")
    return running(steps, ["fit"], "t", sums={"A": "da", "B": "db"}, cuts=cuts).select("fit", "t", "A", "B")


def gradients(df: DataFrame, margin: str = "margin", by: str | None = None) -> DataFrame:
    """Gradient and curvature per row at a given margin column (for inspection and tests)."""
    rows = df.withColumns({
        "fit": F.col(by) if by else F.lit(0), "t": F.col(TIME), "e": F.col(EVENT).cast("int"),
        "m": F.lit(1), "w": F.exp(margin),
    })
    terms = breslow_terms(rows)
    return rows.join(terms, ["fit", "t"]).withColumns({
        "gradient": F.expr("w * A - e"), "curvature": F.expr("w * A - w * w * B"),
    }).drop("fit", "t", "e", "m", "w", "A", "B")


# ---- all rounds of a fit in a task ------------------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _ended(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_P2)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_P3)
    return h ^ (h >> np.uint64(32))


def int_term(value: np.ndarray) -> np.ndarray:
    """What a 32-bit integer adds to its hash."""
    return np.asarray(value).astype(np.uint32).astype(np.uint64) * np.uint64(_P1)


def long_term(value: np.ndarray) -> np.ndarray:
    """What a 64-bit integer adds to its hash."""
    return _turned(value.view(np.uint64) * np.uint64(_P2), 31) * np.uint64(_P1)


def double_term(value: np.ndarray) -> np.ndarray:
    """What a double adds to its hash."""
    return long_term(np.asarray(value, dtype=np.float64) + 0.0)  # both zeros are one value


def int_hash(before: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` after one more integer."""
    return _ended(_turned((before + np.uint64(_P5 + 4)) ^ term, 23) * np.uint64(_P2) + np.uint64(_P3))


def long_hash(before: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` after one more 64-bit integer or double."""
    return _ended(_turned((before + np.uint64(_P5 + 8)) ^ term, 27) * np.uint64(_P1) + np.uint64(_P4))


class Counts(NamedTuple):
    """Counts of one fit, those of a cell side by side: cell, place of the time, event and number of each."""

    codes: Codes
    cell: np.ndarray
    times: np.ndarray
    at: np.ndarray
    e: np.ndarray
    m: np.ndarray

    def slices(self) -> list[slice]:
        return [slice(i, i + CHUNK) for i in range(0, len(self.m), CHUNK)]


class Draws:
    """The numbers that ``binomial_draw`` over (codes, t, e) gives, without SQL."""

    def __init__(self, counts: Counts, share: float, seed: int):
        self.counts, self.share, self.seed = counts, share, seed
        self.below = np.array(_shares(share, PART))
        self.times, self.events = double_term(counts.times), int_term(counts.e)
        sizes = np.bincount(counts.codes.row, minlength=counts.codes.n)
        start, terms = np.cumsum(sizes) - sizes, int_term(counts.codes.flat)
        # the j-th code of every cell that has so many
        self.steps = [(held := np.flatnonzero(sizes > j), terms[start[held] + j]) for j in range(int(sizes.max(initial=0)))]
        self.cells: dict = {}  # of one round

    def _cells(self, salt: int, i: int) -> np.ndarray:
        """Hash of (seed, salt, i, codes) of every cell."""
        if (salt, i) not in self.cells:
            h = np.full(self.counts.codes.n, 42, np.uint64)
            for number in (self.seed, salt, i):
                one = np.array([number])
                h = int_hash(h, int_term(one)) if abs(number) < 1 << 31 else long_hash(h, long_term(one))
            for held, term in self.steps:
                h[held] = int_hash(h[held], term)
            self.cells[salt, i] = h
        return self.cells[salt, i]

    def _uniform(self, salt: int, i: int, at: np.ndarray) -> np.ndarray:
        c = self.counts
        h = long_hash(self._cells(salt, i)[c.cell[at]], self.times[c.at[at]])
        h = int_hash(h, self.events[at])
        return ((h & np.uint64(9007199254740991)).astype(np.float64) + 0.5) / 9007199254740992.0

    def of(self, part: slice, salt: int) -> np.ndarray:
        """Rows that the counts of a slice draw."""
        m = self.counts.m[part]
        out, many = np.zeros(len(m), np.int64), m // PART
        single = m - many * PART
        for number, salt_, below in ((single, 2 * salt, None), (many, 2 * salt + 1, self.below)):
            for i in range(1, int(number.max(initial=0)) + 1):
                mine = np.flatnonzero(number >= i)
                u = self._uniform(salt_, i, part.start + mine)
                out[mine] += u < self.share if below is None else np.searchsorted(below, u, side="right")
        return out


def _leaf_values(codes: Codes, bases: np.ndarray, grown: list[tuple], value: np.ndarray) -> np.ndarray:
    """Value of the leaf of every cell; ``grown`` as of ``gradient_levels``."""
    node, feature, cut, lost = (np.array(c) for c in list(zip(*grown))[:4])
    used = np.unique(feature[feature >= 0])
    if not len(used):
        return np.full(codes.n, value[0])
    left, right = (np.minimum(np.searchsorted(node, 2 * node + k), len(node) - 1) for k in (1, 2))
    tree = (np.where(feature >= 0, np.searchsorted(used, feature), -1), cut, lost, left, right)
    ends = np.searchsorted(codes.row, np.arange(codes.n + 1))
    out, step = np.empty(codes.n), max(1, 32 * CHUNK // len(used))
    for a in range(0, codes.n, step):
        b = min(codes.n, a + step)
        own = Codes(codes.flat[ends[a]:ends[b]], codes.row[ends[a]:ends[b]] - a, b - a)
        out[a:b] = value[leaf_of(tree, dense(own, bases, used))]
    return out


def boost(counts: Counts, bases: np.ndarray, rounds: int, max_depth: int, learning_rate: float, min_child_weight: float,
          gamma: float, subsample: float, reg_lambda: float, seed: int) -> Iterator[tuple]:
    """(round, node, feature, split bin, missing right, gain, g, h) of every node of every round's tree."""
    codes, n_times = counts.codes, len(counts.times)
    margin, draws = np.zeros(codes.n), Draws(counts, subsample, seed)
    d = np.bincount(counts.at, weights=counts.m * counts.e, minlength=n_times)
    for i in range(rounds):
        w, w2, draws.cells = np.exp(margin), np.exp(2 * margin), {}
        s = np.zeros(n_times)
        for part in counts.slices():
            s += np.bincount(counts.at[part], weights=counts.m[part] * w[counts.cell[part]], minlength=n_times)
        s0 = np.cumsum(s[::-1])[::-1]
        a, b = np.cumsum(d / s0), np.cumsum(d / (s0 * s0))
        g, h, drawn = np.zeros(codes.n), np.zeros(codes.n), np.zeros(codes.n, dtype=bool)
        for part in counts.slices():
            cell, at = counts.cell[part], counts.at[part]
            k = draws.of(part, i) if subsample < 1.0 else counts.m[part]
            first, n = cell[0], cell[-1] - cell[0] + 1
            of = cell - first
            mine = slice(first, first + n)
            g[mine] += np.bincount(of, weights=k * (w[cell] * a[at] - counts.e[part]), minlength=n)
            h[mine] += np.bincount(of, weights=k * np.maximum(w[cell] * a[at] - w2[cell] * b[at], MIN_HESSIAN), minlength=n)
            drawn[cell[k > 0]] = True
        if not drawn.any():
            continue
        grown = list(gradient_levels(codes.take(drawn), g[drawn], h[drawn], 0, max_depth, bases, reg_lambda, gamma, min_child_weight))
        yield from ((i, *n) for n in grown)
        value = np.array([-learning_rate * n[5] / (n[6] + reg_lambda) for n in grown])
        margin += _leaf_values(codes, bases, grown, value)


def _by_cell(counts: DataFrame) -> DataFrame:
    """(fit, codes, t, e, m): a row per cell, or piece of one, with the times, events and numbers of its counts as arrays."""
    kind = counts.schema["fit"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n = batch.num_rows
            if not n:
                continue
            codes, fit = batch.column("codes"), batch.column("fit").to_numpy(zero_copy_only=False)
            found = Codes.of(codes)
            sizes = np.bincount(found.row, minlength=n)
            begins = np.ones(n, dtype=bool)
            begins[1:] = (sizes[1:] != sizes[:-1]) | (fit[1:] != fit[:-1])
            # a row goes on with the cell before if all its codes are those of the row before
            inner = np.flatnonzero(~begins[found.row])
            differs = found.flat[inner] != found.flat[inner - sizes[found.row[inner]]]
            begins[found.row[inner][differs]] = True
            first = np.flatnonzero(begins)
            offsets, taken = pa.array(np.append(first, n).astype(np.int32)), pa.array(first)
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("t", "e", "m")]
            yield pa.RecordBatch.from_arrays([batch.column("fit").take(taken), codes.take(taken), *lists], ["fit", "codes", "t", "e", "m"])

    return counts.mapInArrow(run, f"fit {kind}, codes array<int>, t array<double>, e array<int>, m array<long>")


_BOOSTED = "fit {kind}, tree int, node int, feature int, split_bin int, missing_right boolean, gain double, g double, h double"


def _rounds_in_tasks(base: DataFrame, binner: Binner, max_depth: int | dict, **settings) -> list[Node]:
    """The nodes of all rounds of all fits of ``base``, each fit in one task."""
    kind = base.schema["fit"].dataType.simpleString()
    bases = binner.bases_by_fit()
    depth = max_depth.get if isinstance(max_depth, dict) else lambda fit: max_depth
    cores = base.sparkSession.sparkContext.defaultParallelism
    dealt = base.select("fit", "codes", "t", "e", "m").repartition(2 * cores, "fit", "codes")
    cells = materialize(_by_cell(dealt.sortWithinPartitions("fit", "codes")), "cells")

    def run(group: pa.Table) -> pa.Table:
        fit = group["fit"][0]
        lists = {c: group[c].combine_chunks() for c in ("t", "e", "m")}
        codes = Codes.of(group["codes"])
        sizes = lists["m"].value_lengths().to_numpy(zero_copy_only=False)
        t, e, m = (lists[c].flatten().to_numpy() for c in ("t", "e", "m"))
        times, at = np.unique(t, return_inverse=True)
        counts = Counts(codes, np.repeat(np.arange(codes.n, dtype=np.int32), sizes), times, at.astype(np.int32), e, m)
        del group, lists, t, at
        found = boost(counts, bases.get(fit.as_py(), bases[None]), max_depth=depth(fit.as_py()), **settings)
        columns = list(zip(*found)) or [()] * 8
        names = ["tree", "node", "feature", "split_bin", "missing_right", "gain", "g", "h"]
        kinds = [pa.int32()] * 4 + [pa.bool_()] + [pa.float64()] * 3
        return pa.table({
            "fit": pa.repeat(fit, len(columns[0])), **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}})

    fits = spread(cells, 4 * cores, "fit").groupBy("fit")
    grown = fits.applyInArrow(run, _BOOSTED.format(kind=kind)).toArrow()  # the model, which the driver holds anyway
    discard(cells)
    return [Node(*row) for row in zip(*(column.to_pylist() for column in grown.columns))]


# ---- fitting -------------------------------------------------------------------------------------


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_CELLS else df


def fit_boosted(
    df: DataFrame,
    features: Sequence[str],
    fit_col: str | None = None,
    rounds: int = fv.BOOSTED_SETTINGS["rounds"],
    max_depth: int | dict = fv.BOOSTED_SETTINGS["max_depth"],
    learning_rate: float = fv.BOOSTED_SETTINGS["learning_rate"],
    min_child_weight: float = fv.BOOSTED_SETTINGS["min_child_weight"],
    gamma: float = fv.BOOSTED_SETTINGS["gamma"],
    subsample: float = fv.BOOSTED_SETTINGS["subsample"],
    reg_lambda: float = fv.BOOSTED_SETTINGS["reg_lambda"],
    seed: int = fv.BOOSTED_SETTINGS["seed"],
    max_bins: int = 256,
    binner: Binner | None = None,
    only: dict | None = None,
) -> BoostedModel:
    """Fit one boosted model, or one per value of ``fit_col`` in the same jobs, each with its own ``max_depth`` if that is a dict.

    ``only`` names the features of fits that do not have them all.
    """
    binner = binner or fit_binner(df, features, max_bins, fit_col)
    if only:
        binner = replace(binner, only=only)
    cores = df.sparkSession.sparkContext.defaultParallelism
    counts = spread(collapse(df, binner, fit_col), 2 * cores, "fit", "codes", "t")
    base = materialize(counts.withColumn("margin", F.lit(0.0)), "boosted")
    kind = base.schema["fit"].dataType.simpleString()
    # a tree sees sums per distinct codes only
    sizes = code_totals(base.select("fit", "codes").distinct())
    odd = F.col("t").isNull() | F.isnan("t") | F.col("e").isNull()
    found = base.groupBy("fit").agg(
        F.count(F.lit(1)).alias("counts"), F.count_distinct("t").alias("times"), F.count_if(odd).alias("odd")).collect()
    held = {
        r.fit for r in found
        if r.fit is not None and r.counts <= HELD_COUNTS and sizes[r.fit] <= tr.ENTRIES and r.times <= BROADCAST_CELLS and not r.odd
    }
    nodes: list[Node] = []
    settings = {"learning_rate": learning_rate, "min_child_weight": min_child_weight, "gamma": gamma,
                "subsample": subsample, "reg_lambda": reg_lambda, "seed": seed}
    if held:
        here = base.filter(F.col("fit").isin(list(held))) if len(held) < len(sizes) else base
        nodes += _rounds_in_tasks(here, binner, max_depth, rounds=rounds, **settings)
    if len(held) < len(sizes):
        large = {fit: n for fit, n in sizes.items() if fit not in held}
        rest = base.filter(~F.col("fit").isin(list(held))) if held else base
        nodes += _rounds_in_jobs(rest, binner, large, rounds, max_depth, **settings)
    for n in nodes:
        if n.feature < 0:
            n.value = -learning_rate * n.g / (n.h + reg_lambda)
    discard(base)
    return BoostedModel(binner, nodes, kind)


def _rounds_in_jobs(base: DataFrame, binner: Binner, sizes: dict, rounds: int, max_depth: int | dict, learning_rate: float,
                    min_child_weight: float, gamma: float, subsample: float, reg_lambda: float, seed: int) -> list[Node]:
    """The nodes of all rounds; a round is a few jobs over the counts of all fits."""
    first = base
    n_times = base.select("fit", "t").distinct().count()
    cuts = cut_points(base.select("fit", "t").distinct(), "t") if n_times > BROADCAST_CELLS else []
    nodes: list[Node] = []
    recent: list[Node] = []
    for i in range(rounds):
        now = base
        if recent:
            now = add_total(base, Ensemble(recent, binner), "more", fit_col="fit")
            now = now.select("fit", "codes", "t", "e", "m", (F.col("margin") + F.col("more")).alias("margin"))
        if i and i % WRITE_EVERY == 0:
            # the next rounds' plans start from this table, not from the rounds before
            written = materialize(now, "boosted")
            if base is not first:
                discard(base)
            base, now, recent = written, written, []
        terms = _small(breslow_terms(now.withColumn("w", F.exp("margin")), cuts), n_times)
        taken = now
        if subsample < 1.0:
            draw = binomial_draw("m", subsample, seed, i, "codes", "t", "e")
            taken = now.selectExpr("fit", "codes", "t", "e", "margin", f"{draw} as m").filter("m > 0")
        rows = taken.join(terms, ["fit", "t"]).selectExpr(
            "fit", "codes", "m * (exp(margin) * A - e) as g",
            f"m * greatest(exp(margin) * A - exp(2 * margin) * B, {MIN_HESSIAN!r}D) as h",
        )
        rows = rows.groupBy("fit", "codes").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        grown = grow(rows, binner, sizes, max_depth, reg_lambda, gamma, min_child_weight, i)
        for n in grown:
            if n.feature < 0:
                n.value = -learning_rate * n.g / (n.h + reg_lambda)
        nodes += grown
        recent += grown
    if base is not first:
        discard(base)
    return nodes
