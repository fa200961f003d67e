"""Random survival forest.

Training rows are collapsed to (codes, time, event) counts, the only table that is kept: a bootstrap
weight is one Poisson draw per (tree, count), which for a count m has the same distribution as m
separate Poisson(1) row weights, and it is a hash of the count's values, so every job draws it anew.

Splits maximise the log-rank statistic between the children at exact event times. With Y the weight
at risk, a right side's numerator is the sum of event - H(t) over its rows, H being the node's
Nelson-Aalen estimate; its variance is a sum over rows less the sum over event times of
q(t) Y_right(t)^2. Cut into blocks of time, that last sum is quadratic in the weight right of the cut
in later blocks, with coefficients that each block works out for itself. So a node of any size is split
exactly: blocks give masses, then hazards, then sums per code, and are combined per feature. Nodes
with at most ``HELD * ENTRIES`` codes are one block and are finished in one task together with all that is below them.
A task knows a row by its cell, the distinct codes that it has, so that codes are read once per cell and not once per row.

Leaves hold Kaplan-Meier and Nelson-Aalen curves of their in-bag rows, at the exact times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import discard, materialize
from . import trees as tr
from .boosted import BROADCAST_CELLS, code_totals, collapse
from .prefix import cut_points, running, time_blocks
from .trees import (
    Binner, Codes, Ensemble, Node, Split, add_leaves, add_total, dense, fit_binner, leaf_of, node_table,
    nodes_from_table, options, spread, subtree,
)

HALF = 0.5 + 1e-12
#: Counts of a fit in a block of time; one task works on one block, for a share of the trees.
BLOCK_ROWS = 400_000
#: A forest's task holds so many times the codes of a boosted one, as it needs a few numbers a row besides.
HELD = 3
#: Cells of the table of cuts by times that is worked on at once.
CELLS = 1 << 20
#: Trees that one task grows from the same counts: at least, and at most where there are enough tasks.
TREES_PER_TASK, MOST_TREES = 5, 20
#: Curves in a part and leaf drops in a block of times; one task lays one part beside one block.
CURVES_PER_TASK = 4_000
DROPS_PER_BLOCK = 500_000

_FEW = 16


def _shares(mean: int) -> np.ndarray:
    p, total, out = math.exp(-mean), 0.0, []
    for k in range(8 * mean + 20):
        total += p
        out.append(total)
        p *= mean / (k + 1)
    return np.array(out)


_POISSON = [np.zeros(0), *(_shares(k) for k in range(1, _FEW + 1))]


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _moved(number: int) -> np.uint64:
    return np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))


def poisson_draws(key: np.ndarray, count: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """One Poisson(count) draw per row from its 64-bit key, exact at all counts.

    Small counts invert the distribution function; large ones have a generator of their own.
    """
    key = key.astype(np.int64).view(np.uint64)
    z = _mix(_mix(key + _moved(seed)) + _moved(tree + 1))
    u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    out = np.zeros(len(key), dtype=np.int64)
    for m in np.unique(count[count <= _FEW]).tolist():
        mine = count == m
        out[mine] = np.searchsorted(_POISSON[m], u[mine], side="right")
    for i in np.flatnonzero(count > _FEW).tolist():
        out[i] = np.random.Generator(np.random.PCG64([int(z[i]), seed & 0xFFFFFFFF])).poisson(int(count[i]))
    return out


# ---- rows by their cells -------------------------------------------------------------------------


class Cells(NamedTuple):
    """Rows by the cell that each lies in; ``codes`` has a row per cell."""

    codes: Codes
    of: np.ndarray

    @property
    def n(self) -> int:
        return len(self.of)

    @property
    def sizes(self) -> np.ndarray:
        """The number of codes of every row."""
        return np.bincount(self.codes.row, minlength=self.codes.n)[self.of]

    def take(self, rows: np.ndarray) -> Cells:
        """The rows that the mask picks, and their cells."""
        of = self.of[rows]
        shown = np.zeros(self.codes.n, dtype=bool)
        shown[of] = True
        return Cells(self.codes, of) if shown.all() else Cells(self.codes.take(shown), (np.cumsum(shown) - 1)[of])

    def right(self, split: Split, bases: np.ndarray) -> np.ndarray:
        """Which rows go right."""
        return self.codes.right(split, bases)[self.of]

    def sums(self, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        """The codes that occur, ascending, and for each the sum of every row value."""
        return self.codes.sums(*(np.bincount(self.of, weights=v, minlength=self.codes.n) for v in values))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(place among the cells' codes, row) of all codes in row order."""
        sizes = np.bincount(self.codes.row, minlength=self.codes.n)
        first, mine = (np.cumsum(sizes) - sizes)[self.of], sizes[self.of]
        if (mine == 1).all():
            return first, np.arange(len(mine))
        row = np.repeat(np.arange(len(mine)), mine)
        return np.arange(len(row)) + np.repeat(first - np.cumsum(mine) + mine, mine), row

    @property
    def flat(self) -> np.ndarray:
        """All codes in row order, as ``Codes`` has them."""
        return self.codes.flat[self.entries()[0]]

    @property
    def row(self) -> np.ndarray:
        return self.entries()[1]


def cells_of(codes: Codes) -> Cells:
    """The cells of rows. They are found by a hash of the codes, and compared."""
    sizes = np.bincount(codes.row, minlength=codes.n)
    end = np.cumsum(sizes)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.flat.astype(np.uint64) + _moved(1)), dtype=np.uint64)])
    _, first, of = np.unique(_mix(run[end] - run[end - sizes] + sizes.astype(np.uint64)), return_index=True, return_inverse=True)
    picked = np.zeros(codes.n, dtype=bool)
    picked[first] = True
    cells = Cells(codes.take(picked), (np.cumsum(picked) - 1)[first][of])
    if not (np.array_equal(cells.sizes, sizes) and np.array_equal(cells.flat, codes.flat)):
        return Cells(codes, np.arange(codes.n))  # two cells with one hash
    return cells


# ---- the log-rank statistic ---------------------------------------------------------------------


class Block(NamedTuple):
    """What a block of time knows of a node: per code, and for the square of the weight at risk in all.

    ``m`` weight, ``u`` share in the numerator, ``v`` linear share in the variance; ``line`` sums q Y over the block's own times,
    ``square`` q Y^2 for the right side of the cut at this code (q being ``c / Y^2`` of the node) and ``cross`` q Y times
    the weight of the feature's missing values.
    """

    code: np.ndarray
    m: np.ndarray
    u: np.ndarray
    v: np.ndarray
    line: np.ndarray
    square: np.ndarray
    cross: np.ndarray
    q: float


def life(t: np.ndarray, e: np.ndarray, w: np.ndarray, after: float = 0.0) -> tuple[np.ndarray, ...]:
    """(place of each row's time, deaths, weight at risk) of rows in order of time; ``after`` is at risk later on."""
    tau = np.cumsum(np.concatenate(([False], t[1:] != t[:-1])))
    size = int(tau[-1]) + 1 if len(t) else 0
    m = np.bincount(tau, weights=w, minlength=size)
    d = np.bincount(tau, weights=w * e, minlength=size)
    return tau, d, after + np.cumsum(m[::-1])[::-1]


def spread_of(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hypergeometric factor of the variance at each time."""
    return np.where(n > 1, d * (n - d) / np.maximum(n - 1, 1), 0.0)


def block_of(cells: Cells, t: np.ndarray, e: np.ndarray, w: np.ndarray, bases: np.ndarray, after: float = 0.0,
             hazard: float = 0.0, spread: float = 0.0) -> Block:
    """Sums of a node's rows, in order of time, given what lies after the block and before it."""
    tau, d, n = life(t, e, w, after)
    c = spread_of(d, n)
    q = c / (n * n)
    shown = np.zeros(cells.codes.n, dtype=bool)
    shown[cells.codes.row] = True
    if not shown.all():  # rows without any code add to no sum
        held = shown[cells.of]
        cells, tau, e, w = cells.take(held), tau[held], e[held], w[held]
    rows = (w, w * (e - (hazard + np.cumsum(d / n))[tau]), w * (spread + np.cumsum(c / n))[tau], w * np.cumsum(q)[tau])
    code, m, u, v, line = cells.sums(*rows)
    square, cross = _squares(cells, code, tau, w, q, bases)
    return Block(code, m, u, v, line, square, cross, float(q.sum()))


def _squares(cells: Cells, code: np.ndarray, tau: np.ndarray, w: np.ndarray, q: np.ndarray, bases: np.ndarray):
    square, cross, carry = np.zeros(len(code)), np.zeros(len(code)), np.zeros(len(code))
    times = np.flatnonzero(q > 0)
    if not len(times) or not len(code):
        return square, cross
    last = (np.cumsum(q > 0) - 1)[tau]  # the last such time at which the row is at risk
    place_, row = cells.entries()
    held = slice(int(np.searchsorted(last[row], 0)), None)  # in order of time
    place_, row = place_[held], row[held]
    at, last, weight = np.searchsorted(code, cells.codes.flat)[place_], last[row], w[row]
    feature = np.searchsorted(bases, code, side="right") - 1
    missing = code == bases[feature]
    end = np.searchsorted(feature, feature, side="right")
    first = np.searchsorted(feature, feature, side="left")
    lost = np.flatnonzero(missing[first] & ~missing)
    width = max(1, CELLS // len(code))
    for high in range(len(times), 0, -width):
        low = max(0, high - width)
        a, b = np.searchsorted(last, [low, high])
        grid = np.bincount(at[a:b] * (high - low) + last[a:b] - low, weights=weight[a:b], minlength=len(code) * (high - low))
        risk = np.cumsum(grid.reshape(len(code), -1)[:, ::-1], axis=1)[:, ::-1] + carry[:, None]
        carry = risk[:, 0].copy()
        upward = np.concatenate([np.cumsum(risk[::-1], axis=0)[::-1], np.zeros((1, high - low))])
        right = np.where(missing[:, None], risk, upward[:-1] - upward[end])
        square += (right * right) @ q[times[low:high]]
        if len(lost):
            cross[lost] += (right[lost] * risk[first[lost]]) @ q[times[low:high]]
    return square, cross


def squares_of(every: tr.Options, square: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Sum of q Y_right^2 of every option from what its cut's and missing value's codes hold."""
    both = (every.slot >= 0) & (every.lost >= 0)
    shown = np.where(every.slot >= 0, square[every.slot], 0.0)
    return shown + np.where(every.lost >= 0, square[every.lost], 0.0) + np.where(both, 2 * cross[every.slot], 0.0)


def logrank(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.where(v > 1e-9, u * u / np.maximum(v, 1e-9), -1.0)


def allowed(right: np.ndarray, total: float, min_leaf: float) -> np.ndarray:
    return (right >= min_leaf) & (total - right >= min_leaf) & (right > 0) & (right < total)


def looked_at(able: np.ndarray, mtry: int, seed: int, tree: int, node: int) -> np.ndarray:
    """The features that a node looks at, of those that can split it."""
    draw = np.random.default_rng([seed, tree, node])
    return able[np.sort(draw.permutation(len(able))[:mtry])]


def logrank_split(codes: Codes | Cells, t: np.ndarray, e: np.ndarray, w: np.ndarray, bases: np.ndarray, min_leaf: float,
                  mtry: int, seed: int, tree: int, node: int) -> Split | None:
    """Best split of a node whose rows are at hand, in order of time."""
    total = float(w.sum())
    cells = codes if isinstance(codes, Cells) else Cells(codes, np.arange(codes.n))
    code, m = cells.sums(w)
    coarse = options(code, bases, m)
    able = np.unique(coarse.feature[allowed(coarse.sums[0], total, min_leaf)])
    if not len(able):
        return None
    chosen = looked_at(able, mtry, seed, tree, node)
    wanted = np.zeros(len(bases) - 1, dtype=bool)
    wanted[chosen] = True
    codes = cells.codes
    kept = wanted[tr.owners(bases, codes.flat)]
    block = block_of(Cells(Codes(codes.flat[kept], codes.row[kept], codes.n), cells.of), t, e, w, bases)
    every = options(block.code, bases, block.m, block.u, block.v)
    m, u, v = every.sums
    value = logrank(u, v - squares_of(every, block.square, block.cross))
    return every.best(np.where(allowed(m, total, min_leaf), value, -1.0), 1e-9)


def leaf_curve(t: np.ndarray, e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(event times, drops of the Kaplan-Meier curve, steps of the Nelson-Aalen curve) of rows in order of time."""
    tau, d, n = life(t, e, w)
    dead = d > 0
    step = d[dead] / n[dead]
    before = np.concatenate(([1.0], np.cumprod(1 - step)[:-1])) if len(step) else step
    return t[np.searchsorted(tau, np.flatnonzero(dead))], before * step, step


@dataclass
class ForestModel:
    """Trees with leaf risk as value, plus the leaf survival drops as a table."""

    binner: Binner
    nodes: list[Node]
    trees: int
    drops: DataFrame
    last_time: dict = field(default_factory=dict)
    kind: str = "int"

    @property
    def ensemble(self) -> Ensemble:
        return Ensemble(self.nodes, self.binner)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        last = spark.createDataFrame(list(self.last_time.items()), f"fit {self.kind}, last_time double")
        return {
            "cuts": self.binner.table(spark),
            "nodes": node_table(spark, self.nodes, self.kind),
            "drops": self.drops,
            "last_time": last.withColumn("trees", F.lit(self.trees)),
        }

    @staticmethod
    def from_tables(tables: dict[str, DataFrame]) -> ForestModel:
        last = tables["last_time"].collect()
        return ForestModel(
            Binner.from_table(tables["cuts"]), nodes_from_table(tables["nodes"]), last[0].trees,
            tables["drops"], {r.fit: r.last_time for r in last}, tables["nodes"].schema["fit"].dataType.simpleString(),
        )

    def score(self, df: DataFrame, out: str = "risk", fit_col: str | None = None,
              replace: dict[str, str] | None = None) -> DataFrame:
        """Ensemble cumulative hazard summed over the training event times."""
        coded = self.binner.transform(df, "__codes", replace, fit_col)
        scored = add_total(coded, self.ensemble, out, "__codes", fit_col).drop("__codes")
        return scored.withColumn(out, F.col(out) / self.trees)

    def _cells(self, df: DataFrame, key) -> tuple[DataFrame, DataFrame]:
        """Rows with a ``curve_id``, and (curve_id, leaves) once per distinct codes, dealt into ``part``s."""
        rows = self.binner.of(key).transform(df, "__codes").withColumn("curve_id", F.array_join("__codes", ","))
        cells = materialize(rows.select("curve_id", "__codes").distinct(), "cells")
        parts = max(1, -(-cells.count() // CURVES_PER_TASK))
        placed = add_leaves(cells, self.ensemble, "leaves", "__codes", key)
        part = F.pmod(F.xxhash64("curve_id"), F.lit(parts)).cast("int").alias("part")
        return rows.drop("__codes"), materialize(placed.select("curve_id", "leaves", part), "leaves")

    def _steps(self, key) -> tuple[DataFrame, int]:
        """Leaf drops with the ``block`` of their time, and the number of blocks.

        A block is a run of event times with about ``DROPS_PER_BLOCK`` drops.
        """
        drops = self.drops.filter(F.col("fit") == F.lit(key)).select("tree", "node", "t", "drop")
        times = materialize(drops.groupBy("t").agg(F.count(F.lit(1)).alias("drops")), "times")
        ranked = running(times, [], "t", sums={"seen": "drops"}, cuts=cut_points(times, "t"))
        blocks = ranked.selectExpr("t", f"cast((seen - 1) div {DROPS_PER_BLOCK} as int) as block")
        blocks = F.broadcast(blocks) if times.count() <= BROADCAST_CELLS else blocks
        blocked = materialize(drops.join(blocks, "t"), "steps")
        return blocked, (blocked.agg(F.max("block")).first()[0] or 0) + 1

    def _falls(self, asked: DataFrame, steps: DataFrame) -> DataFrame:
        """(curve_id, block, t, fallen, total) of every (curve_id, leaves, part, block) asked for.

        A task lays the drops of one block of time beside the leaves of one part of the curves and adds them up; a curve has one row a
        block, with the event times that its leaves know and what it has fallen there since the block began.
        """
        trees = self.trees
        wide = 1 + max(n.node for n in self.nodes)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: dict[str, list] = {"t": [], "fallen": [], "total": []}
            times, at = np.unique(right["t"].to_numpy(), return_inverse=True)
            leaf = right["tree"].to_numpy().astype(np.int64) * wide + right["node"].to_numpy()
            order = np.argsort(leaf, kind="stable")
            leaf, at, drop = leaf[order], at[order], right["drop"].to_numpy()[order] / trees
            listed = left["leaves"].combine_chunks()
            grid = listed.flatten().to_numpy().reshape(len(listed), -1).astype(np.int64) + np.arange(trees) * wide
            for a in range(0, len(grid), max(1, CELLS // max(1, len(times)))):
                rows = grid[a : a + max(1, CELLS // max(1, len(times)))]
                first, last = np.searchsorted(leaf, rows.ravel()), np.searchsorted(leaf, rows.ravel(), side="right")
                size = last - first
                after = np.cumsum(size)
                place_ = np.arange(after[-1]) + np.repeat(first - after + size, size)
                cell = np.repeat(np.repeat(np.arange(len(rows)), trees), size) * len(times) + at[place_]
                shape = (len(rows), len(times))
                fall = np.bincount(cell, weights=drop[place_], minlength=shape[0] * shape[1]).reshape(shape)
                known = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape) > 0
                fallen = np.cumsum(fall, axis=1)
                for i in range(len(rows)):
                    out["t"].append(times[known[i]])
                    out["fallen"].append(fallen[i, known[i]])
                    out["total"].append(float(fallen[i, -1]) if len(times) else 0.0)
            lists = {c: pa.array(out[c], pa.list_(pa.float64())) for c in ("t", "fallen")}
            return pa.table({"curve_id": left["curve_id"], "block": left["block"], **lists, "total": pa.array(out["total"], pa.float64())})

        parts = asked.select("part", "block").distinct()
        beside = parts.join(steps, "block")
        beside = beside.toDF(*beside.columns).groupBy("part", "block")
        return asked.groupBy("part", "block").cogroup(beside).applyInArrow(
            run, "curve_id string, block int, t array<double>, fallen array<double>, total double"
        )

    def _totals(self, asked: DataFrame, steps: DataFrame) -> DataFrame:
        """(curve_id, block, total) of every (curve_id, leaves, part, block) asked for: what a curve falls in a block, from one total a leaf."""
        trees = self.trees
        wide = 1 + max(n.node for n in self.nodes)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            leaf = right["tree"].to_numpy().astype(np.int64) * wide + right["node"].to_numpy()
            order = np.argsort(leaf)
            leaf, drop = np.append(leaf[order], -1), np.append(right["total"].to_numpy()[order] / trees, 0.0)
            listed = left["leaves"].combine_chunks()
            grid = listed.flatten().to_numpy().reshape(len(listed), -1).astype(np.int64) + np.arange(trees) * wide
            at = np.searchsorted(leaf[:-1], grid)
            total = np.where(leaf[at] == grid, drop[at], 0.0).sum(axis=1)
            return pa.table({"curve_id": left["curve_id"], "block": left["block"], "total": pa.array(total, pa.float64())})

        sums = steps.groupBy("tree", "node", "block").agg(F.sum("drop").alias("total"))
        beside = asked.select("part", "block").distinct().join(sums, "block")
        beside = beside.toDF(*beside.columns).groupBy("part", "block")
        return asked.groupBy("part", "block").cogroup(beside).applyInArrow(run, "curve_id string, block int, total double")

    def _laid(self, df: DataFrame, fit) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Rows, cells, leaf drops by block, and the cells once per block."""
        key = next(iter(self.last_time)) if fit is None else fit
        rows, cells = self._cells(df, key)
        steps, blocks = self._steps(key)
        return rows, cells, steps, cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def curves(self, df: DataFrame, fit=None) -> tuple[DataFrame, DataFrame]:
        """Rows with their ``curve_id``, and the curve table (curve_id, t, survival).

        The mean over trees is 1 minus the running sum of the mean leaf drops, on every event
        time that a leaf of the curve knows.
        """
        rows, _, steps, asked = self._laid(df, fit)
        falls = self._falls(asked, steps)
        # one row per curve and block of times
        earlier = Window.partitionBy("curve_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        falls = falls.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
        points = falls.select("curve_id", "before", F.explode(F.arrays_zip("t", "fallen")).alias("p"))
        survival = F.greatest(1 - (F.col("before") + F.col("p.fallen")), F.lit(0.0))
        return rows, points.select("curve_id", "p.t", survival.alias("survival"))

    def median_time(self, df: DataFrame, out: str = "predicted_survival_time", fit=None) -> DataFrame:
        """First time with ensemble S <= 0.5 per row, else the last training time.

        The block of times in which a curve crosses is found from one total a leaf and block; only that
        block's times are then worked out.
        """
        key = next(iter(self.last_time)) if fit is None else fit
        rows, cells, steps, asked = self._laid(df, fit)
        totals = materialize(self._totals(asked, steps), "totals")
        reached = totals.withColumn("fallen", F.sum("total").over(Window.partitionBy("curve_id").orderBy("block")))
        crossing = reached.filter(1 - F.col("fallen") <= HALF).groupBy("curve_id").agg(
            F.min("block").alias("block"), F.min_by(F.col("fallen") - F.col("total"), "block").alias("before")
        )
        crossing = materialize(crossing, "crossing")
        inside = self._falls(cells.join(crossing.select("curve_id", "block"), "curve_id"), steps)
        found = inside.select("curve_id", "t", "fallen").join(crossing.select("curve_id", "before"), "curve_id")
        place_ = F.array_position(F.transform("fallen", lambda f: 1 - F.col("before") - f <= HALF), True)
        # a block that crosses does so at its last time at the latest, however its drops are added up
        medians = found.select("curve_id", F.coalesce(F.try_element_at("t", place_.cast("int")), F.try_element_at("t", F.lit(-1))).alias(out))
        return rows.join(medians, "curve_id", "left").drop("curve_id").withColumn(
            out, F.coalesce(out, F.lit(float(self.last_time[key])))
        )


# ---- nodes too large for one task ---------------------------------------------------------------


class _Wide(NamedTuple):
    """What the passes over the blocks share; ``groups`` of (fit, block, part) are each worked on in ``shares`` of the trees."""

    rows: DataFrame
    binner: Binner
    bootstrap: bool
    seed: int
    groups: int
    shares: int

    def weights(self, key: np.ndarray, m: np.ndarray, tree: int) -> np.ndarray:
        return poisson_draws(key, m, tree, self.seed) if self.bootstrap else m

    def passed(self, nodes: list[Node], wanted: dict, work, schema: str, given: DataFrame | None = None) -> DataFrame:
        """``work(fit, given row, cells, t, e, w)`` for every wanted node that a block meets.

        ``given`` has a row per (fit, block, tree, node); its yields are tables of ``schema`` behind (fit, tree, node, block).
        """
        kind = self.rows.schema["fit"].dataType.simpleString()
        shared = self.rows.sparkSession.sparkContext.broadcast((Ensemble(nodes, self.binner).fits, wanted))
        weights = poisson_draws if self.bootstrap else None
        seed, shares = self.seed, self.shares

        def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
            fits, asked = shared.value
            if not left.num_rows:
                return empty
            left = left.sort_by("t").combine_chunks()
            known = {} if right is None else {(r["tree"], r["node"]): r for r in right.to_pylist()}
            out = []
            fit, share = left["fit"][0].as_py(), left["share"][0].as_py()
            t, e, m, key = (left[c].to_numpy() for c in ("t", "e", "m", "key"))
            for tree, cells, node in placed(Codes.of(left["codes"]), fits[fit], share, shares):
                w = weights(key, m, tree, seed) if weights else m
                for n in np.intersect1d(node, asked.get((fit, tree), [])).tolist():
                    mine = (node == n)[cells.of] & (w > 0)
                    if mine.any() and (right is None or (tree, n) in known):
                        part = work(fit, known.get((tree, n)), cells.take(mine), t[mine], e[mine], w[mine].astype(float))
                        size = len(next(iter(part.values())))
                        out.append(pa.table({
                            "fit": pa.array([fit] * size, left["fit"].type), "tree": pa.array([tree] * size, pa.int32()),
                            "node": pa.array([n] * size, pa.int32()), "block": pa.array([left["block"][0].as_py()] * size, pa.int32()), **part,
                        }))
            return pa.concat_tables(out) if out else empty

        fields = [f.split() for f in schema.split(", ")]
        arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        empty = pa.schema([
            ("fit", {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]), ("tree", pa.int32()), ("node", pa.int32()),
            ("block", pa.int32()), *((n, arrow[k]) for n, k in fields),
        ]).empty_table()
        full = f"fit {kind}, tree int, node int, block int, {schema}"
        keys = ["fit", "block", "part", "share"]
        many = 4 * self.groups * shares
        every = self.rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        grouped = spread(every, many, *keys).groupBy(*keys)
        if given is None:
            return grouped.applyInArrow(lambda g: run(g), full)
        parts = self.rows.select("fit", "block", "part").distinct()
        beside = given.join(parts, ["fit", "block"]).withColumn("share", F.pmod("tree", F.lit(shares)).cast("int"))
        beside = spread(beside.toDF(*beside.columns), many, *keys).groupBy(*keys)  # columns of their own
        return grouped.cogroup(beside).applyInArrow(lambda a, b: run(a, b), full)


def placed(codes: Codes, fit: tuple, share: int = 0, shares: int = 1) -> Iterator[tuple]:
    """(tree, cells of the rows, node of each cell) for every tree of a fit's share."""
    bases, used, trees = fit
    cells = cells_of(codes)
    x = dense(cells.codes, bases, used)
    for tree in trees:
        if tree[7] % shares == share:
            yield tree[7], cells, tree[6][leaf_of(tree, x)]


def _wide_level(wide: _Wide, nodes: list[Node], frontier: list[tuple], min_leaf: float, mtry: dict) -> list:
    """Best exact log-rank split of every node of the frontier, one row a node at the driver."""
    wanted: dict = {}
    for fit, tree, node in frontier:
        wanted.setdefault((fit, tree), []).append(node)
    bases, seed = wide.binner.bases_by_fit(), wide.seed
    ids = ["fit", "tree", "node"]

    def masses(fit, given, codes, t, e, w):
        k = int(codes.sizes.sum()) + codes.n
        return {"m": [float(w.sum())], "d": [float((w * e).sum())], "k": pa.array([k], pa.int64()), "a": [float(t[0])], "b": [float(t[-1])]}

    mass = wide.passed(nodes, wanted, masses, "m double, d double, k long, a double, b double")
    mass = mass.groupBy(*ids, "block").agg(*(F.sum(c).alias(c) for c in "mdk"), (F.min("a") == F.max("b")).alias("single"))
    by_time = Window.partitionBy(*ids).orderBy("block")
    later = by_time.rowsBetween(1, Window.unboundedFollowing)
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    # a row per node and block of time
    mass = materialize(mass.withColumn("after", F.coalesce(F.sum("m").over(later), F.lit(0.0))), "masses")

    def hazards(fit, given, codes, t, e, w):
        _, d, n = life(t, e, w, given["after"])
        return {"hazard": [float((d / n).sum())], "spread": [float((spread_of(d, n) / n).sum())]}

    several = wide.passed(nodes, wanted, hazards, "hazard double, spread double", mass.filter("not single").select(*ids, "block", "after"))
    at_risk = F.col("after") + F.col("m")
    factor = F.when(at_risk > 1, F.col("d") * (at_risk - F.col("d")) / (at_risk - 1)).otherwise(0.0)
    single = mass.filter("single").select(*ids, "block", (F.col("d") / at_risk).alias("hazard"), (factor / at_risk).alias("spread"))
    steps = mass.join(several.unionByName(single), [*ids, "block"])
    steps = materialize(steps.withColumns({
        "hazard_before": F.coalesce(F.sum("hazard").over(before), F.lit(0.0)),
        "spread_before": F.coalesce(F.sum("spread").over(before), F.lit(0.0)),
    }), "hazards")

    def sums(fit, given, codes, t, e, w):
        own = bases.get(fit, bases[None])
        size = codes.sizes + 1.0
        if given["single"]:  # the weight at risk is that of all parts; the square follows from m when blocks meet
            n = given["after"] + given["m"]
            c = float(spread_of(np.array([given["d"]]), np.array([n]))[0])
            u = w * (e - given["hazard_before"] - given["d"] / n)
            code, m, u, v = codes.sums(w, u, w * (given["spread_before"] + c / n))
            zero = np.zeros(len(code))
            block = Block(code, m, u, v, zero, zero, zero, c / (n * n))
        else:
            block = block_of(codes, t, e, w, own, given["after"], given["hazard_before"], given["spread_before"])
        _, k = codes.sums(size)
        return {"code": block.code, "feature": np.searchsorted(own, block.code, side="right") - 1, "m": block.m, "u": block.u,
                "v": block.v, "line": block.line, "square": block.square, "cross": block.cross, "k": k, "q": np.full(len(k), block.q)}

    names = "code long, feature long, m double, u double, v double, line double, square double, cross double, k double, q double"
    found = materialize(wide.passed(nodes, wanted, sums, names, steps), "sums")
    # q of every block, also of those where a feature has no code
    n_ = F.col("after") + F.col("m")
    singles = steps.filter("single").select(*ids, "block", (F.col("spread") / n_).alias("q"), F.lit(True).alias("single"))
    others = found.join(steps.filter("not single").select(*ids, "block"), [*ids, "block"]).groupBy(*ids, "block").agg(F.max("q").alias("q"))
    q = materialize(singles.unionByName(others.withColumn("single", F.lit(False))), "q")
    totals = steps.groupBy(*ids).agg(F.sum("m").alias("total"), F.sum("k").alias("size"))

    def feature_best(left: pa.Table, right: pa.Table) -> pa.Table:
        """Best split of a node on one feature, its blocks put together."""
        fit, total = left["fit"][0].as_py(), left["total"][0].as_py()
        own = bases.get(fit, bases[None])
        code, block = left["code"].to_numpy(), left["block"].to_numpy()
        present, at = np.unique(code, return_inverse=True)
        whole = lambda c: np.bincount(at, weights=left[c].to_numpy(), minlength=len(present))
        every = options(present, own, whole("m"), whole("u"), whole("v"), whole("k"))
        m, u, v, k = every.sums
        square, later = np.zeros(len(m)), np.zeros(len(m))
        given = {r["block"]: r for r in right.to_pylist()}
        columns = {c: left[c].to_numpy() for c in ("m", "line", "square", "cross")}
        for b in sorted(given, reverse=True):
            here = np.flatnonzero(block == b)
            here = here[np.argsort(code[here])]
            mine = {c: v_[here] for c, v_ in columns.items()}
            place_ = lambda c: np.bincount(np.searchsorted(present, code[here]), weights=mine[c], minlength=len(present))
            m_here, line = options(present, own, place_("m"), place_("line")).sums
            if given[b]["single"]:
                square += given[b]["q"] * (later + m_here) ** 2
            else:
                # between its own codes a block's square is that of the next code above
                up = np.searchsorted(code[here], present)
                level = lambda c: np.where(up < len(here), np.append(mine[c], 0.0)[up], 0.0)
                missing = present == own[every.feature[0]]
                own_square = level("square")
                if missing.any() and not (len(here) and code[here][0] == present[0]):
                    own_square = np.where(missing, 0.0, own_square)
                cross = np.where(missing, 0.0, level("cross"))
                square += given[b]["q"] * later**2 + 2 * later * line + squares_of(every, own_square, cross)
            later += m_here
        fine = allowed(m, total, min_leaf)
        value = np.where(fine, logrank(u, v - square), -1.0)
        split = every.best(value, 1e-9)
        i = None if split is None else int(np.flatnonzero((every.cut == split.cut) & (every.missing_right == split.missing_right))[0])
        ids_ = {c: left[c].slice(0, 1) for c in ("fit", "tree", "node")}
        return pa.table({
            **ids_, "feature": pa.array([int(every.feature[0])], pa.int32()), "able": [bool(fine.any())],
            "split_bin": pa.array([split.cut if split else 0], pa.int32()), "missing_right": [bool(split and split.missing_right)],
            "gain": [split.gain if split else -1.0], "rh": [float(m[i]) if split else 0.0], "rk": [float(k[i]) if split else 0.0],
            "th": [float(total)], "tk": pa.array([left["size"][0].as_py()], pa.int64()),
        })

    def pick(group: pa.Table) -> pa.Table:
        """The best of the features that a node looks at."""
        group = group.sort_by("feature")
        able = np.flatnonzero(group["able"].to_numpy(zero_copy_only=False))
        chosen = looked_at(able, mtry[group["fit"][0].as_py()], seed, group["tree"][0].as_py(), group["node"][0].as_py()) if len(able) else able
        gain = group["gain"].to_numpy()[chosen].astype(np.float32)
        if not len(chosen) or gain.max() <= 1e-9:
            return group.slice(0, 1).set_column(group.schema.get_field_index("gain"), "gain", pa.array([-1.0]))
        return group.take([int(chosen[int(gain.argmax())])])

    kind = wide.rows.schema["fit"].dataType.simpleString()
    schema = (f"fit {kind}, tree int, node int, feature int, able boolean, split_bin int, missing_right boolean, gain double, "
              "rh double, rk double, th double, tk long")
    coded = found.join(totals, ids)
    beside = found.select(*ids, "feature").distinct().join(q, ids)
    per_feature = coded.groupBy(*ids, "feature").cogroup(beside.toDF(*beside.columns).groupBy(*ids, "feature")).applyInArrow(feature_best, schema)
    best = per_feature.groupBy(*ids).applyInArrow(pick, schema).collect()
    for table in (mass, steps, found, q):
        discard(table)
    return best


def _wide_nodes(wide: _Wide, roots: list[tuple], max_depth: int, min_leaf: float, mtry: dict) -> tuple[list[Node], dict, dict]:
    """Split nodes above, small nodes to be finished, and leaves that are still large, from the roots (fit, tree)."""
    nodes = {(fit, tree, 0): Node(fit, tree, 0) for fit, tree in roots}
    frontier = list(nodes)
    closing, broad = {}, {}
    for level in range(max_depth):
        if not frontier:
            break
        best = _wide_level(wide, list(nodes.values()), frontier, min_leaf, mtry)
        seen, after = {(r.fit, r.tree, r.node) for r in best}, []
        for fit, tree, node in frontier:  # rows without any code cannot be split
            if (fit, tree, node) not in seen:
                broad.setdefault((fit, tree), []).append(node)
        for r in best:
            n = nodes[(r.fit, r.tree, r.node)]
            n.h = r.th
            if r.gain < 0:
                broad.setdefault((r.fit, r.tree), []).append(r.node)
                continue
            n.feature, n.split_bin, n.missing_right, n.gain = r.feature, r.split_bin, r.missing_right, r.gain
            for child, h, k in ((2 * r.node + 1, r.th - r.rh, r.tk - r.rk), (2 * r.node + 2, r.rh, r.rk)):
                nodes[(r.fit, r.tree, child)] = Node(r.fit, r.tree, child, h=h)
                if k <= HELD * tr.ENTRIES:
                    closing.setdefault((r.fit, r.tree), []).append(child)
                else:
                    after.append((r.fit, r.tree, child))
        frontier = after
    for fit, tree, node in frontier:
        broad.setdefault((fit, tree), []).append(node)
    return list(nodes.values()), closing, broad


def _broad_curves(wide: _Wide, nodes: list[Node], broad: dict, kind: str) -> DataFrame:
    """(fit, tree, node, t, drop, hazard_step) of leaves too large for a task, from sums per time."""
    def per_time(fit, given, codes, t, e, w):
        tau, d, n = life(t, e, w)
        return {"t": t[np.searchsorted(tau, np.arange(len(d)))], "d": d, "m": n - np.append(n[1:], 0.0)}

    table = wide.passed(nodes, broad, per_time, "t double, d double, m double")
    table = materialize(table.groupBy("fit", "tree", "node", "t").agg(F.sum("d").alias("d"), F.sum("m").alias("m")), "broad")
    cuts = cut_points(table, "t")
    ids = ["fit", "tree", "node"]
    counted = running(table, ids, "t", sums={"seen": "m"}, totals={"size": "m"}, cuts=cuts).withColumn("n", F.expr("size - seen + m"))
    # a step that ends the curve (all at risk die) has no row after it, so 1 can stand for its factor 0
    steps = counted.filter("d > 0").withColumn("factor", F.expr("if(d = n, 1D, 1 - d / n)"))
    curve = running(steps, ids, "t", products={"s": "factor"}, cuts=cuts)
    # S drops by S(t-) - S(t) = S(t-) * d / n, with S(t-) the product before this row
    return curve.selectExpr(*ids, "t", "s / factor * d / n as drop", "d / n as hazard_step")


# ---- the fit --------------------------------------------------------------------------------------

_FINISHED = (
    "fit {kind}, tree int, node int, feature int, split_bin int, missing_right boolean, gain double, h double,"
    " t array<double>, drop array<double>, hazard_step array<double>"
)


_COLUMNS = ("sizes", "flat", "of", "times", "at", "e", "m", "key")
_BUNDLE = "first int, last int, node int, " + ", ".join(f"{c} binary" for c in _COLUMNS)
#: Rows that a task bundles together, and bytes of bundles after which it hands them on.
BUNDLE_ROWS, BUNDLE_BYTES = 200_000, 8 << 20


def _narrow(numbers: np.ndarray, top: int) -> bytes:
    return numbers.astype(np.uint16 if top < 1 << 16 else np.int32).tobytes()


def bundle(codes: Codes | Cells, t: np.ndarray, e: np.ndarray, m: np.ndarray, key: np.ndarray | None, top: int) -> tuple[bytes, ...]:
    """Rows as bytes, in the narrowest kinds that hold them; ``top`` is above all codes. Rows whose weight is drawn have no key.

    Cells and times are listed once, rows have their places.
    """
    cells = codes if isinstance(codes, Cells) else cells_of(codes)
    times, at = np.unique(t.astype(np.float64), return_inverse=True)
    sizes = np.bincount(cells.codes.row, minlength=cells.codes.n)
    count = np.uint8 if m.max() < 1 << 8 else np.int64
    return (sizes.astype(np.int32).tobytes(), _narrow(cells.codes.flat, top), _narrow(cells.of, cells.codes.n), times.tobytes(),
            _narrow(at, len(times)), e.astype(np.int8).tobytes(), m.astype(count).tobytes(), b"" if key is None else key.astype(np.int64).tobytes())


def unbundled(group: pa.Table) -> tuple:
    """(cells, t, e, m, key) of all rows of the bundles, in order of time; ``key`` is ``None`` if the weights are drawn."""
    held: dict[str, list] = {c: [] for c in ("sizes", "flat", "of", "t", "e", "m", "key")}
    before = 0
    for row in zip(*(group[c].to_pylist() for c in _COLUMNS)):
        n, sizes = len(row[5]), np.frombuffer(row[0], np.int32)
        codes = int(sizes.sum())
        place_ = lambda data, size: np.frombuffer(data, np.uint16 if len(data) == 2 * size else np.int32)
        held["sizes"].append(sizes)
        held["flat"].append(place_(row[1], codes))
        held["of"].append(place_(row[2], n).astype(np.int64) + before)
        held["t"].append(np.frombuffer(row[3])[place_(row[4], n)])
        held["e"].append(np.frombuffer(row[5], np.int8))
        held["m"].append(np.frombuffer(row[6], np.uint8 if len(row[6]) == n else np.int64))
        held["key"].append(np.frombuffer(row[7], np.int64))
        before += len(sizes)
    sizes, flat, of, t, e, m, key = (np.concatenate(v) for v in held.values())
    cells = cells_of(Codes(flat.astype(np.int64), np.repeat(np.arange(before), sizes), before))
    order = np.argsort(t, kind="stable")
    return Cells(cells.codes, cells.of[of[order]]), t[order], e[order].astype(np.int64), m[order].astype(np.int64), key[order] if len(key) else None


def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(fit, kind of fit, codes, t, e, m, key) of a partition's rows, by ``BUNDLE_ROWS`` or a batch more."""
    def split(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        fit, codes = rows["fit"].to_numpy(zero_copy_only=False), Codes.of(rows["codes"])
        columns = [rows[c].to_numpy() for c in ("t", "e", "m", "key")]
        for one in np.unique(fit).tolist():
            mine = fit == one
            yield one, rows["fit"].type, codes if mine.all() else codes.take(mine), *(c[mine] for c in columns)

    waiting: list[pa.RecordBatch] = []
    for batch in parts:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= BUNDLE_ROWS:
            yield from split(waiting)
            waiting = []
    if waiting:
        yield from split(waiting)


def _bundles(found: Iterator[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches of (fit, first, last, node, bundle) from these as tuples."""
    names, kinds = ["fit", "first", "last", "node", *_COLUMNS], [kind, pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * len(_COLUMNS)]
    kept, size = [], 0
    for one in found:
        kept.append(one)
        size += sum(map(len, one[4:]))
        if size > BUNDLE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept), kinds)], names)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept), kinds)], names)


def _whole(counts: DataFrame, trees: int, each: int, top: int) -> DataFrame:
    """Bundles of all counts, once per ``each`` trees."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fit, kind, codes, *columns in gathered(parts):
            yield from _bundles(iter([(fit, 0, 0, 0, *bundle(codes, *columns, top))]), kind)

    kind = counts.schema["fit"].dataType.simpleString()
    packed = counts.select("fit", "codes", "t", "e", "m", "key").mapInArrow(run, f"fit {kind}, {_BUNDLE}")
    span = F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(each))).alias("first")
    below = packed.select("fit", span, "node", *_COLUMNS)
    return below.withColumn("last", F.least(F.col("first") + each - 1, F.lit(trees - 1)))


def _finish(below: DataFrame, binner: Binner, max_depth: int, min_leaf: float, mtry: dict, seed: int, bootstrap: bool) -> DataFrame:
    """Nodes and leaf curves under the nodes of ``below`` (fit, first, last, node, bundle), for trees first to last."""
    kind = below.schema["fit"].dataType.simpleString()
    bases = binner.bases_by_fit()

    def run(group: pa.Table) -> pa.Table:
        fit, start = group["fit"][0].as_py(), group["node"][0].as_py()
        own = bases.get(fit, bases[None])
        cells, t, e, m, key = unbundled(group)
        e = e.astype(float)
        rows, curves = [], []
        for tree in range(group["first"][0].as_py(), group["last"][0].as_py() + 1):
            w = m if key is None or not bootstrap else poisson_draws(key, m, tree, seed)
            held = w > 0

            def find(node: int, c: Cells, *values: np.ndarray) -> Split | None:
                return logrank_split(c, *values, own, min_leaf, mtry[fit], seed, tree, node)

            for node, split, values in subtree(cells.take(held), (t[held], e[held], w[held].astype(float)), start, max_depth, own, find):
                rows.append((tree, node, *(split or Split(-1, 0, False, 0.0)), float(values[2].sum())))
                curves.append((None, None, None) if split else leaf_curve(*values))
        columns, series = list(zip(*rows)), list(zip(*curves))
        names = ["tree", "node", "feature", "split_bin", "missing_right", "gain", "h"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64()]
        return pa.table({
            "fit": pa.array([fit] * len(rows), group["fit"].type), **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)},
            **{n: pa.array(c, pa.list_(pa.float64())) for n, c in zip(("t", "drop", "hazard_step"), series)},
        })

    return below.groupBy("fit", "first", "last", "node").applyInArrow(run, _FINISHED.format(kind=kind))


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    fit_col: str | None = None,
    trees: int = fv.FOREST_SETTINGS["trees"],
    max_depth: int = fv.FOREST_SETTINGS["max_depth"],
    min_leaf: int = fv.FOREST_SETTINGS["min_leaf"],
    seed: int = fv.FOREST_SETTINGS["seed"],
    max_bins: int = 256,
    binner: Binner | None = None,
    only: dict | None = None,
    mtry: int | None = None,
    bootstrap: bool = True,
) -> ForestModel:
    """Fit one forest, or one per value of ``fit_col`` in the same jobs; ``only`` names the features of fits that lack some.

    A node looks at ``mtry`` of the features that can split it, the root of their number by default; without
    ``bootstrap`` every tree has all rows once.
    """
    spark = df.sparkSession
    binner = binner or fit_binner(df, features, max_bins, fit_col)
    if only:
        binner = replace(binner, only=only)
    coded = collapse(df, binner, fit_col)
    # drawn from the values alone, so that a fit gets the same bag in whatever company it runs
    counts = materialize(coded.withColumn("key", F.xxhash64("codes", "t", "e")), "forest")
    kind = counts.schema["fit"].dataType.simpleString()
    sizes, least = code_totals(counts), float(min_leaf)
    looks = {fit: mtry or max(1, int(math.sqrt(binner.width(fit)))) for fit in sizes}
    large = [fit for fit, n in sizes.items() if n > HELD * tr.ENTRIES]
    cores = spark.sparkContext.defaultParallelism
    each = max(TREES_PER_TASK, min(MOST_TREES, trees * (len(sizes) - len(large)) // (4 * cores)))
    groups = (len(sizes) - len(large)) * -(-trees // each)
    here = counts.filter(~F.col("fit").isin(large)) if large else counts
    top = max(int(b[-1]) for b in binner.bases_by_fit().values())
    below = _whole(here, trees, each, top)
    above: list[Node] = []
    curves = None
    if large:
        wanted = counts.filter(F.col("fit").isin(large))
        most = max(r["count"] for r in wanted.groupBy("fit").count().collect())
        blocked = materialize(time_blocks(wanted, "t", BLOCK_ROWS, most), "blocks")
        parts = blocked.select("fit", "block", "part").distinct().count()
        wide = _Wide(blocked, binner, bootstrap, seed, parts, max(1, min(trees, -(-2 * cores // parts))))
        above, closing, broad = _wide_nodes(wide, [(fit, t) for fit in large for t in range(trees)], max_depth, least, looks)
        below = below.unionByName(_routed(wide, above, closing, top))
        groups += sum(map(len, closing.values()))
        if broad:
            curves = _broad_curves(wide, above, broad, kind)
    below = spread(below, 4 * groups, "fit", "first", "last", "node")
    finished = materialize(_finish(below, binner, max_depth, least, looks, seed, bootstrap), "trees")
    done = {(r.fit, r.tree, r.node): Node(**r.asDict()) for r in finished.drop("t", "drop", "hazard_step").collect()}
    nodes = [n for n in above if (n.fit, n.tree, n.node) not in done] + list(done.values())
    drops = finished.select(
        "fit", "tree", "node", F.explode(F.arrays_zip("t", "drop", "hazard_step")).alias("s")
    ).select("fit", "tree", "node", "s.t", "s.drop", "s.hazard_step")
    if curves is not None:
        drops = materialize(drops.unionByName(curves), "drops")
    # risk of a leaf: H summed over the training event times = each step times the number
    # of event times from it on
    event_times = counts.filter("e = 1").select("fit", "t").distinct()
    event_times = materialize(event_times.select("fit", "t", (-F.col("t")).alias("back"), F.lit(1).alias("one")), "times")
    n_times = event_times.count()
    cuts = cut_points(event_times, "back") if n_times > BROADCAST_CELLS else []
    later = running(event_times, ["fit"], "back", sums={"later": "one"}, cuts=cuts).select("fit", "t", "later")
    later = F.broadcast(later) if n_times <= BROADCAST_CELLS else later
    risks = drops.join(later, ["fit", "t"]).groupBy("fit", "tree", "node").agg(F.expr("sum(hazard_step * later) as risk"))
    value = {(r.fit, r.tree, r.node): r.risk for r in risks.collect()}
    for n in nodes:
        if n.feature < 0:
            n.value = value.get((n.fit, n.tree, n.node), 0.0)
    last = {r.fit: r.t for r in counts.groupBy("fit").agg(F.max("t").alias("t")).collect()}
    discard(counts)
    return ForestModel(binner, nodes, trees, drops, last, kind)


def _routed(wide: _Wide, nodes: list[Node], closing: dict, top: int) -> DataFrame:
    """The rows of the closing nodes with their drawn weights, bundled, once per tree that holds them there."""
    rows = wide.rows
    kind = rows.schema["fit"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((Ensemble(nodes, wide.binner).fits, closing))
    weights, seed = (poisson_draws if wide.bootstrap else None), wide.seed

    def found(fit, codes: Codes, t: np.ndarray, e: np.ndarray, m: np.ndarray, key: np.ndarray) -> Iterator[tuple]:
        fits, ends = shared.value
        for tree, cells, node in placed(codes, fits[fit]):
            w = weights(key, m, tree, seed) if weights else m
            for n in np.intersect1d(node, ends.get((fit, tree), [])).tolist():
                inside = (node == n)[cells.of] & (w > 0)
                if inside.any():
                    yield fit, tree, tree, int(n), *bundle(cells.take(inside), t[inside], e[inside], w[inside], None, top)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fit, kind, *rows_ in gathered(parts):
            yield from _bundles(found(fit, *rows_), kind)

    return rows.select("fit", "codes", "t", "e", "m", "key").mapInArrow(run, f"fit {kind}, {_BUNDLE}")
