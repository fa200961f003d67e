"""Binned features as sparse codes, trees grown from sums, and ensemble scoring.

Features are cut once. A row keeps one code for every feature whose bin is not 0, so a row of
many 0/1 columns is as long as it has ones. What a split needs are sums per (node, code). While a node has
more codes than ``ENTRIES``, these sums are one aggregation for all nodes of a level, made of the smaller
child of every split node only: its sibling's sums are the parent's less its own. Below that
bound the rows of a node go to one task, which grows the rest of the tree under it. Both ways
use the same sums and the same choice between splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize

MIN_GAIN = 1e-6
#: Codes of a node's rows up to which one task grows the subtree under it.
ENTRIES = 2_000_000
#: A table over all codes or rows stands in for sorting up to so many times the values at hand.
FEW = 4
#: Distinct rows of bins whose totals a task remembers.
REMEMBERED = 200_000
#: The cut that parts missing values from all others.
ONLY_MISSING = 1_000_000


@dataclass
class Binner:
    """Cut points per encoded feature; ``x >= cut`` belongs to the bin right of the cut.

    A feature with n cuts owns n + 1 consecutive codes: the first stands for a missing value, the
    next for bins 1 to n; bin 0 has none. Fits that run together keep their own cut points in
    ``by_fit``, each taken from its own training rows, so that a joint fit equals the single ones; ``only`` names the
    features of fits that do not have them all. ``flags`` more features are 0/1 and have no columns: their ones are places in
    an array column ``flags``, and as features they are numbered after the others.
    """

    features: list[str]
    cuts: list[list[float]]
    by_fit: dict = field(default_factory=dict)
    only: dict = field(default_factory=dict)
    flags: int = 0

    def of(self, fit) -> Binner:
        """The binner of one fit."""
        one = Binner(self.features, self.by_fit.get(fit, self.cuts), flags=self.flags)
        if fit in self.only:
            one.only = {None: self.only[fit]}
        return one

    def width(self, fit) -> int:
        """Number of features of a fit."""
        return len(self.only.get(fit, self.features)) + self.flags

    @property
    def bases(self) -> np.ndarray:
        """First code of every feature, and the number of codes at the end."""
        own = np.cumsum([0, *(len(c) + 1 for c in self.cuts)])
        return np.concatenate([own, own[-1] + 2 * np.arange(1, self.flags + 1)]).astype(np.int64)

    def bases_by_fit(self) -> dict:
        """Bases of every fit that has its own cuts; ``None`` is any other fit."""
        return {None: self.bases, **{k: self.of(k).bases for k in self.by_fit}}

    def transform(self, df: DataFrame, out: str = "codes", replace: dict[str, str] | None = None,
                  fit_col: str | None = None) -> DataFrame:
        """Add the ascending array of codes.

        ``replace`` takes the values of some features from other columns; with ``fit_col``
        every row is binned by the cut points of the fit it names.
        """
        wide, extra = df, []
        several = {None: self.cuts}
        if fit_col and (self.by_fit or self.only):
            several = {k: self.by_fit.get(k, self.cuts) for k in {**self.by_fit, **self.only}}
        arrays = {}
        for k, (fit, cut_lists) in enumerate(several.items()):
            parts, base, own = [], 0, set(self.only.get(fit, self.features))
            for j, (name, cuts) in enumerate(zip(self.features, cut_lists)):
                if name not in own:
                    base += len(cuts) + 1
                    continue
                source = f"`{(replace or {}).get(name, name)}`"
                if len(cuts) <= 2:
                    steps = [f"when {source} >= {c!r}D then {base + i + 1}" for i, c in enumerate(cuts)]
                    shown = " ".join(reversed(steps))
                else:
                    splits = [float("-inf"), *cuts, float("inf")]
                    value, number = f"__v{j}_{k}", f"__b{j}_{k}"
                    wide = wide.withColumn(value, F.expr(f"cast({source} as double)"))
                    wide = Bucketizer(splits=splits, inputCol=value, outputCol=number, handleInvalid="keep").transform(wide)
                    extra += [value, number]
                    shown = f"when {number} > 0 then {base} + cast({number} as int)"
                parts.append(f"case when {source} is null or isnan({source}) then {base} {shown} end")
                base += len(cuts) + 1
            codes = f"array_compact(cast(array({', '.join(parts)}) as array<int>))"
            if self.flags:
                codes = f"concat({codes}, transform(flags, i -> {base} + 2 * i + 1))"
            arrays[fit] = F.expr(codes)
        if None in arrays:
            chosen = arrays[None]
        else:
            chosen = F.lit(None)
            for fit, codes in arrays.items():
                chosen = F.when(F.col(fit_col) == F.lit(fit), codes).otherwise(chosen)
        return wide.withColumn(out, chosen).drop(*extra)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(j, f, [float(c) for c in cuts], 0) for j, (f, cuts) in enumerate(zip(self.features, self.cuts))]
        rows += [(len(rows), None, [], self.flags)] if self.flags else []
        return spark.createDataFrame(rows, "position int, feature string, cuts array<double>, flags int")

    @staticmethod
    def from_table(table: DataFrame) -> Binner:
        rows = table.orderBy("position").collect()
        named = [r for r in rows if not r.flags]
        return Binner([r.feature for r in named], [list(r.cuts) for r in named], flags=sum(r.flags for r in rows))


def fit_binner(df: DataFrame, features: Sequence[str], max_bins: int = 256, fit_col: str | None = None, flags: int = 0) -> Binner:
    """Quantile cut points from one sketch pass per fit; 0/1 columns get the single cut 0.5."""
    features = list(features)
    if not features:
        return Binner([], [], flags=flags)
    if fit_col:
        keys = sorted(r[0] for r in df.select(fit_col).distinct().collect())
        own = {k: fit_binner(df.filter(F.col(fit_col) == F.lit(k)), features, max_bins).cuts for k in keys}
        return Binner(features, next(iter(own.values()), [[] for _ in features]), own, flags=flags)
    probs = [i / max_bins for i in range(max_bins + 1)]
    found = df.select([F.expr(f"cast(`{f}` as double) as f{j}") for j, f in enumerate(features)])
    points = found.approxQuantile([f"f{j}" for j in range(len(features))], probs, 0.1 / max_bins)
    cuts = []
    for values in points:
        distinct = sorted(set(values))
        cuts.append([0.5] if distinct == [0.0, 1.0] else [float(v) for v in distinct[1:]])
    return Binner(features, cuts, flags=flags)


@dataclass
class Node:
    """One tree node; ``feature`` is -1 in a leaf."""

    fit: object
    tree: int
    node: int
    feature: int = -1
    split_bin: int = 0
    missing_right: bool = False
    gain: float = 0.0
    g: float = 0.0
    h: float = 0.0
    value: float = 0.0


NODE_SCHEMA = (
    "fit {kind}, tree int, node int, feature int, split_bin int, missing_right boolean, "
    "gain double, g double, h double, value double"
)


def node_table(spark: SparkSession, nodes: Sequence[Node], kind: str = "int") -> DataFrame:
    rows = [
        (n.fit, n.tree, n.node, n.feature, n.split_bin, n.missing_right, n.gain, n.g, n.h, n.value)
        for n in nodes
    ]
    return spark.createDataFrame(rows, NODE_SCHEMA.format(kind=kind))


def nodes_from_table(table: DataFrame) -> list[Node]:
    return [Node(**r.asDict()) for r in table.collect()]


def owners(bases: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The feature of every code."""
    if bases[-1] <= FEW * len(code):
        return np.repeat(np.arange(len(bases) - 1), np.diff(bases))[code.astype(np.int64, copy=False)]
    return np.searchsorted(bases, code, side="right") - 1


# ---- codes and splits of rows in a task -------------------------------------------------------


class Codes(NamedTuple):
    """The codes of some rows: all codes in row order, the row of each, and the number of rows."""

    flat: np.ndarray
    row: np.ndarray
    n: int

    @staticmethod
    def of(column: pa.Array) -> Codes:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return Codes(flat, np.repeat(np.arange(len(sizes)), sizes), len(sizes))

    def take(self, rows: np.ndarray) -> Codes:
        """The codes of the rows that the mask picks."""
        kept = rows[self.row]
        number = np.cumsum(rows) - 1
        return Codes(self.flat[kept], number[self.row[kept]], int(rows.sum()))

    def right(self, split: Split, bases: np.ndarray) -> np.ndarray:
        """Which rows go right."""
        low, high = bases[split.feature], bases[split.feature + 1]
        goes = (self.flat > low) & (self.flat >= low + split.cut) & (self.flat < high)
        if split.missing_right:
            goes |= self.flat == low
        out = np.zeros(self.n, dtype=bool)
        out[self.row[goes]] = True
        return out

    def sums(self, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        """The codes that occur, ascending, and for each the sum of every row value."""
        top = int(self.flat.max()) + 1 if len(self.flat) else 0
        if top <= FEW * len(self.flat):  # codes are counted, which needs no order
            code = np.flatnonzero(np.bincount(self.flat, minlength=top))
            return code, *(np.bincount(self.flat, weights=v[self.row], minlength=top)[code] for v in values)
        code, at = np.unique(self.flat, return_inverse=True)
        return code, *(np.bincount(at, weights=v[self.row], minlength=len(code)) for v in values)


class Split(NamedTuple):
    feature: int
    cut: int
    missing_right: bool
    gain: float


class Options(NamedTuple):
    """All splits of a node; ``slot`` and ``lost`` are the places of cut and missing value among its codes, or -1."""

    feature: np.ndarray
    cut: np.ndarray
    missing_right: np.ndarray
    slot: np.ndarray
    lost: np.ndarray
    sums: list[np.ndarray]

    def best(self, gain: np.ndarray, least: float) -> Split | None:
        """The split of the largest gain above ``least``; of gains that agree in single precision the first."""
        if not len(gain) or not (gain > least).any():
            return None
        at = np.lexsort((self.missing_right, self.cut, self.feature, -gain.astype(np.float32)))[0]
        return Split(int(self.feature[at]), int(self.cut[at]), bool(self.missing_right[at]), float(gain[at]))


def options(code: np.ndarray, bases: np.ndarray, *values: np.ndarray) -> Options:
    """Every split between the codes that occur in a node, with the sums of its right side.

    Missing values go left or right, or part from all others.
    """
    feature = np.searchsorted(bases, code, side="right") - 1
    bins = code - bases[feature]
    shown, lost = np.flatnonzero(bins > 0), np.flatnonzero(bins == 0)
    f = feature[shown]
    end = np.searchsorted(f, f, side="right")
    lost_of = np.full(len(shown), -1)
    if len(lost):
        at = np.minimum(np.searchsorted(feature[lost], f), len(lost) - 1)
        lost_of = np.where(feature[lost][at] == f, lost[at], -1)
    both = np.flatnonzero(lost_of >= 0)
    sums = []
    for v in values:
        run = np.append(np.cumsum(v[shown][::-1])[::-1], 0.0)
        right = run[:-1] - run[end]
        sums.append(np.concatenate([right, right[both] + v[lost_of[both]], v[lost]]))
    join = lambda a, b, c: np.concatenate([a, b, c]).astype(np.int64)
    none = lambda n: np.full(n, -1)
    return Options(
        join(f, f[both], feature[lost]), join(bins[shown], bins[shown][both], np.full(len(lost), ONLY_MISSING)),
        join(np.zeros(len(shown)), np.ones(len(both)), np.ones(len(lost))).astype(bool),
        join(shown, shown[both], none(len(lost))), join(none(len(shown)), lost_of[both], lost), sums,
    )


def subtree(codes: Codes, values: tuple, node: int, max_depth: int, bases: np.ndarray,
            find: Callable[..., Split | None]) -> Iterator[tuple[int, Split | None, tuple]]:
    """(node, its split or None in a leaf, its rows' values) of the tree under ``node``."""
    waiting = [(node, codes, values)]
    while waiting:
        node, codes, values = waiting.pop()
        split = find(node, codes, *values) if (node + 1).bit_length() - 1 < max_depth else None
        yield node, split, values
        if split:
            right = codes.right(split, bases)
            for child, side in ((2 * node + 1, ~right), (2 * node + 2, right)):
                waiting.append((child, codes.take(side), tuple(v[side] for v in values)))


# ---- scoring ------------------------------------------------------------------------------------


class Ensemble:
    """Packed trees for vectorised scoring inside tasks; size grows with the model only."""

    def __init__(self, nodes: Sequence[Node], binner: Binner):
        self.fits: dict = {}
        by_tree: dict = {}
        for n in nodes:
            by_tree.setdefault(n.fit, {}).setdefault(n.tree, []).append(n)
        known = binner.bases_by_fit()
        for fit, trees in by_tree.items():
            used = np.unique([n.feature for members in trees.values() for n in members if n.feature >= 0]).astype(np.int64)
            packed = []
            for tree in sorted(trees):
                members = sorted(trees[tree], key=lambda n: n.node)
                at = {n.node: i for i, n in enumerate(members)}
                feature = np.array([n.feature for n in members])
                packed.append((
                    np.where(feature >= 0, np.searchsorted(used, feature), -1),
                    np.array([n.split_bin for n in members]),
                    np.array([n.missing_right for n in members]),
                    np.array([at.get(2 * n.node + 1, 0) for n in members]),
                    np.array([at.get(2 * n.node + 2, 0) for n in members]),
                    np.array([n.value for n in members]),
                    np.array([n.node for n in members]),
                    tree,
                ))
            self.fits[fit] = (known.get(fit, known[None]), used, packed)


def dense(codes: Codes, bases: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Rows x used features of bin numbers; a missing value has bin -1."""
    x = np.zeros((codes.n, max(1, len(used))), dtype=np.int32)
    if len(used) and len(codes.flat):
        feature = owners(bases, codes.flat)
        column = np.minimum(np.searchsorted(used, feature), len(used) - 1)
        mine = used[column] == feature
        bins = codes.flat[mine] - bases[feature[mine]]
        x[codes.row[mine], column[mine]] = np.where(bins == 0, -1, bins)
    return x


def leaf_of(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Place of the leaf of each row of bins in one packed tree."""
    feature, split_bin, missing_right, left, right = tree[:5]
    at = np.zeros(len(x), dtype=np.int64)
    going = np.arange(len(x))
    while True:
        going = going[feature[at[going]] >= 0]
        if not len(going):
            return at
        here = at[going]
        b = x[going, feature[here]]
        goes = np.where(b == -1, missing_right[here], b >= split_bin[here])
        at[going] = np.where(goes, right[here], left[here])


def row_keys(x: np.ndarray, bases: np.ndarray, used: np.ndarray) -> np.ndarray | None:
    """One number per row of bins, equal for equal rows only; ``None`` if there are too many."""
    widths = (bases[used + 1] - bases[used] + 1).tolist()  # bins from -1 on
    if math.prod(widths) >= 1 << 62:
        return None
    key = np.zeros(len(x), dtype=np.int64)
    for j, width in enumerate(widths):
        key = key * width + (x[:, j] + 1)
    return key


class Totals:
    """Sums of leaf values over the trees of a fit; equal rows of bins are walked once."""

    def __init__(self, bases: np.ndarray, used: np.ndarray, trees: list):
        self.bases, self.used, self.trees = bases, used, trees
        self.keys, self.values = np.zeros(0, np.int64), np.zeros(0)

    def walk(self, x: np.ndarray) -> np.ndarray:
        return sum(tree[5][leaf_of(tree, x)] for tree in self.trees)

    def of(self, codes: Codes) -> np.ndarray:
        x = dense(codes, self.bases, self.used)
        key = row_keys(x, self.bases, self.used)
        if key is None:
            return self.walk(x)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.append(self.keys, -1)[at] == distinct
        values = np.append(self.values, 0.0)[at]
        if not known.all():
            values[~known] = self.walk(x[first[~known]])
            keys, sums = np.concatenate([self.keys, distinct[~known]]), np.concatenate([self.values, values[~known]])
            if len(keys) > REMEMBERED:
                keys, sums = distinct, values
            order = np.argsort(keys)
            self.keys, self.values = keys[order], sums[order]
        return values[back]


def add_total(df: DataFrame, ensemble: Ensemble, out: str, codes: str = "codes", fit_col: str | None = None) -> DataFrame:
    """Sum of leaf values over all trees; a narrow Arrow-batched projection."""
    shared = df.sparkSession.sparkContext.broadcast(ensemble.fits)  # plain arrays, as large as the model
    only = next(iter(ensemble.fits))

    def total(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = {}
        for c, fit in batches:
            found, of = Codes.of(c), np.array(fit.to_pylist())
            values = np.zeros(len(c))
            for key in np.unique(of).tolist() if len(c) else ():
                if key in shared.value:
                    mine = of == key
                    if key not in known:
                        known[key] = Totals(*shared.value[key])
                    values[mine] = known[key].of(found if mine.all() else found.take(mine))
            yield pa.array(values)

    return df.withColumn(out, F.arrow_udf(total, "double")(F.col(codes), F.col(fit_col) if fit_col else F.lit(only)))


def add_leaves(df: DataFrame, ensemble: Ensemble, out: str = "leaves", codes: str = "codes", fit=None) -> DataFrame:
    """Leaf node of every tree, in tree order."""
    shared = df.sparkSession.sparkContext.broadcast(ensemble.fits)
    key = next(iter(ensemble.fits)) if fit is None else fit

    @F.arrow_udf("array<int>")
    def leaves(c: pa.Array) -> pa.Array:
        bases, used, trees = shared.value[key]
        x = dense(Codes.of(c), bases, used)
        found = np.stack([t[6][leaf_of(t, x)] for t in trees], axis=1).astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(len(c) + 1, dtype=np.int32) * len(trees), found.ravel())

    return df.withColumn(out, leaves(F.col(codes)))


def place(batch: pa.RecordBatch, fits: dict) -> Iterator[tuple]:
    """(fit, mask of its rows, codes, tree, node of each row) for every fit and tree that a batch meets."""
    fit = np.array(batch.column("fit").to_pylist())
    codes = Codes.of(batch.column("codes"))
    for key in np.unique(fit):
        mine = fit == key
        own = codes.take(mine)
        bases, used, trees = fits[key.item()]
        x = dense(own, bases, used)
        for tree in trees:
            yield key.item(), mine, own, tree[7], tree[6][leaf_of(tree, x)]


def spread(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows dealt by keys to a number of partitions that is kept, as their work is large for their bytes."""
    return rows.repartition(max(1, min(parts, 4000)), *keys)


# ---- gradient trees -----------------------------------------------------------------------------


def gradient_split(reg_lambda: float, gamma: float, min_child_weight: float):
    """A function from a node's sums per code, and in all, to its best split.

    The gain is ``G_l^2/(H_l+lambda) + G_r^2/(H_r+lambda) - G^2/(H+lambda)`` and must exceed
    ``gamma``; both sides need ``min_child_weight`` of H.
    """
    def find(code: np.ndarray, g: np.ndarray, h: np.ndarray, bases: np.ndarray, tg: float, th: float, *more: np.ndarray):
        every = options(code, bases, g, h, *more)
        gain = gradient_gain(*every.sums[:2], tg, th, reg_lambda, min_child_weight)
        split = every.best(gain, max(gamma, MIN_GAIN))
        return split, every

    return find


def gradient_gain(rg, rh, tg, th, reg_lambda: float, min_child_weight: float) -> np.ndarray:
    """Gain of every option, -1 where a side has too little."""
    lg, lh = tg - rg, th - rh
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = rg * rg / (rh + reg_lambda) + lg * lg / (lh + reg_lambda) - tg * tg / (th + reg_lambda)
    fine = (rh >= min_child_weight) & (lh >= min_child_weight) & (rh > 0) & (lh > 0)
    return np.where(fine, gain, -1.0)


def gradient_levels(codes: Codes, g: np.ndarray, h: np.ndarray, start: int, max_depth: int, bases: np.ndarray,
                    reg_lambda: float, gamma: float, min_child_weight: float) -> Iterator[tuple]:
    """(node, feature, split bin, missing right, gain, g, h) of the tree under ``start``, all nodes of a level at once.

    A level's nodes are laid side by side, each with codes of its own.
    """
    frontier, at, width = np.array([start]), np.zeros(codes.n, dtype=np.int64), len(bases) - 1
    while len(frontier):
        n, span = len(frontier), int(bases[-1])
        tg, th, tk = (np.bincount(at, weights=v, minlength=n) for v in (g, h, np.ones(codes.n)))
        feature, cut = np.full(n, -1), np.zeros(n, dtype=np.int64)
        lost, gain = np.zeros(n, dtype=bool), np.zeros(n)
        if (int(frontier[0]) + 1).bit_length() - 1 < max_depth and len(codes.flat):
            side = Codes(at[codes.row] * span + codes.flat, codes.row, codes.n)
            own = np.append((np.arange(n)[:, None] * span + bases[:-1]).ravel(), n * span)
            code, *sums = side.sums(g, h, np.ones(codes.n))
            every = options(code, own, *sums)
            node = every.feature // width
            rg, rh, rk = every.sums
            value = gradient_gain(rg, rh, tg[node], th[node], reg_lambda, min_child_weight)
            value = np.where((rk > 0) & (rk < tk[node]), value, -1.0)
            order = np.lexsort((every.missing_right, every.cut, every.feature, -value.astype(np.float32), node))
            there, first = np.unique(node[order], return_index=True)
            best = order[first]
            fine = value[best] > max(gamma, MIN_GAIN)
            there, best = there[fine], best[fine]
            feature[there], cut[there] = every.feature[best] % width, every.cut[best]
            lost[there], gain[there] = every.missing_right[best], value[best]
        yield from zip(frontier.tolist(), feature.tolist(), cut.tolist(), lost.tolist(), gain.tolist(), tg.tolist(), th.tolist())
        split = feature >= 0
        going = split[at]
        codes, g, h, at = codes.take(going), g[going], h[going], at[going]
        of = at[codes.row]
        low, high = bases[feature[of]], bases[feature[of] + 1]
        goes = (codes.flat > low) & (codes.flat >= low + cut[of]) & (codes.flat < high) | lost[of] & (codes.flat == low)
        right = np.zeros(codes.n, dtype=np.int64)
        right[codes.row[goes]] = 1
        at = 2 * (np.cumsum(split) - 1)[at] + right
        frontier = (2 * frontier[split][:, None] + [1, 2]).ravel()


_GROWN = "fit {kind}, tree int, node int, feature int, split_bin int, missing_right boolean, gain double, g double, h double"


def _histogram(rows: DataFrame, nodes: list[Node], wanted: dict, binner: Binner) -> DataFrame:
    """(fit, node, code, g, h, k) of the wanted nodes; the code after the last holds the node's totals."""
    kind = rows.schema["fit"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((Ensemble(nodes, binner).fits, wanted))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, asked = shared.value
        for batch in parts:
            g, h = batch.column("g").to_numpy(), batch.column("h").to_numpy()
            for fit, mine, codes, _, node in place(batch, fits):
                inside = np.isin(node, asked.get(fit, []))
                if not inside.any():
                    continue
                own, node, top = codes.take(inside), node[inside], int(fits[fit][0][-1])
                size = np.bincount(own.row, minlength=own.n) + 1.0
                code = np.concatenate([own.flat, np.full(own.n, top)])
                row = np.concatenate([own.row, np.arange(own.n)])
                key, at = np.unique(node[row].astype(np.int64) * (top + 1) + code, return_inverse=True)
                sums = [np.bincount(at, weights=v[row], minlength=len(key)) for v in (g[mine][inside], h[mine][inside], size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fit] * len(key), batch.schema.field("fit").type), pa.array((key // (top + 1)).astype(np.int32)),
                     pa.array((key % (top + 1)).astype(np.int32)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))],
                    ["fit", "node", "code", "g", "h", "k"],
                )

    return rows.mapInArrow(run, f"fit {kind}, node int, code int, g double, h double, k long").groupBy("fit", "node", "code").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("k").alias("k")
    )


def _top_levels(rows: DataFrame, binner: Binner, sizes: dict, depth: Callable, find) -> tuple[list[Node], dict]:
    """Split nodes down to where all children have at most ``ENTRIES`` codes, and the nodes to be finished there."""
    spark, kind = rows.sparkSession, rows.schema["fit"].dataType.simpleString()
    bases = binner.bases_by_fit()
    nodes = {(fit, 0): Node(fit, 0, 0) for fit in sizes}
    closing = {fit: [0] for fit, n in sizes.items() if n <= ENTRIES}
    frontier = [(fit, 0) for fit, n in sizes.items() if n > ENTRIES]
    halves: list[tuple] = []  # (fit, parent, smaller child, larger child)
    above = None

    def best(group: pa.Table) -> pa.Table:
        fit = group["fit"][0].as_py()
        own = bases.get(fit, bases[None])
        code, g, h, k = (group[c].to_numpy() for c in ("code", "g", "h", "k"))
        order = np.argsort(code)
        code, g, h, k = code[order], g[order], h[order], k[order].astype(float)
        tg, th = g[-1], h[-1]
        split, every = find(code[:-1], g[:-1], h[:-1], own, tg, th, k[:-1])
        at = None if split is None else int(np.flatnonzero(
            (every.feature == split.feature) & (every.cut == split.cut) & (every.missing_right == split.missing_right))[0])
        right = [0.0, 0.0, 0.0] if at is None else [float(s[at]) for s in every.sums]
        one = split or Split(-1, 0, False, 0.0)
        return pa.table({
            "fit": group["fit"].slice(0, 1), "node": group["node"].slice(0, 1), "feature": pa.array([one.feature], pa.int32()),
            "split_bin": pa.array([one.cut], pa.int32()), "missing_right": [one.missing_right], "gain": [one.gain],
            "g": [float(tg)], "h": [float(th)], "rg": [right[0]], "rh": [right[1]],
            "k": pa.array([int(k[-1])], pa.int64()), "rk": pa.array([int(right[2])], pa.int64()),
        })

    schema = _GROWN.format(kind=kind).replace(" tree int,", "") + ", rg double, rh double, k long, rk long"
    while frontier:
        wanted: dict = {}
        for fit, node in ([(f, small) for f, _, small, _ in halves] if halves else frontier):
            wanted.setdefault(fit, []).append(node)
        part = materialize(_histogram(rows, list(nodes.values()), wanted, binner), "histogram")
        sums = part
        if halves:
            pairs = F.broadcast(spark.createDataFrame(halves, f"fit {kind}, parent int, small int, large int"))
            parent = above.alias("p").join(pairs.alias("q"), F.expr("p.node = q.parent and p.fit = q.fit"))
            less = part.alias("p").join(pairs.alias("q"), F.expr("p.node = q.small and p.fit = q.fit"))
            parent = parent.selectExpr("p.fit", "large", "code", "g", "h", "k")
            less = less.selectExpr("p.fit", "large", "code", "-g as g", "-h as h", "-k as k")
            rest = parent.union(less).groupBy("fit", F.col("large").alias("node"), "code").agg(
                F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("k").alias("k")).filter("k > 0")
            sums = materialize(part.unionByName(rest), "histogram")
            for old in (above, part):
                discard(old)
        above = sums
        listed = F.broadcast(spark.createDataFrame(frontier, f"fit {kind}, node int"))
        found = sums.join(listed, ["fit", "node"]).groupBy("fit", "node").applyInArrow(best, schema).collect()
        frontier, halves = [], []
        for r in found:
            n = nodes[(r.fit, r.node)]
            n.g, n.h = r.g, r.h
            if r.feature < 0:
                continue
            n.feature, n.split_bin, n.missing_right, n.gain = r.feature, r.split_bin, r.missing_right, r.gain
            left, right = 2 * r.node + 1, 2 * r.node + 2
            nodes[(r.fit, left)] = Node(r.fit, 0, left, g=r.g - r.rg, h=r.h - r.rh)
            nodes[(r.fit, right)] = Node(r.fit, 0, right, g=r.rg, h=r.rh)
            if (left + 1).bit_length() - 1 == depth(r.fit):
                continue
            big = []
            for child, k in ((left, r.k - r.rk), (right, r.rk)):
                (big if k > ENTRIES else closing.setdefault(r.fit, [])).append(child)
            if big:
                small, large = (right, left) if r.rk <= r.k - r.rk else (left, right)
                halves.append((r.fit, r.node, small, large))
                frontier += [(r.fit, c) for c in big]
    if above is not None:
        discard(above)
    return list(nodes.values()), closing


def grow(rows: DataFrame, binner: Binner, sizes: dict, max_depth: int | dict, reg_lambda: float, gamma: float,
         min_child_weight: float, tree: int = 0) -> list[Node]:
    """The nodes of one tree per fit of ``rows`` (fit, codes, g, h); ``sizes`` has each fit's number of codes, a row counting one more.

    Missing values take the side with the larger gain. ``max_depth`` may differ between fits. Nodes arrive at the driver, which
    holds the model anyway.
    """
    depth = max_depth.get if isinstance(max_depth, dict) else lambda fit: max_depth
    spark, kind = rows.sparkSession, rows.schema["fit"].dataType.simpleString()
    find = gradient_split(reg_lambda, gamma, min_child_weight)
    bases = binner.bases_by_fit()
    nodes: list[Node] = []
    if max_depth == 0:
        sums = rows.groupBy("fit").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        return [Node(r.fit, tree, 0, g=r.g, h=r.h) for r in sums.collect()]
    if all(n <= ENTRIES for n in sizes.values()):
        below = rows.select("fit", F.lit(0).alias("node"), "codes", "g", "h")
    else:
        rows = materialize(rows, "gradients")
        nodes, closing = _top_levels(rows, binner, sizes, depth, find)
        shared = spark.sparkContext.broadcast((Ensemble(nodes, binner).fits, closing))

        def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fits, ends = shared.value
            for batch in parts:
                for fit, mine, _, _, node in place(batch, fits):
                    inside = np.isin(node, ends.get(fit, []))
                    taken = batch.filter(pa.array(mine)).filter(pa.array(inside))
                    yield taken.append_column("node", pa.array(node[inside].astype(np.int32))).select(["fit", "node", "codes", "g", "h"])

        below = rows.select("fit", "codes", "g", "h").mapInArrow(route, f"fit {kind}, node int, codes array<int>, g double, h double")

    def finish(group: pa.Table) -> pa.Table:
        fit, start = group["fit"][0], group["node"][0].as_py()
        own = bases.get(fit.as_py(), bases[None])
        values = (group["g"].to_numpy(), group["h"].to_numpy())
        out = list(gradient_levels(Codes.of(group["codes"]), *values, start, depth(fit.as_py()), own, reg_lambda, gamma, min_child_weight))
        columns = list(zip(*out))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
        names = ["node", "feature", "split_bin", "missing_right", "gain", "g", "h"]
        return pa.table({
            "fit": pa.repeat(fit, len(out)), "tree": pa.array([tree] * len(out), pa.int32()),
            **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)},
        })

    if len(sizes) > 1:
        below = spread(below, 2 * len(sizes), "fit", "node")
    found = below.groupBy("fit", "node").applyInArrow(finish, _GROWN.format(kind=kind)).collect()
    done = {(r.fit, r.node): Node(**r.asDict()) for r in found}
    rest = [Node(**(vars(n) | {"tree": tree})) for n in nodes if (n.fit, n.node) not in done]
    if all(n <= ENTRIES for n in sizes.values()):
        return list(done.values())
    discard(rows)
    return [*rest, *done.values()]


def importance(nodes: DataFrame, features: Sequence[str], kind: str = "weight", top: int = 20,
               flags: DataFrame | None = None) -> DataFrame:
    """Split count (``weight``) or mean gain (``gain``) per feature, largest first; ``flags`` (place, feature) names those without columns."""
    spark = nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(features)), "feature int, name string")
    if flags is not None:
        names = names.union(flags.select((F.col("place") + len(features)).cast("int"), "feature"))
        names = names.join(F.broadcast(nodes.select("feature").distinct()), "feature", "left_semi")
    value = F.count(F.lit(1)).cast("double") if kind == "weight" else F.avg("gain")
    return (
        nodes.filter("feature >= 0")
        .groupBy("feature")
        .agg(value.alias("importance"))
        .join(F.broadcast(names), "feature")
        .select(F.col("name").alias("feature"), "importance")
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


def split_gains(df: DataFrame, features: Sequence[str], reg_lambda: float, bins: int = 2) -> DataFrame:
    """Best root gain of each feature for rows with ``gradient`` and ``curvature``."""
    binner = fit_binner(df, features, bins)
    bases = binner.bases
    coded = binner.transform(df).selectExpr("codes", "gradient as g", "curvature as h")
    sums = coded.select("g", "h", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    find = gradient_split(reg_lambda, 0.0, 0.0)
    tg, th = coded.agg(F.sum("g"), F.sum("h")).first()

    def each(group: pa.Table) -> pa.Table:
        """Best gain of a feature from the sums of its own codes."""
        code, g, h = (group[c].to_numpy() for c in ("code", "g", "h"))
        order = np.argsort(code)
        split, _ = find(code[order], g[order], h[order], bases, tg, th)
        found = [split] if split else []
        return pa.table({"feature": pa.array([s.feature for s in found], pa.int32()), "gain": pa.array([s.gain for s in found], pa.float64())})

    owner = df.sparkSession.createDataFrame(
        [(int(c), int(j)) for j in range(len(features)) for c in range(bases[j], bases[j + 1])], "code int, owner int"
    )
    gains = sums.join(F.broadcast(owner), "code").groupBy("owner").applyInArrow(each, "feature int, gain double")
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    return gains.join(F.broadcast(names), "feature").select(F.col("name").alias("feature"), "gain")
