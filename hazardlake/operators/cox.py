"""Proportional-hazards regression by distributed Newton steps.

Contract: Efron ties; ridge penalty ``n * penalizer / 2 * sum((beta_j * sd_j)**2)`` (that is,
on standardised features, ``sd`` being the sample deviation); coefficients on the original
scale; standard errors from the inverse penalised Hessian.

Several fits run in the same jobs: with ``fit_col`` every distinct value is its own
training set (a fold, a permutation, a subset) and gets its own coefficients. The driver
holds p-sized vectors and p x p matrices per fit, nothing that grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import scalars as sc
from ..functions.scalars import quoted
from ..session import discard, materialize
from .encoding import EVENT, TIME
from .km import Z95
from .prefix import cut_points, running, time_blocks

BROADCAST_ROWS = 1_000_000
#: Columns beyond which rows are summed as arrays, by matrix products.
WIDE = 50
#: Cells of a block's matrix, columns of a chunk, cells of a part of a Gram matrix, and such parts added up at a time.
BLOCK_CELLS, CHUNK, SLAB_CELLS, FAN_IN = 1 << 22, 32, 1 << 17, 64
#: Least exponent of a weight beside the largest one, so that squares of weights stay in the range of doubles.
LEAST = -300.0
_EXPLICIT = 16


def tie_sums(z: str, d: str) -> tuple[str, str, str]:
    """SQL for the sums of 1/(z-l), 1/(z-l)**2 and ln(z-l) over l = 0 .. d-1, for z >= d.

    Constant work per row even when a time has billions of deaths: the last 16 terms are
    added one by one, the smooth rest by the midpoint Euler-Maclaurin series, whose error
    is below 1e-12 there because every argument exceeds 16.
    """
    near = [(f"{d} > {k}", f"({z} - {d} + {1 + k})") for k in range(_EXPLICIT)]
    rest = f"({d} - {_EXPLICIT})"
    a, b = f"({z} - {rest} + 0.5D)", f"({z} + 0.5D)"

    def explicit(term: str) -> str:
        return " + ".join(f"if({have}, {term.format(x=x)}, 0D)" for have, x in near)

    def gap(power: int) -> str:
        return f"(pow({a}, -{power}D) - pow({b}, -{power}D))"

    log_ratio = f"log1p({rest} / {a})"
    h1 = f"{log_ratio} - {gap(2)} / 24 + {gap(4)} * 7D / 960 - {gap(6)} * 31D / 8064"
    h2 = f"{gap(1)} - {gap(3)} / 12 + {gap(5)} * 7D / 240 - {gap(7)} * 31D / 1344"
    lg = (
        f"{rest} * ln({b}) + {a} * {log_ratio} - {rest} + {gap(1)} / 24"
        f" - {gap(3)} * 7D / 2880 + {gap(5)} * 31D / 40320"
    )
    return tuple(
        f"{explicit(term)} + if({rest} > 0, {series}, 0D)"
        for term, series in (("1 / {x}", h1), ("1 / ({x} * {x})", h2), ("ln({x})", lg))
    )


@dataclass
class CoxModel:
    """Coefficients per fit (key ``None`` for a single fit)."""

    features: list[str]
    coef: dict
    se: dict
    mean: dict
    log_likelihood: dict
    iterations: int = 0

    def rows(self, key=None) -> list[tuple]:
        out = []
        for j, name in enumerate(self.features):
            b, s = float(self.coef[key][j]), float(self.se[key][j])
            z = b / s if s > 0 else float("nan")
            p = math.erfc(abs(z) / math.sqrt(2.0)) if s > 0 else float("nan")
            out.append((j, name, b, math.exp(b), s, b - Z95 * s, b + Z95 * s, z, p, float(self.mean[key][j])))
        return out

    def table(self, spark: SparkSession, key=None) -> DataFrame:
        """Coefficient table: the model as saved."""
        return spark.createDataFrame(
            self.rows(key),
            "position int, feature string, coef double, hazard_ratio double, se double, "
            "coef_lower double, coef_upper double, z double, p double, mean double",
        )

    @staticmethod
    def from_table(table: DataFrame) -> CoxModel:
        rows = table.orderBy("position").collect()
        return CoxModel(
            [r.feature for r in rows],
            {None: np.array([r.coef for r in rows])},
            {None: np.array([r.se for r in rows])},
            {None: np.array([r["mean"] for r in rows])},
            {None: float("nan")},
        )

    def margin(self, key=None, columns: dict[str, Column] | None = None) -> Column:
        """Centred linear predictor as one expression over the encoded columns."""
        if len(self.features) > WIDE:
            values = F.array(*[(columns or {}).get(name, quoted(name)).cast("double") for name in self.features])
            return _product(values, F.lit(self.coef[key].tolist()), F.lit(self.mean[key].tolist()))
        total = F.lit(0.0)
        for j, name in enumerate(self.features):
            value = (columns or {}).get(name, quoted(name))
            total = total + (value - F.lit(float(self.mean[key][j]))) * F.lit(float(self.coef[key][j]))
        return total

    def risk(self, key=None, columns: dict[str, Column] | None = None) -> Column:
        """Partial hazard ``exp((x - mean) . beta)``."""
        return F.exp(self.margin(key, columns))

    def score(self, df: DataFrame, fit_col: str, out: str = "risk") -> DataFrame:
        """Partial hazard of each row under the coefficients of its own fit."""
        coefs = _coef_table(df.sparkSession, fit_col, df.schema[fit_col].dataType.simpleString(), self.coef, self.mean)
        total = F.lit(0.0)
        if len(self.features) > WIDE:
            total = _product(F.array(*[quoted(name).cast("double") for name in self.features]), F.col("__beta"), F.col("__mean"))
        for j, name in enumerate(self.features if len(self.features) <= WIDE else ()):
            total = total + (quoted(name) - F.col("__mean")[j]) * F.col("__beta")[j]
        return df.join(F.broadcast(coefs), fit_col).withColumn(out, F.exp(total)).drop("__beta", "__mean")


def _coef_table(spark: SparkSession, fit_col: str, kind: str, coef: dict, mean: dict | None = None) -> DataFrame:
    """One row per fit; broadcast is safe because the driver built it."""
    rows = [
        (k, [float(x) for x in b], [float(x) for x in (mean[k] if mean else np.zeros(len(b)))])
        for k, b in coef.items()
    ]
    return spark.createDataFrame(
        rows, f"`{fit_col}` {kind}, __beta array<double>, __mean array<double>"
    )


def _product(values: Column, coefs: Column, means: Column) -> Column:
    """Sum of coefficients times centred values, over arrays."""
    pairs = F.zip_with(F.zip_with(values, means, lambda x, m: x - m), coefs, lambda x, b: x * b)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(values: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip(_upper(p), values):
        out[i, j] = out[j, i] = v
    return out


def efron_terms(risk: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Efron weights of every death time from ``d``, ``dw0`` (weight of the deaths) and ``S0`` (weight at risk)."""
    h1, h2, lg = tie_sums("z", "d")
    tied = risk.filter("d > 0").selectExpr(*kept, "greatest(d * S0 / dw0, d) as z").selectExpr(
        *kept, "z", f"{h1} as h1", f"{h2} as h2", f"{lg} as lg"
    )
    return tied.selectExpr(
        *kept,
        "d / dw0 * h1 as a1",
        "(z * h1 - d) / dw0 as b1",
        "d * d / (dw0 * dw0) * h2 as a2",
        "d / (dw0 * dw0) * (z * h2 - h1) as b2",
        "(z * z * h2 - 2 * z * h1 + d) / (dw0 * dw0) as c2",
        "d * ln(dw0 / d) + lg as logs",
    )


class _Problem:
    """Training rows with features scaled once (for conditioning only) and collapsed."""

    def __init__(self, df: DataFrame, features: Sequence[str], fit_col: str | None):
        self.features, self.p = list(features), len(features)
        self.spark = df.sparkSession
        self.fit = fit_col or "__fit"
        df = df if fit_col else df.withColumn("__fit", F.lit(0))
        self.kind = df.schema[self.fit].dataType.simpleString()
        cols = [f"cast(`{c}` as double)" for c in self.features]
        whole = df.groupBy(self.fit).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(EVENT).cast("int")).alias("deaths"),
            *[F.expr(f"avg({c}) as mean{j}") for j, c in enumerate(cols)],
            *[F.expr(f"coalesce(stddev_samp({c}), 0D) as sd{j}") for j, c in enumerate(cols)],
            *[F.expr(f"count_if({c} is null or isnan({c})) as null{j}") for j, c in enumerate(cols)],
            *[F.expr(f"min({c}) as low{j}") for j, c in enumerate(cols)],
            *[F.expr(f"max({c}) as high{j}") for j, c in enumerate(cols)],
        ).collect()
        missing = {f: sum(r[f"null{j}"] for r in whole) for j, f in enumerate(self.features)}
        if any(missing.values()):
            raise ValueError(f"missing values in Cox features: {({k: v for k, v in missing.items() if v})}")
        if not whole:
            raise ValueError("no training rows")
        self.n = {r[self.fit]: r["n"] for r in whole}
        self.mean = {r[self.fit]: np.array([r[f"mean{j}"] for j in range(self.p)]) for r in whole}
        self.sd = {r[self.fit]: np.array([r[f"sd{j}"] for j in range(self.p)]) for r in whole}
        first = whole[0][self.fit]
        self.shift = self.mean[first]
        self.scale = np.where(self.sd[first] > 0, self.sd[first], 1.0)

        ends = {r[self.fit]: np.array([[r[f"low{j}"], r[f"high{j}"]] for j in range(self.p)], dtype=float).reshape(self.p, 2) for r in whole}
        self.ends = {k: (e - self.shift[:, None]) / self.scale[:, None] for k, e in ends.items()}
        self.top: dict = {}

        scaled = [
            f"({c} - {float(self.shift[j])!r}D) / {float(self.scale[j])!r}D as x{j}" for j, c in enumerate(cols)
        ]
        keys = [self.fit, f"{TIME} as t", f"cast({EVENT} as int) as e"]
        collapsed = df.selectExpr(*keys, *scaled).groupBy(
            self.fit, "t", "e", *[f"x{j}" for j in range(self.p)]
        ).agg(F.count(F.lit(1)).alias("m"))
        self.rows = materialize(collapsed, "cox")
        times = self.rows.select(self.fit, "t").distinct()
        self.times = materialize(times, "cox-times")
        self.n_times = self.times.count()
        self.cuts = cut_points(self.times.select((-F.col("t")).alias("back")), "back")
        deaths = self.rows.filter("e = 1").groupBy(self.fit).agg(
            *[F.expr(f"sum(m * x{j}) as x{j}") for j in range(self.p)]
        ).collect()
        self.death_x = {k: np.zeros(self.p) for k in self.n} | {
            r[self.fit]: np.array([r[f"x{j}"] for j in range(self.p)]) for r in deaths
        }

    def _with_weight(self, beta: dict) -> DataFrame:
        coefs = _coef_table(self.spark, self.fit, self.kind, beta, {k: np.array([v]) for k, v in self.top.items()})
        eta = " + ".join(f"x{j} * __beta[{j}]" for j in range(self.p))
        joined = self.rows.join(F.broadcast(coefs), self.fit)
        return joined.withColumn("w", F.expr(f"m * exp(greatest({eta} - __mean[0], {LEAST}))")).drop("__beta", "__mean")

    def _shift_weights(self, beta: dict) -> None:
        """Divide all weights by the largest one where their squares could leave the range of doubles; only their ratios count."""
        self.top = {k: 0.0 for k in self.n}
        bound = max(float(np.abs(beta[k][:, None] * self.ends[k]).max(axis=1).sum()) for k in self.n)
        if bound > -LEAST:
            coefs = _coef_table(self.spark, self.fit, self.kind, beta)
            eta = F.expr(" + ".join(f"x{j} * __beta[{j}]" for j in range(self.p)))
            tops = self.rows.join(F.broadcast(coefs), self.fit).groupBy(self.fit).agg(F.max(eta).alias("top")).collect()
            self.top |= {r[self.fit]: r.top for r in tops}

    def risk_sets(self, beta: dict) -> DataFrame:
        """Per (fit, time): risk-set sums, death sums and the Efron weights of the time."""
        p = range(self.p)
        self._shift_weights(beta)
        per_time = self._with_weight(beta).groupBy(self.fit, "t").agg(*map(F.expr, [
            "cast(sum(if(e = 1, m, 0)) as double) as d",
            "sum(w) as w0",
            "sum(if(e = 1, w, 0D)) as dw0",
            *[f"sum(w * x{j}) as w1_{j}" for j in p],
            *[f"sum(if(e = 1, w * x{j}, 0D)) as dw1_{j}" for j in p],
        ])).withColumn("back", -F.col("t"))
        sums = {"S0": "w0"} | {f"S1_{j}": f"w1_{j}" for j in p}
        risk = running(per_time, [self.fit], "back", sums=sums, cuts=self.cuts)
        kept = [self.fit, "t", "d", "dw0", *[f"S1_{j}" for j in p], *[f"dw1_{j}" for j in p]]
        return efron_terms(risk, kept)

    def first_order(self, sets: DataFrame) -> dict:
        """Per fit: sum of logs, expected covariate sums, outer products over the times."""
        rows = sets.groupBy(self.fit).agg(*map(F.expr, [
            "sum(logs) as logs", "sum(d) as d",
            *[f"sum(a1 * S1_{j} - b1 * dw1_{j}) as g{j}" for j in range(self.p)],
            *[
                f"sum(a2 * S1_{i} * S1_{j} - b2 * (S1_{i} * dw1_{j} + dw1_{i} * S1_{j})"
                f" + c2 * dw1_{i} * dw1_{j}) as o{i}_{j}"
                for i, j in _upper(self.p)
            ],
        ])).collect()
        return {
            r[self.fit]: (
                r["logs"] + r["d"] * self.top[r[self.fit]],
                np.array([r[f"g{j}"] for j in range(self.p)]),
                _square([r[f"o{i}_{j}"] for i, j in _upper(self.p)], self.p),
            )
            for r in rows
        }

    def second_order(self, sets: DataFrame, beta: dict) -> dict:
        """Per fit: sum over rows of w x x' times the hazard each row was exposed to.

        Swapping the sums over times and rows replaces a p x p table per time by two
        numbers per time that are joined back to the rows. ``sets`` has the death times
        only, so rows look their exposure up through the full list of times.
        """
        steps = self.times.join(sets.select(self.fit, "t", "a1", "b1"), [self.fit, "t"], "left")
        hazard = running(
            steps.na.fill(0.0, ["a1", "b1"]), [self.fit], "t",
            sums={"exposure": "a1"}, cuts=[-c for c in reversed(self.cuts)],
        ).select(self.fit, "t", "exposure", "b1")
        if self.n_times <= BROADCAST_ROWS:
            hazard = F.broadcast(hazard)
        joined = self._with_weight(beta).join(hazard, [self.fit, "t"])
        u = joined.withColumn("u", F.expr("w * (exposure - if(e = 1, b1, 0D))"))
        rows = u.groupBy(self.fit).agg(
            *[F.expr(f"sum(u * x{i} * x{j}) as h{i}_{j}") for i, j in _upper(self.p)]
        ).collect()
        return {r[self.fit]: _square([r[f"h{i}_{j}"] for i, j in _upper(self.p)], self.p) for r in rows}


class _WideProblem:
    """The same sums for many columns: rows as arrays, in blocks of time, summed by matrix products.

    What a time needs besides its rows are numbers (the weight at risk, Efron's weights), which come from sums per time. Only the
    weighted sum of columns at risk is a vector per time: a block gets what lies behind it and goes on from there.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], fit_col: str | None):
        self.features, self.p = list(features), len(features)
        self.spark = df.sparkSession
        self.fit = "fit"
        x = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features])
        rows = df.select(
            (F.col(fit_col) if fit_col else F.lit(0)).alias("fit"), F.col(TIME).cast("double").alias("t"),
            F.col(EVENT).cast("int").alias("e"), x.alias("x"),
        ).withColumn("key", F.xxhash64("t", "e", "x"))
        self.kind = rows.schema["fit"].dataType.simpleString()
        self.block_rows = max(64, BLOCK_CELLS // self.p)
        self.rows = materialize(time_blocks(rows, "t", self.block_rows), "cox")
        found = self._totals()
        if not found:
            raise ValueError("no training rows")
        missing = {f: int(n) for f, n in zip(self.features, sum(v[3] for v in found.values())) if n}
        if missing:
            raise ValueError(f"missing values in Cox features: {missing}")
        self.n = {k: int(v[0][0]) for k, v in found.items()}
        self.mean = {k: v[1] for k, v in found.items()}
        self.sd = {k: np.sqrt(v[2] / max(1, self.n[k] - 1)) for k, v in found.items()}
        first = next(iter(self.n))
        self.shift = self.mean[first]
        self.scale = np.where(self.sd[first] > 0, self.sd[first], 1.0)
        self.death_x = {k: (v[4] - v[0][1] * self.shift) / self.scale for k, v in found.items()}
        self.times = materialize(self.rows.select("fit", "t").distinct(), "cox-times")
        self.n_times = self.times.count()
        self.cuts = cut_points(self.times.select((-F.col("t")).alias("back")), "back")

    def _totals(self) -> dict:
        """Per fit (count and deaths, means, squares about them, missing values, columns summed over deaths)."""
        p = self.p

        def add(a: list | None, b: list) -> list:
            if a is None:
                return b
            n, gap = a[0][0] + b[0][0], b[1] - a[1]
            return [a[0] + b[0], a[1] + gap * b[0][0] / n, a[2] + b[2] + gap**2 * a[0][0] * b[0][0] / n, a[3] + b[3], a[4] + b[4]]

        def pack(found: dict, kind) -> pa.RecordBatch:
            data = [np.concatenate(v).tobytes() for v in found.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(data, pa.binary())], ["fit", "data"])

        def unpack(data: bytes) -> list:
            v = np.frombuffer(data)
            return [v[:2], *(v[2 + i * p : 2 + (i + 1) * p] for i in range(4))]

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict = {}
            kind = pa.int32()
            for batch in parts:
                kind = batch.schema.field("fit").type
                fit = np.array(batch.column("fit").to_pylist())
                x, e = _matrix(batch.column("x"), p), batch.column("e").to_numpy()
                for k in np.unique(fit):
                    mine, dead = x[fit == k], x[(fit == k) & (e == 1)]
                    lost = np.isnan(mine)
                    mean = mine.mean(axis=0)
                    one = [np.array([len(mine), len(dead)], float), mean, ((mine - mean) ** 2).sum(axis=0), lost.sum(axis=0).astype(float), dead.sum(axis=0)]
                    found[k.item()] = add(found.get(k.item()), one)
            if found:
                yield pack(found, kind)

        def merge(group: pa.Table) -> pa.Table:
            total = None
            for data in group["data"].to_pylist():
                total = add(total, unpack(data))
            return pa.Table.from_batches([pack({group["fit"][0].as_py(): total}, group["fit"].type)])

        schema = f"fit {self.kind}, data binary"
        each = self.rows.select("fit", "e", "x").mapInArrow(run, schema).groupBy("fit").applyInArrow(merge, schema)
        return {r.fit: unpack(bytes(r.data)) for r in each.collect()}

    def risk_sets(self, beta: dict) -> DataFrame:
        """Per (fit, death time): Efron's weights; the weights of rows are divided by the largest one of their fit."""
        coefs, shift, scale, p = beta, self.shift, self.scale, self.p

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                fit = np.array(batch.column("fit").to_pylist())
                x = (_matrix(batch.column("x"), p) - shift) / scale
                eta = np.zeros(len(x))
                for k in np.unique(fit):
                    eta[fit == k] = x[fit == k] @ coefs[k.item()]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("fit", "t", "e")] + [pa.array(eta)], ["fit", "t", "e", "eta"])

        scored = materialize(self.rows.select("fit", "t", "e", "x").mapInArrow(run, f"fit {self.kind}, t double, e int, eta double"), "eta")
        self.top = {r.fit: r.top for r in scored.groupBy("fit").agg(F.max("eta").alias("top")).collect()}
        tops = self.spark.createDataFrame(list(self.top.items()), f"fit {self.kind}, top double")
        per_time = scored.join(F.broadcast(tops), "fit").withColumn("w", F.expr(f"exp(greatest(eta - top, {LEAST}))")).groupBy("fit", "t").agg(
            F.expr("cast(sum(e) as double) as d"), F.expr("sum(w) as w0"), F.expr("sum(if(e = 1, w, 0D)) as dw0")
        ).withColumn("back", -F.col("t"))
        risk = running(per_time, ["fit"], "back", sums={"S0": "w0"}, cuts=self.cuts)
        sets = materialize(efron_terms(risk, ["fit", "t", "d", "dw0"]), "sets")
        discard(scored)
        self.beta = {k: b.copy() for k, b in beta.items()}
        return sets

    def _behind(self) -> DataFrame:
        """(fit, block, part, chunk, behind, here, dead): sums of weighted columns behind each block, and at a block of one time.

        Columns go in chunks, so a task holds some columns of all blocks of a fit.
        """
        coefs, shift, scale, p, top = self.beta, self.shift, self.scale, self.p, self.top
        chunks = range(0, p, CHUNK)

        def sums(group: pa.Table) -> pa.Table:
            k = group["fit"][0].as_py()
            x = (_matrix(group["x"], p) - shift) / scale
            w = np.exp(np.maximum(x @ coefs[k] - top[k], LEAST))
            e = group["e"].to_numpy()
            all_, dead = w @ x, (w * e) @ x
            same = lambda c: pa.array([group[c][0].as_py()] * len(chunks), pa.int32())
            return pa.table({
                "fit": pa.array([k] * len(chunks), group["fit"].type), "block": same("block"), "part": same("part"), "parts": same("parts"),
                "chunk": pa.array(range(len(chunks)), pa.int32()),
                "w1": pa.array([all_[c : c + CHUNK].tobytes() for c in chunks], pa.binary()),
                "dw1": pa.array([dead[c : c + CHUNK].tobytes() for c in chunks], pa.binary()),
            })

        def behind(group: pa.Table) -> pa.Table:
            group = group.sort_by([("block", "descending")])
            vectors = {c: np.stack([np.frombuffer(b) for b in group[c].to_pylist()]) for c in ("w1", "dw1")}
            block = group["block"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            total = {c: np.add.reduceat(v, starts, axis=0) for c, v in vectors.items()}
            later = np.cumsum(total["w1"], axis=0) - total["w1"]
            at = np.repeat(np.arange(len(starts)), np.diff([*starts, len(block)]))
            listed = lambda v: pa.array([v[i].tobytes() for i in at], pa.binary())
            return group.select(["fit", "block", "part", "chunk"]).append_column("behind", listed(later)).append_column(
                "here", listed(total["w1"])).append_column("dead", listed(total["dw1"]))

        made = self.rows.groupBy("fit", "block", "part").applyInArrow(
            sums, f"fit {self.kind}, block int, part int, parts int, chunk int, w1 binary, dw1 binary"
        )
        return made.groupBy("fit", "chunk").applyInArrow(
            behind, f"fit {self.kind}, block int, part int, chunk int, behind binary, here binary, dead binary"
        )

    def first_order(self, sets: DataFrame) -> dict:
        """Per fit: sum of logs, expected covariate sums, outer products over the times; the second order comes along."""
        coefs, shift, scale, p, top = self.beta, self.shift, self.scale, self.p, self.top
        steps = self.times.join(sets.select("fit", "t", "a1", "b1", "a2", "b2", "c2"), ["fit", "t"], "left")
        hazard = running(
            steps.na.fill(0.0, ["a1", "b1", "a2", "b2", "c2"]), ["fit"], "t",
            sums={"exposure": "a1"}, cuts=[-c for c in reversed(self.cuts)],
        ).select("fit", "t", "exposure", "b1", "a2", "b2", "c2")
        hazard = F.broadcast(hazard) if self.n_times <= BROADCAST_ROWS else hazard
        slab = max(1, SLAB_CELLS // p)

        def gram(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return empty
            left, right = left.sort_by("t").combine_chunks(), right.sort_by("chunk")
            k = left["fit"][0].as_py()
            vector = lambda c: np.concatenate([np.frombuffer(b) for b in right[c].to_pylist()])
            x = (_matrix(left["x"], p) - shift) / scale
            w = np.exp(np.maximum(x @ coefs[k] - top[k], LEAST))
            t, e, exposure, b1, a2, b2, c2 = (left[c].to_numpy() for c in ("t", "e", "exposure", "b1", "a2", "b2", "c2"))
            u = w * (exposure - e * b1)
            expected, info = u @ x, (x * u[:, None]).T @ x
            outer = np.zeros((p, p))
            starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            if left["parts"][0].as_py() > 1:  # one time in several parts: the first answers for its risk set
                at_risk, dead = (vector("behind") + vector("here"))[None], vector("dead")[None]
                starts = starts if left["part"][0].as_py() == 0 else starts[:0]
            else:
                weighted = x * w[:, None]
                at_risk = vector("behind") + np.cumsum(np.add.reduceat(weighted, starts, axis=0)[::-1], axis=0)[::-1]
                dead = np.add.reduceat(weighted * e[:, None], starts, axis=0)
            if len(starts):
                a, b, c = (v[starts][:, None] for v in (a2, b2, c2))
                cross = (at_risk * b).T @ dead
                outer = (at_risk * a).T @ at_risk - cross - cross.T + (dead * c).T @ dead
            cuts = range(0, p, slab)
            size = len(cuts)
            return pa.table({
                "fit": pa.array([k] * size, left["fit"].type), "block": pa.array([left["block"][0].as_py()] * size, pa.int32()),
                "slab": pa.array(range(size), pa.int32()),
                "expected": pa.array([expected[i : i + slab].tobytes() for i in cuts], pa.binary()),
                "info": pa.array([info[i : i + slab].tobytes() for i in cuts], pa.binary()),
                "outer": pa.array([outer[i : i + slab].tobytes() for i in cuts], pa.binary()),
            })

        def add(group: pa.Table) -> pa.Table:
            total = lambda c: sum(np.frombuffer(v.as_buffer()) for v in group[c]).tobytes()
            return pa.table({
                "fit": group["fit"].slice(0, 1), "block": group["block"].slice(0, 1), "slab": group["slab"].slice(0, 1),
                **{c: pa.array([total(c)], pa.binary()) for c in ("expected", "info", "outer")},
            })

        schema = f"fit {self.kind}, block int, slab int, expected binary, info binary, outer binary"
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        empty = pa.schema([
            ("fit", kinds[self.kind]), ("block", pa.int32()), ("slab", pa.int32()), *((c, pa.binary()) for c in ("expected", "info", "outer")),
        ]).empty_table()
        rows = self.rows.join(hazard, ["fit", "t"])
        behind = self._behind()
        sums = rows.groupBy("fit", "block", "part").cogroup(behind.toDF(*behind.columns).groupBy("fit", "block", "part")).applyInArrow(gram, schema)
        left = self.rows.select("block").distinct().count()
        while left > FAN_IN:  # sums of few blocks at a time, as a whole fit's would not fit into a task
            sums = sums.withColumn("block", F.expr(f"block div {FAN_IN}").cast("int")).groupBy("fit", "slab", "block").applyInArrow(add, schema)
            left = -(-left // FAN_IN)
        found: dict = {}
        for r in sums.groupBy("fit", "slab").applyInArrow(add, schema).collect():
            found.setdefault(r.fit, []).append((r.slab, *(np.frombuffer(bytes(b)) for b in (r.expected, r.info, r.outer))))
        logs = {r.fit: r.logs + r.d * self.top[r.fit] for r in sets.groupBy("fit").agg(F.sum("logs").alias("logs"), F.sum("d").alias("d")).collect()}
        out, self.second = {}, {}
        for k, slabs in found.items():
            slabs.sort(key=lambda s: s[0])
            expected, info, outer = (np.concatenate([s[i] for s in slabs]) for i in (1, 2, 3))
            out[k] = (logs.get(k, 0.0), expected, outer.reshape(p, p))
            self.second[k] = info.reshape(p, p)
        discard(sets)
        return out

    def second_order(self, sets: DataFrame, beta: dict) -> dict:
        return self.second


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    """Rows of an array column as a matrix; missing values are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def fit_cox(
    df: DataFrame,
    features: Sequence[str],
    fit_col: str | None = None,
    penalizer: float = fv.COX_SETTINGS["penalizer"],
    tolerance: float = 1e-6,
    max_steps: int = 25,
    only: dict | None = None,
) -> CoxModel:
    """Fit one model, or one per value of ``fit_col``; missing feature values raise.

    ``only`` names the features of fits that do not have them all; the others are constant there, with coefficient 0.
    """
    if only:
        without = {f: [k for k, own in only.items() if f not in set(own)] for f in features}
        df = df.withColumns({
            f: F.when(F.col(fit_col).isin(gone), 0.0).otherwise(quoted(f)) for f, gone in without.items() if gone
        })
    problem = (_WideProblem if len(features) > WIDE else _Problem)(df, features, fit_col)
    p, keys = problem.p, list(problem.n)
    # coefficients refer to the scaled columns until the end
    ridge = {k: penalizer * problem.n[k] * (problem.sd[k] / problem.scale) ** 2 for k in keys}
    beta = {k: np.zeros(p) for k in keys}
    step = {k: np.zeros(p) for k in keys}
    best = {k: -math.inf for k in keys}
    hessian = {k: np.eye(p) for k in keys}
    none = (0.0, np.zeros(p), np.zeros((p, p)))
    done: set = set()
    used = 0
    for used in range(1, max_steps + 1):
        sets = problem.risk_sets(beta).persist()
        firsts = problem.first_order(sets)
        worse = []
        for k in keys:
            logs, _, _ = firsts.get(k, none)
            value = float(problem.death_x[k] @ beta[k] - logs - 0.5 * np.sum(ridge[k] * beta[k] ** 2))
            if k not in done and (not math.isfinite(value) or value < best[k] - 1e-9 * abs(best[k])):
                worse.append(k)
            else:
                best[k] = value
        if worse:
            sets.unpersist()
            for k in worse:
                step[k] = step[k] / 2
                beta[k] = beta[k] - step[k]
            continue
        seconds = problem.second_order(sets, beta)
        sets.unpersist()
        for k in keys:
            _, expected, outer = firsts.get(k, none)
            gradient = problem.death_x[k] - expected - ridge[k] * beta[k]
            information = seconds.get(k, np.zeros((p, p))) - outer + np.diag(ridge[k])
            flat = (problem.sd[k] <= 0) | (np.diag(information) <= 0)  # constant column: no information, coefficient 0
            information[flat, :] = information[:, flat] = 0.0
            information[flat, flat] = 1.0
            gradient[flat] = 0.0
            hessian[k] = information
            if k in done:
                continue
            step[k] = np.linalg.solve(information, gradient)
            beta[k] = beta[k] + step[k]
            if np.max(np.abs(step[k])) < tolerance:
                done.add(k)
        if len(done) == len(keys):
            break
    else:
        raise RuntimeError(f"Cox fit did not converge in {max_steps} steps")
    public = {k: (k if fit_col else None) for k in keys}
    return CoxModel(
        list(features),
        {public[k]: beta[k] / problem.scale for k in keys},
        {public[k]: np.sqrt(np.diag(np.linalg.inv(hessian[k]))) / problem.scale for k in keys},
        {public[k]: problem.mean[k] for k in keys},
        {public[k]: best[k] for k in keys},
        used,
    )


def score_at_zero(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Gradient of the Efron partial likelihood at zero coefficients, original scale."""
    problem = _Problem(df, features, None)
    sets = problem.risk_sets({0: np.zeros(problem.p)})
    _, expected, _ = problem.first_order(sets)[0]
    gradient = (problem.death_x[0] - expected) * problem.scale
    return df.sparkSession.createDataFrame(
        [(f, float(g)) for f, g in zip(features, gradient)], "feature string, gradient double"
    )


def hazard_ratios(table: DataFrame, top: int = 20) -> DataFrame:
    """Largest effects first, with display name and direction of the effect."""
    size = F.abs("coef")
    return (
        table.orderBy(size.desc(), "feature")
        .limit(top)
        .select(
            "feature",
            sc.readable_feature(F.col("feature")).alias("label"),
            "coef", "hazard_ratio", "se",
            F.exp("coef_lower").alias("hr_lower"), F.exp("coef_upper").alias("hr_upper"),
            "z", "p",
            sc.effect_label(F.col("hazard_ratio")).alias("effect"),
        )
    )
