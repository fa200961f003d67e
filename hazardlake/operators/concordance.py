"""Exact concordance index for right-censored times, without pairing rows.

A pair (i, j) is comparable when i had the event and j was still under observation:
``t_i < t_j``, or equal times with j censored. With the rank ``r = 2 * rank(time) +
censored`` that is simply "i is an event and r_i < r_j".

Rows are collapsed to (rank, risk) counts once. The risk axis is cut into ranges and the time axis into blocks, and every
comparable pair is counted in exactly one place: pairs of different ranges and blocks from the sums per (range, block),
pairs of one range but different blocks in a task per range, of one block but different ranges in a task per block, and
the rest in a task per (range, block). A task sees rows summed up to what it tells apart, so that one risk or one time of
any number of rows stays small.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .prefix import cut_points, running, with_bucket

RISK_DECIMALS = 8
#: Two numbers a row, about 16 MB at most.
BROADCAST_TIMES = 500_000
#: Counts of all groups in a range of the risk or a block of time, and by how much that grows with several groups.
ROWS_PER_PART = 500_000
MOST_GROUPS = 4


def _checked(risk: Column) -> Column:
    bad = risk.isNull() | F.isnan(risk)
    return F.when(bad, F.raise_error(F.lit("risk score is missing"))).otherwise(risk)


def dominance(rank: np.ndarray, risk: np.ndarray, e: np.ndarray, m: np.ndarray) -> tuple[float, float, float]:
    """(comparable, concordant, tied) pairs: events before rows of greater rank, at a greater and at an equal risk.

    Two ranks differ first at one bit, so a pair is counted at that bit, by running sums over the falling risk.
    """
    _, rank = np.unique(rank, return_inverse=True)
    order = np.lexsort((rank, -risk))
    rank, risk, e, m = rank[order], risk[order], e[order].astype(float), m[order].astype(float)
    level = np.cumsum(np.concatenate(([False], risk[1:] != risk[:-1])))
    events = np.concatenate(([0.0], np.cumsum(np.bincount(rank, weights=e))))
    comparable = float((m * events[rank]).sum())
    concordant = tied = 0.0
    for bit in range(int(rank.max()).bit_length() if len(rank) else 0):
        # rows of one prefix side by side, each prefix in order of risk
        place = np.argsort(rank >> (bit + 1), kind="stable")
        prefix, tie = rank[place] >> (bit + 1), level[place]
        upper = (rank[place] >> bit) & 1
        early, late = np.where(upper == 0, e[place], 0.0), np.where(upper == 1, m[place], 0.0)
        fresh = np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (tie[1:] != tie[:-1])))
        first = np.flatnonzero(fresh)
        early, late, prefix = np.add.reduceat(early, first), np.add.reduceat(late, first), prefix[first]
        before = np.cumsum(early) - early
        opens = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        before -= np.repeat(before[opens], np.diff(np.append(opens, len(prefix))))
        concordant += float((late * before).sum())
        tied += float((late * early).sum())
    return comparable, concordant, tied


_PAIRS = "comparable double, concordant double, tied_risk double"


def _counted(rows: DataFrame, by: Sequence[str], rank: str, risk: str, apart: bool = False) -> DataFrame:
    """Pairs among the rows of every group, by their ``rank`` and ``risk``; a task per group. ``apart`` leaves out those of equal risk."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(group: pa.Table) -> pa.Table:
        comparable, concordant, tied = dominance(*(group[c].to_numpy() for c in (rank, risk, "e", "m")))
        found = (comparable - tied, concordant, 0.0) if apart else (comparable, concordant, tied)
        counts = {n: pa.array([v]) for n, v in zip(("comparable", "concordant", "tied_risk"), found)}
        return pa.table({**{c: group[c].slice(0, 1) for c in by}, **counts})

    return rows.select(*by, rank, risk, "e", "m").groupBy(*by).applyInArrow(run, f"{kinds}, {_PAIRS}")


def pair_counts(
    df: DataFrame,
    by: Sequence[str] = (),
    time: str = "observed_time",
    event: str = "event_occurred",
    risk: str = "risk",
    risk_cuts: Sequence[float] | None = None,
    time_cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Comparable, concordant and risk-tied pairs per group.

    Risks are compared after rounding to 1e-8. ``risk_cuts`` / ``time_cuts`` bucket the
    windows over distinct risks / times; ``None`` measures them first. Pair counts
    are DOUBLE: they pass 2**63 long before the rows do.
    """
    by = list(by)
    collapsed = df.groupBy(
        *by,
        F.col(time).alias("__t"),
        F.round(_checked(F.col(risk).cast("double")), RISK_DECIMALS).alias("__risk"),
    ).agg(
        F.sum(F.col(event).cast("int")).alias("__e"), F.count(F.lit(1)).alias("__m")
    )
    # read three times below (cut points, ranks, pairs), so written once
    collapsed = materialize(collapsed, "concordance")
    sizes = [r["count"] for r in collapsed.groupBy(*by).count().orderBy(F.desc("count")).limit(MOST_GROUPS).collect()]
    size = ROWS_PER_PART * max(1, sum(sizes) // max(1, *sizes, 1))
    if risk_cuts is None:
        risk_cuts = cut_points(collapsed, "__risk", size)

    # dense rank of the distinct times over all groups: ranks only have to keep the order
    times = materialize(collapsed.groupBy("__t").agg(F.lit(1).alias("__one"), F.count(F.lit(1)).alias("__rows")), "times")
    if time_cuts is None:
        time_cuts = cut_points(times, "__t")
    ranks = running(times, [], "__t", sums={"__rank": "__one", "__seen": "__rows"}, cuts=time_cuts)
    # a block ends where enough rows have been seen; a time of many rows is alone or ends its block
    block = F.expr(f"cast((__seen - __rows) div {size} as int)").alias("__block")
    ranks = materialize(ranks.select("__t", "__rank", block), "ranks")
    n_times = ranks.count()
    ranked = collapsed.join(F.broadcast(ranks) if n_times <= BROADCAST_TIMES else ranks, "__t")
    ranked = with_bucket(ranked, "__risk", risk_cuts, "__range")

    # events and censored rows of a time have ranks of their own
    side = F.explode(F.array(
        F.struct((2 * F.col("__rank")).alias("r"), F.col("__e").alias("e"), F.col("__e").alias("m")),
        F.struct((2 * F.col("__rank") + 1).alias("r"), F.lit(0).cast("bigint").alias("e"),
                 (F.col("__m") - F.col("__e")).alias("m")),
    )).alias("s")
    groups = [f"__g{k}" for k in range(len(by))] or ["__all"]
    keys = [F.col(c).alias(g) for c, g in zip(by, groups)] or [F.lit(0).alias("__all")]
    sides = ranked.select(*keys, "__risk", "__block", "__range", side).select(*groups, "__risk", "__block", "__range", "s.*").filter("m > 0")

    def summed(*names: str) -> DataFrame:
        return sides.groupBy(*groups, *names).agg(F.sum("e").alias("e"), F.sum("m").alias("m"))

    blocks, ranges = ranks.agg(F.max("__block")).first()[0], bool(risk_cuts)
    parts = [_counted(sides, [*groups, "__range", "__block"], "r", "__risk")]
    if blocks:
        parts.append(_counted(summed("__range", "__risk", "__block"), [*groups, "__range"], "__block", "__risk"))
    if ranges:
        parts.append(_counted(summed("__block", "__range", "r"), [*groups, "__block"], "r", "__range", True))
    if blocks and ranges:
        # ranges x blocks are few
        parts.append(_counted(summed("__range", "__block"), groups, "__block", "__range", True))
    names = ["comparable", "concordant", "tied_risk"]
    counted = reduce(DataFrame.unionByName, (p.select(*groups, *names) for p in parts))
    total = [F.sum(c).alias(c) for c in names]
    if not by:
        return counted.agg(*total)
    return counted.groupBy(*groups).agg(*total).select(*[F.col(g).alias(c) for c, g in zip(by, groups)], *names)


def concordance(
    df: DataFrame,
    by: Sequence[str] = (),
    time: str = "observed_time",
    event: str = "event_occurred",
    risk: str = "risk",
    risk_cuts: Sequence[float] | None = None,
    time_cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Concordance index per group; NULL without a comparable pair."""
    pairs = pair_counts(df, by, time, event, risk, risk_cuts, time_cuts)
    return pairs.select(
        *by, "comparable", "concordant", "tied_risk",
        F.try_divide(F.col("concordant") + F.col("tied_risk") / 2, F.col("comparable")).alias("c_index"),
    )
