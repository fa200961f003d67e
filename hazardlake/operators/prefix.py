"""Ordered prefix aggregates that never put an unbounded group into one task.

A plain running window sends a whole group to one task. The functions here take a list
of cut points on the order column: rows are bucketed between the cuts, each
(group, bucket) runs its own small window, and a second window over the bucket totals
(at most one row per bucket and group) supplies the offsets. Without cuts the plain
window is used, which is right when the order column is bounded (day counts).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quoted

ROWS_PER_BUCKET = 500_000
_BUCKET = "__bucket"


def cut_points(df: DataFrame, order: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Cut points on ``order`` so that no bucket holds much more than ``rows_per_bucket`` rows.

    A count decides first; only a large table pays for the quantile sketch. The number of
    cut points, which the driver receives, is the row count over ``rows_per_bucket``. An
    empty list means one window is enough.
    """
    n = df.count()
    if n <= rows_per_bucket:
        return []
    buckets = math.ceil(n / rows_per_bucket)
    probs = [i / buckets for i in range(1, buckets)]
    numbers = df.select(F.col(order).cast("double").alias("__order"))
    return sorted(set(numbers.approxQuantile("__order", probs, 0.25 / buckets)))


def with_bucket(df: DataFrame, order: str, cuts: Sequence[float], out: str = _BUCKET) -> DataFrame:
    """Bucket number by binary search over the cut points.

    NULL comes before all numbers and NaN after them, as in a plain ascending window.
    """
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    as_double = df.withColumn("__order", F.col(order).cast("double"))
    bucketizer = Bucketizer(splits=splits, inputCol="__order", outputCol=out, handleInvalid="keep")
    number = F.when(F.col("__order").isNull(), -1).otherwise(F.col(out)).cast("int")
    return bucketizer.transform(as_double).withColumn(out, number).drop("__order")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the key columns are the left ones."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & quoted(k).eqNullSafe(quoted(f"__right_{k}"))
    return left.join(renamed, match, how).drop(*[f"__right_{k}" for k in keys])


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, str] | None = None,
    products: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    cuts: Sequence[float] = (),
) -> DataFrame:
    """Add inclusive running sums and products, and group totals.

    ``df`` has one row per (``by``, ``order``). Each mapping is output name -> input
    column.
    """
    by = list(by)
    sums, products, totals = dict(sums or {}), dict(products or {}), dict(totals or {})
    if not cuts:
        up_to = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        return df.withColumns(
            {o: F.sum(c).over(up_to) for o, c in sums.items()}
            | {o: F.product(F.col(c)).over(up_to) for o, c in products.items()}
            | {o: F.sum(c).over(whole) for o, c in totals.items()}
        )

    bucketed = with_bucket(df, order, cuts)
    per_bucket = bucketed.groupBy(*by, _BUCKET).agg(
        *[F.sum(c).alias(f"__s_{o}") for o, c in sums.items()],
        *[F.product(F.col(c)).alias(f"__p_{o}") for o, c in products.items()],
        *[F.sum(c).alias(f"__t_{o}") for o, c in totals.items()],
    )
    before = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by,
        _BUCKET,
        *[F.coalesce(F.sum(f"__s_{o}").over(before), F.lit(0)).alias(f"__s_{o}") for o in sums],
        *[F.coalesce(F.product(F.col(f"__p_{o}")).over(before), F.lit(1.0)).alias(f"__p_{o}")
          for o in products],
        *[F.sum(f"__t_{o}").over(whole).alias(f"__t_{o}") for o in totals],
    )
    inside = (
        Window.partitionBy(*by, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = bucketed.withColumns(
        {f"__l_{o}": F.sum(c).over(inside) for o, c in sums.items()}
        | {f"__l_{o}": F.product(F.col(c)).over(inside) for o, c in products.items()}
    )
    joined = same(local, offsets, [*by, _BUCKET])
    return joined.select(
        *df.columns,
        *[(F.col(f"__l_{o}") + F.col(f"__s_{o}")).alias(o) for o in sums],
        *[(F.col(f"__l_{o}") * F.col(f"__p_{o}")).alias(o) for o in products],
        *[F.col(f"__t_{o}").alias(o) for o in totals],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
    plotting: float | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per probability.

    The default interpolates at position ``(n - 1) p``; with ``plotting`` = a the
    plotting-position rule ``n p + a + p (1 - 2 a) - 1``, kept inside the data.

    Values are reduced to (group, value, count) and located through running counts, so a
    group of any size is spread over the buckets of its values; the built-in exact
    percentile would hold all distinct values of a group in one buffer.
    """
    by = list(by)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__m"))
    )
    if cuts is None:
        cuts = cut_points(counted, "__v")
    ranked = running(counted, by, "__v", sums={"__hi": "__m"}, totals={"__n": "__m"}, cuts=cuts)
    low = F.col("__hi") - F.col("__m")
    picks = []
    for name, p in probs.items():
        position = (F.col("__n") - 1) * F.lit(float(p))
        if plotting is not None:
            spot = F.col("__n") * float(p) + (plotting + p * (1 - 2 * plotting) - 1)
            position = F.least(F.greatest(spot, F.lit(0.0)), (F.col("__n") - 1).cast("double"))
        base = F.floor(position)
        above = F.least(base + 1, F.col("__n") - 1)
        covers = lambda k: (k >= low) & (k < F.col("__hi"))
        picks += [
            F.max(F.when(covers(base), F.col("__v"))).alias(f"__a_{name}"),
            F.max(F.when(covers(above), F.col("__v"))).alias(f"__b_{name}"),
            F.max(position - base).alias(f"__f_{name}"),
        ]
    found = ranked.groupBy(*by).agg(*picks)
    return found.select(
        *by,
        *[
            (F.col(f"__a_{n}") + (F.col(f"__b_{n}") - F.col(f"__a_{n}")) * F.col(f"__f_{n}")).alias(n)
            for n in probs
        ],
    )


def next_value(
    df: DataFrame, by: Sequence[str], value: str, out: str, cuts: Sequence[float] = ()
) -> DataFrame:
    """Next greater value of the same group, for rows unique per (``by``, ``value``)."""
    by = list(by)
    if not cuts:
        return df.withColumn(out, F.lead(value).over(Window.partitionBy(*by).orderBy(value)))
    bucketed = with_bucket(df, value, cuts)
    inside = Window.partitionBy(*by, _BUCKET).orderBy(value)
    local = bucketed.withColumn("__next", F.lead(value).over(inside))
    firsts = bucketed.groupBy(*by, _BUCKET).agg(F.min(value).alias("__first"))
    following = firsts.withColumn(
        "__following", F.lead("__first").over(Window.partitionBy(*by).orderBy(_BUCKET))
    ).drop("__first")
    joined = same(local, following, [*by, _BUCKET])
    return joined.select(*df.columns, F.coalesce("__next", "__following").alias(out))


def time_blocks(rows: DataFrame, time: str, block_rows: int, n: int | None = None) -> DataFrame:
    """``rows`` (fit, key, time, ...) with the ``block`` of their time, ascending, and ``part`` and ``parts`` of a block of a single time.

    Blocks hold about ``block_rows`` rows of ``n``, of all rows by default. A time that has more is a block of its own, dealt
    into parts by ``key``.
    """
    n = rows.count() if n is None else n
    count = max(1, n // block_rows)
    shares = [i / count for i in range(1, count)]
    points = rows.select(F.col(time).cast("double").alias("t")).approxQuantile("t", shares, 0.25 / count) if shares else []
    cuts = sorted({c for p in set(points) for c in ([p, math.nextafter(p, math.inf)] if points.count(p) > 1 else [p])})
    blocked = with_bucket(rows, time, cuts, "block")
    sizes = blocked.groupBy("fit", "block").agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("a"), F.max(time).alias("b"))
    parts = F.when(F.col("a") == F.col("b"), F.ceil(F.col("rows") / block_rows)).otherwise(1).cast("int").alias("parts")
    # one row per fit and block, so a small share of the rows
    return blocked.join(F.broadcast(sizes.select("fit", "block", parts)), ["fit", "block"]).withColumn(
        "part", F.pmod("key", F.col("parts")).cast("int")
    )
