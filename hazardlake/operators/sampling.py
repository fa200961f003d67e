"""Hold-outs, folds, subsets and permutations that depend on row ids only.

Global ranks by hash never use one global window: the 32-bit hash is cut into equal ranges,
as many as the row count asks for, the range counts are prefix-summed, and rows are ranked
inside their range. md5 spreads ids evenly, so ranges are even whatever the data looks like.
A NULL group is a group like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import hash32, quoted
from .prefix import same

ROWS_PER_RANGE = 100_000


def _range_bits(df: DataFrame) -> int:
    """Bits of the hash that number the ranges, for ``ROWS_PER_RANGE`` rows in each."""
    return min(32, max(0, math.ceil(math.log2(max(1, df.count()) / ROWS_PER_RANGE))))


def _with_hash(df: DataFrame, row_id: str, seed: int | str | Column, bits: int) -> DataFrame:
    h = hash32(seed, F.col(row_id))
    return df.withColumn("__h", h).withColumn("__range", F.shiftright("__h", 32 - bits))


def _range_offsets(hashed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, range) -> rows before the range, rows in it, rows in all."""
    counts = hashed.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__in"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *by,
        "__range",
        "__in",
        F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__before"),
        F.sum("__in").over(Window.partitionBy(*by)).alias("__all"),
    )


def hash_rank(
    df: DataFrame, row_id: str, seed: int | str | Column, out: str = "rank", by: Sequence[str] = ()
) -> DataFrame:
    """Dense position 1..n by (hash, id), per group."""
    by = list(by)
    hashed = _with_hash(df, row_id, seed, _range_bits(df))
    offsets = _range_offsets(hashed, by)
    inside = Window.partitionBy(*by, "__range").orderBy("__h", row_id)
    return (
        same(hashed.withColumn("__pos", F.row_number().over(inside)), offsets, [*by, "__range"])
        .withColumn(out, F.col("__before") + F.col("__pos"))
        .select(*[quoted(c) for c in df.columns], out)
    )


def _smallest(df: DataFrame, row_id: str, seed: int, wanted: Column, by: Sequence[str], out: str) -> DataFrame:
    """Flag the ``wanted`` smallest rows by (hash, id) per group (``wanted`` may use ``__all``).

    Only the one hash range per group that holds the threshold is sorted; every other row
    is decided by its range alone. The joined table has one row per group (stratum).
    """
    by = list(by) or ["__g"]
    bits = _range_bits(df)
    hashed = _with_hash(df.withColumn("__g", F.lit(0)), row_id, seed, bits)
    offsets = _range_offsets(hashed, by).withColumn("__want", wanted)
    straddles = (F.col("__before") < F.col("__want")) & (F.col("__before") + F.col("__in") > F.col("__want"))
    edges = offsets.groupBy(*by).agg(
        # ranges below this one are in; the straddling one (if any) is ranked
        F.coalesce(
            F.min(F.when(F.col("__before") + F.col("__in") > F.col("__want"), F.col("__range"))),
            F.lit(1 << bits),
        ).alias("__edge"),
        F.max(F.when(straddles, F.col("__want") - F.col("__before"))).alias("__short"),
    )
    placed = same(hashed, edges, by)
    on_edge = (F.col("__range") == F.col("__edge")) & F.col("__short").isNotNull()
    clear = placed.filter(~on_edge).withColumn(out, F.col("__range") < F.col("__edge"))
    inside = Window.partitionBy(*by, "__range").orderBy("__h", row_id)
    cut = (
        placed.filter(on_edge)
        .withColumn("__pos", F.row_number().over(inside))
        .withColumn(out, F.col("__pos") <= F.col("__short"))
    )
    columns = [quoted(c) for c in df.columns] + [F.col(out)]
    return clear.select(*columns).unionByName(cut.select(*columns))


def stratified_holdout(
    df: DataFrame,
    stratum: str = "event_occurred",
    test_share: float = 0.2,
    seed: int = fv.SEED,
    row_id: str = "row_id",
    group_col: str | None = None,
) -> DataFrame:
    """Exact-size hold-out per stratum, as a ``split`` column of ``train`` / ``test``.

    With ``group_col`` all rows of a group fall on the same side (share then holds in
    expectation), so that copies of one case cannot be on both sides.
    """
    if group_col:
        h = hash32(seed, F.col(group_col))
        side = F.when(h < int(test_share * 2**32), F.lit("test")).otherwise(F.lit("train"))
        return df.withColumn("split", side)
    wanted = F.round(F.col("__all") * test_share)
    flagged = _smallest(df, row_id, seed, wanted, [stratum], "__test")
    side = F.when(F.col("__test"), F.lit("test")).otherwise(F.lit("train"))
    return flagged.withColumn("split", side).drop("__test")


def assign_folds(
    df: DataFrame, folds: int = 5, seed: int = fv.SEED, row_id: str = "row_id", group_col: str | None = None
) -> DataFrame:
    """Fold number per row (or per group) by hash; narrow."""
    h = hash32(seed, F.col(group_col or row_id))
    return df.withColumn("fold", F.pmod(h, F.lit(folds)).cast("int"))


def subset(df: DataFrame, share: float, seed: int = fv.SEED, row_id: str = "row_id") -> DataFrame:
    """Exactly ``int(n * share)`` rows without replacement; smaller subsets nest in larger ones."""
    wanted = F.floor(F.col("__all") * F.lit(share))
    return _smallest(df, row_id, seed, wanted, [], "__in_subset").filter("__in_subset").drop("__in_subset")


def permute(
    df: DataFrame, columns: Sequence[str], seed: int | str, row_id: str = "row_id", suffix: str = "",
    by: Sequence[str] = (),
) -> DataFrame:
    """Shuffle ``columns`` (together) over the rows, separately in each ``by`` group.

    The row at position k of one hash order receives the values at position k of another;
    an equi-join on the position, evenly spread by construction. With ``suffix`` the
    shuffled values come next to the original columns.
    """
    by = list(by)

    def order(role: str) -> Column:
        return F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.lit(role))

    donors = hash_rank(df.select(*by, row_id, *map(quoted, columns)), row_id, order("donor"), "__k", by).select(
        *by, "__k", *[quoted(c).alias(f"__d_{c}") for c in columns]
    )
    takers = hash_rank(df, row_id, order("taker"), "__k", by)
    joined = same(takers, donors, [*by, "__k"])
    keep = [quoted(c) for c in df.columns if suffix or c not in columns]
    return joined.select(*keep, *[quoted(f"__d_{c}").alias(f"{c}{suffix}") for c in columns])
