"""Exact row numbers of whole tables without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quoted
from ..session import discard, materialize

#: Totals a partition and group may be broadcast up to this many rows.
BROADCAST_TOTALS = 200_000


def numbered(table: DataFrame, order: Sequence[Column], group: str | None = None) -> DataFrame:
    """``table`` with ``place`` (from 0, in ``order`` within ``group``) and ``of``, the size of the group.

    Rows are dealt to partitions by ranges of (group, order, row) and numbered where they lie; the
    counts of earlier partitions are added. The row itself, by its place in a written table, ends
    every tie, so a group of equal rows is cut like any other and the numbers stay the same when a
    task is repeated. ``group`` must not hold nulls. A column called place or of is replaced.
    """
    table = table.drop("place", "of")
    keys = [group] if group else []
    written = materialize(table.withColumn("__row", F.monotonically_increasing_id()), "rows")
    by = [*(F.col(k).asc() for k in keys), *order, F.col("__row").asc()]
    # After the sort this id is (partition, number within it).
    ranged = written.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged.drop("__row").withColumn("__part", F.shiftright("__at", 33)), "ranged")
    discard(written)
    totals = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    # One row a partition in each window, or fewer.
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = materialize(totals.select(
        *keys, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__add"),
        F.sum("__n").over(whole).alias("of"),
    ), "totals")
    small = F.broadcast(totals) if totals.count() <= BROADCAST_TOTALS else totals
    placed = ranged.join(small, [*keys, "__part"])
    return placed.select(*map(quoted, table.columns), (F.col("__at") + F.col("__add")).alias("place"), "of")
