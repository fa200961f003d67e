"""Record consolidation and column alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quoted


def consolidate(
    left: DataFrame, right: DataFrame, key: str, null_keys_match: bool = True
) -> DataFrame:
    """Inner many-to-many join on one key; shared other columns get ``_x`` / ``_y``.

    No broadcast hint: Spark's own size threshold picks the strategy, and a hot case is
    split by the adaptive skew join.
    """
    if key not in left.columns or key not in right.columns:
        raise ValueError(f"join key {key!r} is missing from one of the tables")
    shared = (set(left.columns) & set(right.columns)) - {key}
    a = left.select([quoted(c).alias(f"{c}_x" if c in shared else c) for c in left.columns])
    b = right.select(
        [quoted(c).alias(f"{c}_y" if c in shared else c) for c in right.columns if c != key]
        + [quoted(key).alias("__right_key")]
    )
    match = (
        quoted(key).eqNullSafe(F.col("__right_key"))
        if null_keys_match
        else quoted(key) == F.col("__right_key")
    )
    return a.join(b, match, "inner").drop("__right_key")


def align_columns(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the wanted columns in order: missing ones are 0, others go (``keep`` stays)."""
    have = set(df.columns)
    return df.select(
        *[quoted(c) for c in keep],
        *[(quoted(c) if c in have else F.lit(0.0)).cast("double").alias(c) for c in wanted],
    )
