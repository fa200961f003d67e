"""Permutation importance, partial dependence and individual curves for any scorer.

A scorer is a function ``(df, replace) -> df`` that adds a ``risk`` column, taking the
features named in ``replace`` from the given other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import hash32, quoted
from ..session import materialize
from .concordance import concordance
from .encoding import EVENT, TIME
from .prefix import exact_quantiles
from .sampling import permute

Scorer = Callable[[DataFrame, dict], DataFrame]


def permutation_scores(
    df: DataFrame, score: Scorer, features: Sequence[str], repeats: int = 10,
    seed: int = fv.SEED, row_id: str = "row_id",
) -> DataFrame:
    """Concordance per (feature, repeat) with that feature shuffled; feature NULL is unshuffled.

    One shuffle of whole rows per repeat serves all features: each feature in turn takes
    its value from the donor row. All index values come from one grouped count.
    """
    base = df.select(row_id, EVENT, TIME, *map(quoted, features))
    repeated = base.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    shuffled = materialize(permute(repeated, features, seed, row_id, "__shuffled", ["repeat"]), "shuffled")
    parts = [
        score(shuffled, {f: f"{f}__shuffled"}).select("repeat", F.lit(f).alias("feature"), EVENT, TIME, "risk")
        for f in features
    ]
    parts.append(score(base, {}).select(
        F.lit(0).alias("repeat"), F.lit(None).cast("string").alias("feature"), EVENT, TIME, "risk"
    ))
    scored = reduce(DataFrame.unionByName, parts).withColumn("feature", F.coalesce("feature", F.lit("")))
    return concordance(scored, ["feature", "repeat"]).select(
        F.nullif("feature", F.lit("")).alias("feature"), "repeat", "c_index"
    )


def permutation_importance(
    df: DataFrame, score: Scorer, features: Sequence[str], repeats: int = 10,
    seed: int = fv.SEED, row_id: str = "row_id", top: int = 20,
) -> DataFrame:
    """Mean and population deviation of the loss in concordance, largest first."""
    scores = materialize(permutation_scores(df, score, features, repeats, seed, row_id), "scores")
    real = scores.filter("feature is null").select(F.max("c_index")).scalar()
    return (
        scores.filter("feature is not null")
        .withColumn("loss", real - F.col("c_index"))
        .groupBy("feature")
        .agg(F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std"))
        .orderBy(F.desc("importance_mean"), "feature")
        .limit(top)
    )


def grid_of(df: DataFrame, feature: str, points: int = 100, low: float = 0.05, high: float = 0.95) -> list[float]:
    """All values when they are fewer than ``points``, else an even grid between the two percentiles."""
    values = df.select(quoted(feature).cast("double").alias("v")).filter("v is not null")
    distinct = sorted(r.v for r in values.distinct().limit(points).collect())
    if len(distinct) < points:
        return distinct
    lo, hi = exact_quantiles(values, "v", {"lo": low, "hi": high}, plotting=0.4).first()
    return [lo + (hi - lo) * i / (points - 1) for i in range(points)]


def partial_dependence(
    df: DataFrame, score: Scorer, features: Sequence[str], varied: Sequence[str],
    points: int = 100, grids: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Mean prediction over all rows per (feature, grid value).

    Rows are first collapsed over the *other* features: a row's own value of the varied
    feature does not matter, so few distinct rows are left to expand over the grid.
    """
    parts = []
    for f in varied:
        grid = (grids or {}).get(f) or grid_of(df, f, points)
        others = [quoted(c) for c in features if c != f]
        cells = materialize(df.groupBy(*others).agg(F.count(F.lit(1)).alias("__m")), "pdp")
        spread = cells.withColumn(f, F.explode(F.lit(grid)))
        parts.append(score(spread, {}).groupBy(quoted(f).alias("value")).agg(
            (F.sum(F.col("__m") * F.col("risk")) / F.sum("__m")).alias("mean_prediction")
        ).select(F.lit(f).alias("feature"), "value", "mean_prediction"))
    return reduce(DataFrame.unionByName, parts)


def individual_curves(
    df: DataFrame, score: Scorer, features: Sequence[str], varied: Sequence[str], rows: int = 100,
    points: int = 100, seed: int = fv.SEED, row_id: str = "row_id", grids: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Prediction per sampled row and grid value; the sample is the feature (``rows`` curves)."""
    sample = df.orderBy(hash32(seed, F.col(row_id)), row_id).limit(rows).select(row_id, *map(quoted, features))
    sample = materialize(sample, "ice")
    parts = []
    for f in varied:
        grid = (grids or {}).get(f) or grid_of(df, f, points)
        spread = sample.withColumn(f, F.explode(F.lit(grid)))
        parts.append(score(spread, {}).select(
            row_id, F.lit(f).alias("feature"), quoted(f).alias("value"), F.col("risk").alias("prediction")
        ))
    return reduce(DataFrame.unionByName, parts)


def top_features(importance: DataFrame, k: int = 3) -> list[str]:
    """Names of the first k features of an importance table."""
    score = "importance_mean" if "importance_mean" in importance.columns else "importance"
    return [r.feature for r in importance.orderBy(F.desc(score), "feature").limit(k).collect()]
