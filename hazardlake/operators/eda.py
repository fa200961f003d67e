"""Exploratory aggregates, each ready to chart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import scalars as sc
from .cleaning import AGE, SITE, STAGE
from .prefix import exact_quantiles, same




def counts_descending(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; NULL is not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def counts_by_stage(df: DataFrame) -> DataFrame:
    return counts_descending(df.withColumn(STAGE, sc.replace_value(F.col(STAGE))), STAGE)


def counts_by_site(df: DataFrame, labels: Mapping[str, str] = fv.SITE_LABELS) -> DataFrame:
    return counts_descending(df.withColumn("localizacao", sc.recode(F.col(SITE), labels)), "localizacao")


def counts_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def mortality_by_age_band(df: DataFrame) -> DataFrame:
    """Rows, events and event rate per observed age band; rows outside the bands are left out."""
    names = sc.band_names()
    banded = df.withColumn("age_group", sc.band(F.col(AGE))).filter(F.col("age_group").isNotNull())
    stats = banded.groupBy("age_group").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("event_occurred").cast("bigint")).alias("deaths"),
    )
    order = sc.recode(F.col("age_group"), {n: i for i, n in enumerate(names)})
    return stats.select(
        order.alias("band_order"),
        sc.recode(F.col("age_group"), fv.AGE_BAND_LABELS, keep_unmapped=True).alias("band"),
        "total",
        "deaths",
        (F.col("deaths") / F.col("total") * 100).alias("death_rate_pct"),
    ).orderBy("band_order")


def status_share(df: DataFrame) -> DataFrame:
    """Count and percent of both event classes, a missing class counted as 0."""
    one = df.agg(*[F.count_if(F.col("event_occurred") == k).alias(f"n{k}") for k in fv.STATUS_LABELS])
    total = F.col("n0") + F.col("n1")
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("event_occurred"),
            F.lit(label).alias("status"),
            F.col(f"n{k}").alias("n"),
            (F.try_divide(F.col(f"n{k}").cast("double"), total) * 100).alias("pct"),
        )
        for k, label in fv.STATUS_LABELS.items()
    ])
    return one.select(F.inline(rows))


def _binned(df: DataFrame, column: str, bins: int, by: Sequence[str]) -> DataFrame:
    """(by, bin) -> n and value sum, with the bin edges of the group; empty bins absent."""
    by = list(by)
    values = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("__x"))
    if by:
        ranges = values.groupBy(*by).agg(F.min("__x").alias("__min"), F.max("__x").alias("__max"))
        values = same(values, ranges, by)
        lo, hi = F.col("__min"), F.col("__max")
    else:
        lo = values.select(F.min("__x")).scalar()
        hi = values.select(F.max("__x")).scalar()
    values = values.withColumns({"__lo": lo, "__hi": hi})
    flat = F.col("__lo") == F.col("__hi")
    values = values.withColumns({
        "__lo": F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")),
        "__hi": F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")),
    })
    width = (F.col("__hi") - F.col("__lo")) / bins
    slot = F.least(F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(bins - 1)).cast("int")
    return values.groupBy(*by, slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("__x").alias("value_sum"),
        F.sum(F.col("__x") * F.col("__x")).alias("square_sum"),
        F.first("__lo").alias("lo"),
        F.first("__hi").alias("hi"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over each group's own range, zero-filled.

    The last bin is closed on the right; a constant column is widened by 0.5 each way.
    """
    by = list(by)
    per_bin = _binned(df, column, bins, by)
    group = per_bin.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"),
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
    ).filter(F.size("counts") > 0)
    filled = group.select(*by, "counts", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return filled.select(
        *by,
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("bin_lo"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_hi"),
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).cast("bigint").alias("n"),
    )


def density(df: DataFrame, column: str, grid: int = 200, fine_bins: int = 4096) -> DataFrame:
    """Gaussian kernel density on an even grid over the data range, Scott's bandwidth.

    The kernel runs over at most ``fine_bins`` bin means instead of rows, so the work
    after one aggregation is ``grid * fine_bins`` whatever the table size. Bin means
    leave an error of second order in the bin width, far below the bandwidth.
    """
    fine = _binned(df, column, fine_bins, ())
    whole = Window.partitionBy()
    n, s1, s2 = (F.sum(c).over(whole) for c in ("n", "value_sum", "square_sum"))
    fine = fine.withColumns({"total": n, "s1": s1, "s2": s2})
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")) / (F.col("total") - 1)
    fine = fine.withColumns({
        "center": F.col("value_sum") / F.col("n"),
        "bandwidth": F.sqrt(variance) * F.pow(F.col("total").cast("double"), F.lit(-0.2)),
    })
    spread = fine.select(
        "n", "center", "bandwidth", "total", "lo", "hi",
        F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"),
    )
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (grid - 1)
    z = (x - F.col("center")) / F.col("bandwidth")
    kernel = F.col("n") * F.exp(-z * z / 2) / (
        F.col("total") * F.col("bandwidth") * F.lit(2.5066282746310002)
    )
    return spread.groupBy("point", x.alias("x")).agg(F.sum(kernel).alias("density"))


def median_by_class(
    df: DataFrame, column: str = "observed_time", by: str = "event_occurred",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact interpolated median per class."""
    return exact_quantiles(df, column, {"median": 0.5}, [by], cuts)


def fold_summary(scores: DataFrame, by: Sequence[str], score: str = "c_index") -> DataFrame:
    """Mean and population deviation over folds; folds that scored 0 are left out."""
    return scores.filter(F.col(score) > 0).groupBy(*by).agg(
        F.avg(score).alias("mean_c_index"), F.stddev_pop(score).alias("std_c_index")
    )
