"""From raw consolidated records to survival features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed_values as fv
from ..functions import scalars as sc

AGE, STAGE, SITE = "age_at_index", "ajcc_pathologic_stage", "tissue_or_organ_of_origin"


def select_renamed(
    df: DataFrame, columns: Mapping[str, str] = fv.SURVIVAL_COLUMNS, keep: Sequence[str] = ()
) -> DataFrame:
    """The mapped columns under their new names, plus ``keep`` (row and case ids)."""
    return df.select(
        *[sc.quoted(k) for k in keep],
        *[sc.quoted(old).alias(new) for old, new in columns.items()],
    )


def keep_sites(df: DataFrame, sites: Sequence[str] = fv.COLON_SITES) -> DataFrame:
    return df.filter(F.col(SITE).isin(list(sites)))


def drop_sites(df: DataFrame, sites: Sequence[str] = fv.SPARSE_SITES) -> DataFrame:
    """Rows of the listed sites go, rows without a site stay."""
    return df.filter(~F.coalesce(F.col(SITE).isin(list(sites)), F.lit(False)))


def to_numbers(df: DataFrame, columns: Sequence[str] = fv.NUMERIC_TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: sc.number_or_null(F.col(c)) for c in columns})


def add_event_and_days(df: DataFrame) -> DataFrame:
    flagged = df.withColumn("event_occurred", sc.event_flag(F.col("vital_status")))
    return flagged.withColumn(
        "observed_days",
        sc.observed_days(
            F.col("event_occurred"), F.col("days_to_death"), F.col("days_to_last_follow_up")
        ),
    )


def add_event_and_time(df: DataFrame) -> DataFrame:
    """Event flag and time in years; rows without a time go, times <= 0 become one day."""
    timed = add_event_and_days(df).na.drop(subset=["observed_days"])
    timed = timed.withColumn("observed_days", sc.at_least_one_day(F.col("observed_days")))
    return timed.withColumn("observed_time", sc.years(F.col("observed_days")))


def add_age_band(df: DataFrame) -> DataFrame:
    return df.withColumn("age_group", sc.band(F.col(AGE)))


def group_stages(df: DataFrame) -> DataFrame:
    """Sub-stages to Stage I-IV; rows of no group go."""
    return df.withColumn(STAGE, sc.group_of(F.col(STAGE))).na.drop(subset=[STAGE])


def display_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(fv.DISPLAY_COLUMNS)


def survival_features(
    df: DataFrame,
    ids: Sequence[str] = (),
    sites: Sequence[str] = fv.COLON_SITES,
    sparse_sites: Sequence[str] = fv.SPARSE_SITES,
    extra: Sequence[str] = (),
) -> DataFrame:
    """The whole cleaning chain; one narrow plan that Catalyst folds into the scan.

    ``ids`` are carried through so that every row keeps its identity; ``extra`` names
    further columns to store next to the five feature columns (``age_group`` say).
    """
    chained = (
        df.transform(select_renamed, keep=ids)
        .transform(keep_sites, sites)
        .transform(to_numbers)
        .transform(add_event_and_time)
        .transform(add_age_band)
        .transform(group_stages)
        .transform(drop_sites, sparse_sites)
    )
    return chained.select(*[sc.quoted(c) for c in ids], *fv.FINAL_FEATURES, *extra)


def step_audit(
    df: DataFrame,
    sites: Sequence[str] = fv.COLON_SITES,
    sparse_sites: Sequence[str] = fv.SPARSE_SITES,
) -> DataFrame:
    """Rows in, rows out and rows touched per cleaning step, from one aggregation.

    The steps are nested filters, so a row's fate is decided by flags on the same row.
    """
    flagged = df.transform(select_renamed).transform(to_numbers).transform(add_event_and_days)
    site, days = F.col(SITE), F.col("observed_days")
    in_site = F.coalesce(site.isin(list(sites)), F.lit(False))
    has_time = in_site & days.isNotNull()
    staged = has_time & sc.group_of(F.col(STAGE)).isNotNull()
    kept = staged & ~F.coalesce(site.isin(list(sparse_sites)), F.lit(False))
    one = flagged.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(in_site).alias("in_site"),
        F.count_if(has_time).alias("has_time"),
        F.count_if(has_time & (days <= 0)).alias("clamped"),
        F.count_if(has_time & sc.band(F.col(AGE)).isNull()).alias("no_band"),
        F.count_if(staged).alias("staged"),
        F.count_if(kept).alias("kept"),
    )
    steps = [
        ("site filter", "all_rows", "in_site", None),
        ("missing time", "in_site", "has_time", None),
        ("time clamp", "has_time", "has_time", "clamped"),
        ("age outside bands", "has_time", "has_time", "no_band"),
        ("unmapped stage", "has_time", "staged", None),
        ("sparse sites", "staged", "kept", None),
    ]
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("step_order"),
            F.lit(name).alias("step"),
            F.col(before).alias("rows_in"),
            F.col(after).alias("rows_out"),
            (F.col(touched) if touched else F.col(before) - F.col(after)).alias("affected"),
        )
        for i, (name, before, after, touched) in enumerate(steps, 1)
    ])
    return one.select(F.inline(rows))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First rows under display names, in an explicit order."""
    return (
        df.orderBy(*order_by)
        .limit(n)
        .select([F.col(c).alias(label) for c, label in fv.PREVIEW_COLUMNS.items()])
    )


def text_columns(df: DataFrame, ignore: Sequence[str] = ()) -> list[str]:
    """Categorical columns, found by type."""
    return [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in ignore]
