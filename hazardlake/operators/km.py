"""Kaplan-Meier and Nelson-Aalen estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import cut_points, running

Z95 = 1.959963984540054


def life_table(
    df: DataFrame,
    by: Sequence[str] = (),
    time: str = "observed_time",
    event: str = "event_occurred",
    weight: str | None = None,
) -> DataFrame:
    """Events and rows per distinct time: the only pass over the full data."""
    m = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*by, F.col(time).alias("t")).agg(
        F.sum(F.col(event).cast("int") * m).alias("d"), F.sum(m).alias("m")
    )


def resolve_cuts(table: DataFrame, cuts: Sequence[float] | str | None) -> Sequence[float]:
    """``None``: times are bounded, one window per group; ``"auto"``: measure and bucket."""
    if cuts == "auto":
        return cut_points(table, "t")
    return cuts or ()


def at_risk(
    df: DataFrame,
    by: Sequence[str] = (),
    time: str = "observed_time",
    event: str = "event_occurred",
    cuts: Sequence[float] | str | None = "auto",
    weight: str | None = None,
) -> tuple[DataFrame, Sequence[float]]:
    """Life table with ``n``, the number at risk just before each time."""
    table = life_table(df, by, time, event, weight)
    found = resolve_cuts(table, cuts)
    counted = running(table, by, "t", sums={"seen": "m"}, totals={"size": "m"}, cuts=found)
    return counted.withColumn("n", F.col("size") - F.col("seen") + F.col("m")), found


def kaplan_meier(
    df: DataFrame,
    by: Sequence[str] = (),
    time: str = "observed_time",
    event: str = "event_occurred",
    band: bool = True,
    min_rows: int = 0,
    cuts: Sequence[float] | str | None = "auto",
) -> DataFrame:
    """Product-limit curve per group, starting at t = 0 with S = 1.

    ``min_rows`` keeps only groups with more rows than that. ``band`` adds the 95 %
    log(-log) band from Greenwood's variance; it is 1 while S = 1 and NULL once S = 0.
    """
    by = list(by)
    table, found = at_risk(df, by, time, event, cuts)
    if min_rows:
        table = table.filter(F.col("size") > min_rows)
    table = table.withColumns({
        "factor": 1 - F.col("d") / F.col("n"),
        "variance_term": F.try_divide(F.col("d").cast("double"), F.col("n") * (F.col("n") - F.col("d"))),
    })
    curve = running(
        table, by, "t", sums={"greenwood": "variance_term"}, products={"survival": "factor"}, cuts=found
    )
    point = F.struct(
        F.col("t"),
        F.col("n").cast("bigint").alias("n_at_risk"),
        F.col("d").cast("bigint").alias("events"),
        (F.col("m") - F.col("d")).cast("bigint").alias("censored"),
        F.col("survival"),
        F.coalesce("greenwood", F.lit(0.0)).alias("greenwood"),
    )
    start = F.struct(
        F.lit(0.0).alias("t"),
        F.col("size").cast("bigint").alias("n_at_risk"),
        F.lit(0).cast("bigint").alias("events"),
        F.lit(0).cast("bigint").alias("censored"),
        F.lit(1.0).alias("survival"),
        F.lit(0.0).alias("greenwood"),
    )
    first = (F.col("seen") == F.col("m")) & (F.col("t") > 0)
    points = curve.select(*by, F.inline(F.when(first, F.array(start, point)).otherwise(F.array(point))))
    if not band:
        return points.drop("greenwood")
    s = F.col("survival")
    log_s = F.ln(s)
    spread = F.lit(Z95) * F.sqrt("greenwood") / -log_s
    lower, upper = F.exp(log_s * F.exp(spread)), F.exp(log_s * F.exp(-spread))
    return points.select(
        *by, "t", "n_at_risk", "events", "censored", "survival",
        F.when(s == 1, F.lit(1.0)).when(s > 0, lower).alias("ci_lower"),
        F.when(s == 1, F.lit(1.0)).when(s > 0, upper).alias("ci_upper"),
    )


def nelson_aalen(
    df: DataFrame,
    by: Sequence[str] = (),
    time: str = "observed_time",
    event: str = "event_occurred",
    cuts: Sequence[float] | str | None = "auto",
    weight: str | None = None,
) -> DataFrame:
    """Cumulative hazard H(t) per group."""
    table, found = at_risk(df, by, time, event, cuts, weight)
    stepped = table.withColumn("step", F.col("d") / F.col("n"))
    curve = running(stepped, by, "t", sums={"cumulative_hazard": "step"}, cuts=found)
    return curve.select(
        *by, "t", F.col("n").cast("bigint").alias("n_at_risk"),
        F.col("d").cast("bigint").alias("events"), "cumulative_hazard",
    )


def median_survival(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First time with S <= 0.5, else the last time of the curve."""
    return curves.groupBy(*by).agg(
        F.coalesce(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))), F.max("t")).alias("median_time")
    )
