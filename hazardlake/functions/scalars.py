"""Scalar rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


def quoted(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number_or_null(col: Column) -> Column:
    """Text to DOUBLE; anything that is not a plain number, NaN included, is NULL.

    The pattern guard is needed because a cast also takes Java suffixes such as ``1.0d``.
    """
    text = F.trim(col.cast("string"))
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.nanvl(value, F.lit(None).cast("double"))


def event_flag(status: Column, event_value: str = fv.DEAD) -> Column:
    """1 for the event value, 0 for everything else, NULL included."""
    return F.coalesce(status == F.lit(event_value), F.lit(False)).cast("int")


def observed_days(event: Column, days_to_event: Column, days_to_censoring: Column) -> Column:
    """Days of the side the flag selects; no fallback to the other side."""
    return F.when(event == 1, days_to_event).otherwise(days_to_censoring)


def at_least_one_day(days: Column) -> Column:
    """Non-positive durations become exactly one day."""
    return F.when(days <= 0, F.lit(1.0)).otherwise(days)


def years(days: Column) -> Column:
    return days / F.lit(fv.DAYS_PER_YEAR)


def band_names(edges: Sequence[int] = fv.AGE_EDGES, prefix: str = "age") -> list[str]:
    return [f"{prefix}_{lo}_{hi}" for lo, hi in zip(edges, edges[1:])]


def band(value: Column, edges: Sequence[int] = fv.AGE_EDGES, prefix: str = "age") -> Column:
    """Left-closed band label; outside the edges NULL."""
    out = F.lit(None).cast("string")
    for name, lo, hi in zip(band_names(edges, prefix), edges, edges[1:]):
        out = F.when((value >= lo) & (value < hi), F.lit(name)).otherwise(out)
    return out


def group_of(value: Column, groups: Mapping[str, Sequence[str]] = fv.STAGE_GROUPS) -> Column:
    """Name of the group whose member list holds the value, else NULL."""
    out = F.lit(None).cast("string")
    for name, members in groups.items():
        out = F.when(value.isin(list(members)), F.lit(name)).otherwise(out)
    return out


def recode(value: Column, labels: Mapping, keep_unmapped: bool = False) -> Column:
    """Look the value up in a small literal map; unmapped is NULL or stays as it is."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(found, value) if keep_unmapped else found


def replace_value(value: Column, old: str = fv.MISSING_MARKER, new: str = fv.NOT_REPORTED_LABEL) -> Column:
    return F.when(value == old, F.lit(new)).otherwise(value)


def readable_feature(name: Column) -> Column:
    """Feature name for display: known prefix off, blanks for underscores, stage translated."""
    stripped = name
    for prefix in reversed(fv.FEATURE_PREFIXES):
        stripped = F.when(
            name.startswith(prefix), F.replace(name, F.lit(prefix), F.lit(""))
        ).otherwise(stripped)
    spaced = F.translate(stripped, "_", " ")
    return F.replace(spaced, F.lit("Stage I"), F.lit("Estágio I"))


def effect_label(hazard_ratio: Column) -> Column:
    return F.when(hazard_ratio > 1, F.lit(fv.RISK_FACTOR_LABEL)).otherwise(F.lit(fv.PROTECTIVE_LABEL))


def overfit_label(gap: Column) -> Column:
    strong, slight, none = fv.OVERFIT_LABELS
    return (
        F.when(gap > fv.OVERFIT_GAPS[0], F.lit(strong))
        .when(gap > fv.OVERFIT_GAPS[1], F.lit(slight))
        .otherwise(F.lit(none))
    )


def signed_time(event: Column, time: Column) -> Column:
    """Time for events, minus time for censored rows."""
    return F.when(event.cast("int") == 1, time).otherwise(-time)


def hash32(*parts) -> Column:
    """Uniform 32-bit number from the md5 of the parts joined by ``:``.

    Used for every split, fold, sample and permutation: it depends on values only,
    never on partitioning, and any SQL engine with md5 can reproduce it.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform_sql(seed: int, salt: int, *columns: str) -> str:
    """SQL for a uniform number strictly inside (0, 1) from the hash of the columns."""
    return f"((xxhash64({seed}, {salt}, {', '.join(columns)}) & 9007199254740991) + 0.5D) / 9007199254740992D"


def hash_uniform(*parts) -> Column:
    """Uniform number strictly inside (0, 1)."""
    return (hash32(*parts) + F.lit(0.5)) / F.lit(float(2**32))
