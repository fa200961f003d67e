"""Survival cohorts derived from order and event tables.

A repeat-order cohort has one row per order: the time from an order to the same
customer's next order, censored at the last order date of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.cleaning import survival_features
from ..operators.prefix import cut_points, next_value

SITES = [f"NATION_{i}" for i in range(9)]
SPARSE = ["NATION_7", "NATION_8"]
IDS = ["row_id", "case_id"]
_STAGE_OF_PRIORITY = {
    "URGENT": "Stage IA",
    "HIGH": "Stage IIB",
    "MEDIUM": "Stage III",
    "LOW": "Stage IVC",
    "NOT SPECIFIED": fv.MISSING_MARKER,
}


# Read schemas: stated, so that building a plan starts no schema-inference job.
_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
    "nation": "n_nationkey int, n_name string",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_returnflag string",
    "events": "user_id bigint, ts timestamp_ntz",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _days_to_next_order(orders: DataFrame) -> DataFrame:
    """Per order: event flag and whole days to the customer's next order.

    Orders are first reduced to (customer, day), so the window sees at most one row per
    calendar day of a customer, however many orders that customer has. Within a day all
    but the highest key have their successor on the same day. The join back is on
    (customer, day), with unique keys on one side, where AQE can split a hot key.
    """
    daily = orders.withColumn("day", F.to_date("o_orderdate"))
    per_day = daily.groupBy("o_custkey", "day").agg(F.max("o_orderkey").alias("last_key"))
    by_customer = Window.partitionBy("o_custkey").orderBy("day")
    per_day = per_day.withColumn("next_day", F.lead("day").over(by_customer))
    cutoff = orders.select(F.max(F.to_date("o_orderdate"))).scalar()
    joined = daily.join(per_day, ["o_custkey", "day"])
    same_day = F.col("o_orderkey") < F.col("last_key")
    follows = same_day | F.col("next_day").isNotNull()
    until = F.when(same_day, F.col("day")).otherwise(F.coalesce("next_day", cutoff))
    return joined.select(
        "o_orderkey",
        "o_custkey",
        "o_orderpriority",
        follows.alias("follows"),
        F.datediff(until, F.col("day")).alias("raw_days"),
    )


def clinical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw clinical table: text columns under their dotted names, plus the row and case id."""
    orders = _table(spark, sf_dir, "orders")
    customers = (
        _table(spark, sf_dir, "customer")
        .join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_acctbal", "n_name")
    )
    rows = _days_to_next_order(orders).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    days = F.col("raw_days").cast("string")
    missing = F.lit(fv.MISSING_MARKER)
    priority = F.substring("o_orderpriority", 3, 100)
    stage = F.lit(None).cast("string")
    for code, text in _STAGE_OF_PRIORITY.items():
        stage = F.when(priority == code, F.lit(text)).otherwise(stage)
    return rows.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderkey").cast("string").alias(fv.CASE_KEY),
        F.when(F.col("follows"), F.lit("Dead")).otherwise(F.lit("Alive"))
        .alias("demographic.vital_status"),
        F.when(F.col("follows"), missing).otherwise(days)
        .alias("diagnoses.days_to_last_follow_up"),
        F.when(F.col("follows"), days).otherwise(missing).alias("demographic.days_to_death"),
        (F.col("c_acctbal") / 100).cast("string").alias("demographic.age_at_index"),
        stage.alias("diagnoses.ajcc_pathologic_stage"),
        F.col("n_name").alias("diagnoses.tissue_or_organ_of_origin"),
    )


def partly_followed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clinical_records`` where customers with an overdrawn account are not followed: their rows have no days."""
    records = clinical_records(spark, sf_dir)
    lost = F.col("`demographic.age_at_index`").cast("double") < 0
    timed = ("diagnoses.days_to_last_follow_up", "demographic.days_to_death")
    return records.select(*[
        F.when(lost, F.lit(fv.MISSING_MARKER)).otherwise(F.col(f"`{c}`")).alias(c) if c in timed else F.col(f"`{c}`")
        for c in records.columns
    ])


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sample table: several rows per case key."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias(fv.CASE_KEY),
        F.col("l_linenumber").cast("string").alias("samples.sample_number"),
        F.col("l_returnflag").alias("samples.sample_type"),
    )


def features(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ("age_group",)) -> DataFrame:
    """Cleaned survival features, one row per order."""
    return survival_features(clinical_records(spark, sf_dir), IDS, SITES, SPARSE, extra)


def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous-time cohort: seconds from each (user, instant) to the user's next instant.

    Gaps are found inside buckets of the time axis, so a user with most of the events is
    spread over many tasks. A user's last instant is censored at the end of the table.
    """
    events = _table(spark, sf_dir, "events")
    instants = events.select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    ).distinct()
    gaps = next_value(instants, ["user_id"], "at", "next_at", cut_points(instants, "at"))
    last = instants.select(F.max("at")).scalar()
    return gaps.select(
        "user_id",
        ((F.coalesce("next_at", last) - F.col("at")) / 1e6).alias("observed_time"),
        F.col("next_at").isNotNull().cast("int").alias("event_occurred"),
    )
