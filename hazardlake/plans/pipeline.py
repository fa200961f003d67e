"""The three batch entry points: prepare, train, score. Tables in, tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import cleaning, cox, eda, explain, joining, km, risk, sampling
from ..operators.boosted import BoostedModel
from ..operators.cox import CoxModel
from ..operators.encoding import EVENT, TIME, Encoder
from ..operators.forest import ForestModel
from ..operators.numbering import numbered
from ..sources import files
from . import compare, diagnostics

ROW_ID = "row_id"
_PARTS = {
    fv.COX: ["coefficients"],
    fv.FOREST: ["cuts", "nodes", "drops", "last_time"],
    fv.BOOSTED: ["cuts", "nodes"],
}


def with_row_id(df: DataFrame) -> DataFrame:
    """Add an id made of a 27-bit hash of the row's values and its number among rows of that hash, by digest.

    Equal rows get consecutive ids, so which of them has which does not matter, and they are numbered
    over many tasks however many they are.
    """
    values = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]))
    hashed = df.withColumn("__digest", F.md5(values.cast("binary"))).withColumn(
        "__hash", F.shiftright(F.conv(F.left("__digest", F.lit(7)), 16, 10).cast("bigint"), 1)
    )
    placed = numbered(hashed, [F.col("__digest").asc()], "__hash")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.shiftleft("__hash", 36) + F.col("place")).alias(ROW_ID))


def prepare(
    spark: SparkSession, clinical: str, samples: str, folder: str,
    sites: Sequence[str] = fv.COLON_SITES, sparse_sites: Sequence[str] = fv.SPARSE_SITES,
    extra: Sequence[str] = (),
) -> str:
    """Raw tables -> Parquet -> consolidated table -> feature table and step audit.

    The feature table gets a ``row_id`` from the values of its row and a count among equal
    rows, so that splits and folds do not depend on partitioning.
    """
    clinical_table = files.convert_to_parquet(spark, clinical, f"{folder}/interim/clinical.parquet")
    sample_table = files.convert_to_parquet(spark, samples, f"{folder}/interim/samples.parquet")
    joined = joining.consolidate(clinical_table, sample_table, fv.CASE_KEY)
    consolidated = spark.read.parquet(files.write_table(joined, f"{folder}/interim/consolidated.parquet"))
    features = cleaning.survival_features(consolidated, [fv.CASE_KEY], sites, sparse_sites, extra)
    named = features.withColumnRenamed(fv.CASE_KEY, "case_id")
    numbered = with_row_id(named)
    audit = cleaning.step_audit(consolidated, sites, sparse_sites)
    files.write_table(audit, f"{folder}/reports/step_audit.csv")
    return files.write_table(numbered, f"{folder}/processed/features.parquet")


def explore(df: DataFrame, folder: str, site_labels: dict[str, str] = fv.SITE_LABELS) -> dict[str, DataFrame]:
    """Every chart table of the exploratory report, written as CSV."""
    stage = cleaning.STAGE
    tables = {
        "age_histogram": eda.histogram(df, cleaning.AGE),
        "age_density": eda.density(df, cleaning.AGE),
        "stages": eda.counts_by_stage(df),
        "sites": eda.counts_by_site(df, site_labels),
        "mortality_by_age_band": eda.mortality_by_age_band(df),
        "vital_status": eda.status_share(df),
        "time_histogram": eda.histogram(df, TIME, by=[EVENT]),
        "time_median": eda.median_by_class(df),
        "kaplan_meier": km.kaplan_meier(df),
        "kaplan_meier_by_stage": km.kaplan_meier(df, [stage], band=False, min_rows=10),
    }
    for name, table in tables.items():
        files.write_table(table, f"{folder}/reports/eda/{name}.csv")
    return tables


def save_model(spark: SparkSession, name: str, model: compare.Model, folder: str) -> None:
    tables = {"coefficients": model.table(spark)} if name == fv.COX else model.tables(spark)
    files.save_model_tables(tables, f"{folder}/models/{name}")


def load_model(spark: SparkSession, name: str, folder: str) -> compare.Model:
    tables = files.load_model_tables(spark, f"{folder}/models/{name}", _PARTS[name])
    if name == fv.COX:
        return CoxModel.from_table(tables["coefficients"])
    return ForestModel.from_tables(tables) if name == fv.FOREST else BoostedModel.from_tables(tables)


def load_best(spark: SparkSession, folder: str) -> tuple[str, compare.Model, Encoder]:
    name = spark.read.parquet(f"{folder}/models/best").first().model_name
    encoder = Encoder.from_table(spark.read.parquet(f"{folder}/models/encoder"))
    return name, load_model(spark, name, folder), encoder


def train(
    spark: SparkSession, features: str, folder: str, settings: dict | None = None, folds: int = 5,
    group_col: str | None = None,
) -> compare.Comparison:
    """Hold-out, cross-validation, final fits; writes snapshots, models and the report.

    With ``group_col`` (``case_id``, say) all rows of a group are on the same side of the
    hold-out and in the same fold.
    """
    table = files.read_table(spark, features)
    table = table.drop(*[c for c in ("case_id",) if c != group_col])
    split = spark.read.parquet(
        files.write_table(sampling.stratified_holdout(table, group_col=group_col), f"{folder}/processed/split.parquet")
    )
    result = compare.compare_models(split, folds, settings=settings, group_col=group_col)
    snapshot = result.train.unionByName(result.test)
    files.write_table(snapshot, f"{folder}/processed/encoded.parquet", partition_by=["split"])
    for name, model in result.models.items():
        save_model(spark, name, model, folder)
    files.save_model_tables(
        {
            "encoder": result.encoder.table(spark),
            "best": spark.createDataFrame([(result.best,)], "model_name string"),
        },
        f"{folder}/models",
    )
    files.write_table(result.report, f"{folder}/reports/model_comparison_results.csv")
    return result


def interpret(spark: SparkSession, result: compare.Comparison, folder: str, repeats: int = 10) -> dict[str, DataFrame]:
    """Hazard ratios, importances, partial dependence and individual curves."""
    features = result.encoder.columns
    forest, boosted = result.models[fv.FOREST], result.models[fv.BOOSTED]

    def by_forest(df: DataFrame, replace: dict) -> DataFrame:
        return forest.score(df, replace=replace)

    def by_boosted(df: DataFrame, replace: dict) -> DataFrame:
        return boosted.margin(df, "risk", replace=replace)

    shuffled = explain.permutation_importance(result.test, by_forest, features, repeats)
    gains = boosted.importance(spark, "gain")
    tables = {
        "hazard_ratios": cox.hazard_ratios(result.models[fv.COX].table(spark)),
        "permutation_importance": shuffled,
        "importance_weight": boosted.importance(spark, "weight"),
        "importance_gain": gains,
    }
    for name, scorer, best in (
        ("forest", by_forest, explain.top_features(shuffled)),
        ("boosted", by_boosted, explain.top_features(gains)),
    ):
        tables[f"partial_dependence_{name}"] = explain.partial_dependence(result.train, scorer, features, best)
        tables[f"individual_curves_{name}"] = explain.individual_curves(result.train, scorer, features, best)
    for name, table in tables.items():
        files.write_table(table, f"{folder}/reports/figures/{name}.csv")
    return tables


def predict_times(spark: SparkSession, features: str, folder: str) -> str:
    """Median survival time of every row by the forest, written next to its features."""
    model = load_model(spark, fv.FOREST, folder)
    encoder = Encoder.from_table(spark.read.parquet(f"{folder}/models/encoder"))
    table = files.read_table(spark, features)
    times = model.median_time(encoder.transform(table, [ROW_ID])).select(ROW_ID, "predicted_survival_time")
    out = table.join(times, ROW_ID).select(
        *[F.col(c) for c in table.columns if c not in (EVENT, TIME)],
        (F.col(EVENT) == 1).alias("OS"), F.col(TIME).alias("OS_time"), "predicted_survival_time",
    )
    return files.write_table(out, f"{folder}/reports/predicted_survival_time.csv")


def curves_by_risk(spark: SparkSession, features: str, folder: str) -> DataFrame:
    """Score with the best model, cut terciles, one Kaplan-Meier curve per risk group."""
    _, model, encoder = load_best(spark, folder)
    encoded = encoder.transform(files.read_table(spark, features), [EVENT, TIME])
    scored = compare.score_model(model, encoded)
    curves = km.kaplan_meier(risk.risk_groups(scored), ["risk_group"])
    return spark.read.csv(
        files.write_table(curves, f"{folder}/reports/kaplan_meier_by_risk.csv"), header=True, schema=curves.schema
    )


def diagnose(
    split: DataFrame, folder: str, settings: dict | None = None, models: Sequence[str] = compare.MODELS,
    refit: Sequence[str] = diagnostics.REFIT, drop: Sequence[str] = ("age_group",), depths: Sequence[int] = (3, 5, 7, 10),
) -> dict[str, DataFrame]:
    """All five diagnostic tables, written as CSV; ``refit`` names the models fitted again on subsets and shuffled labels."""
    tables = {
        "gap": diagnostics.train_test_gap(split, models, settings),
        "redundancy": diagnostics.feature_redundancy(split, drop, models, settings),
        "complexity": diagnostics.complexity(split, depths, settings),
        "learning_curves": diagnostics.learning_curves(split, models=refit, settings=settings),
        "permutation": diagnostics.permutation_test(split, models=refit, settings=settings),
    }
    for name, table in tables.items():
        files.write_table(table, f"{folder}/reports/diagnostics/{name}.csv")
    return tables
