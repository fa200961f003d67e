"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import scalars as sc
from ..operators import cleaning as cl
from ..operators import concordance as cc
from ..operators import boosted, cox, eda, encoding, explain, forest, joining, km, risk, sampling, trees
from ..session import materialize, scratch_path
from ..sources import files
from . import cohort, compare, diagnostics, pipeline

DIGITS = 6
STAGE, SITE, AGE = cl.STAGE, cl.SITE, cl.AGE
EVENT, TIME = encoding.EVENT, encoding.TIME
STAGE_WEIGHTS = {"Stage II": 0.5, "Stage III": 1.0, "Stage IV": 1.8}


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round at the edge of a query, so that summation order does not show."""
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def fixed_score() -> Column:
    """A fixed linear risk score, for queries that must have an SQL twin."""
    weight = F.lit(0.0)
    for stage, w in STAGE_WEIGHTS.items():
        weight = F.when(F.col(STAGE) == stage, F.lit(w)).otherwise(weight)
    return F.round(F.lit(0.03) * (F.col(AGE) - 60) + weight, 8)


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table written once, for queries that pass over it several times."""
    return materialize(cohort.features(spark, sf_dir), "features")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(spark, sf_dir).withColumn("risk", fixed_score())


# ---- sources, sinks, cleaning ------------------------------------------------------------


def ingest_tsv_roundtrip(spark, sf_dir):
    raw = cohort.clinical_records(spark, sf_dir)
    source, target = scratch_path(spark, "raw") + ".tsv", scratch_path(spark, "raw") + ".parquet"
    raw.write.csv(source, sep="\t", header=True)
    table = files.convert_to_parquet(spark, source, target)
    return cl.select_renamed(table, keep=["row_id"]).select(
        F.col("row_id").cast("bigint").alias("row_id"),
        "vital_status", "days_to_last_follow_up", "days_to_death",
        F.col(AGE).cast("double").alias(AGE), STAGE, SITE,
    )


def csv_roundtrip(spark, sf_dir):
    df = cohort.features(spark, sf_dir)
    path = files.write_table(df, scratch_path(spark, "features") + ".csv")
    return rounded(files.read_table(spark, path, df.schema), TIME, AGE)


def select_rename(spark, sf_dir):
    return cl.select_renamed(cohort.clinical_records(spark, sf_dir), keep=["row_id"]).withColumn(
        AGE, F.col(AGE).cast("double")
    )


def _renamed(spark, sf_dir):
    return cl.select_renamed(cohort.clinical_records(spark, sf_dir), keep=["row_id"])


def site_filter(spark, sf_dir):
    return cl.keep_sites(_renamed(spark, sf_dir), cohort.SITES).select("row_id", SITE)


def sparse_site_filter(spark, sf_dir):
    return cl.drop_sites(_renamed(spark, sf_dir), cohort.SPARSE).select("row_id", SITE)


def numeric_coerce(spark, sf_dir):
    return cl.to_numbers(_renamed(spark, sf_dir)).select("row_id", *fv.NUMERIC_TEXT_COLUMNS)


def event_flag(spark, sf_dir):
    return _renamed(spark, sf_dir).select("row_id", sc.event_flag(F.col("vital_status")).alias(EVENT))


def observed_time(spark, sf_dir):
    timed = cl.add_event_and_time(cl.to_numbers(_renamed(spark, sf_dir)))
    return rounded(timed.select("row_id", EVENT, "observed_days", TIME), TIME)


def age_bands(spark, sf_dir):
    return cl.add_age_band(cl.to_numbers(_renamed(spark, sf_dir))).select("row_id", "age_group")


def stage_group(spark, sf_dir):
    return cl.group_stages(_renamed(spark, sf_dir)).select("row_id", STAGE)


def display_columns(spark, sf_dir):
    return rounded(cl.display_names(cohort.features(spark, sf_dir, ())), "observed_time", "idade")


SITE_LABELS = {f"NATION_{i}": f"Local {i}" for i in range(5)}


def recode_labels(spark, sf_dir):
    df = cohort.features(spark, sf_dir)
    return df.select(
        "row_id",
        sc.recode(F.col(SITE), SITE_LABELS).alias("localizacao"),
        sc.recode(F.col("age_group"), fv.AGE_BAND_LABELS, keep_unmapped=True).alias("faixa"),
        sc.recode(F.col(EVENT), fv.VITAL_LABELS).alias("vital_status"),
    )


def value_replace(spark, sf_dir):
    return _renamed(spark, sf_dir).select("row_id", sc.replace_value(F.col(STAGE)).alias(STAGE))


def clean_feature_names(spark, sf_dir):
    df = cohort.features(spark, sf_dir)
    names = df.select(F.explode(F.array(
        F.concat(F.lit(f"{STAGE}_"), F.col(STAGE)),
        F.concat(F.lit(f"{SITE}_"), F.col(SITE)),
        F.concat(F.lit("age_group_"), F.col("age_group")),
        F.lit(AGE),
    )).alias("feature")).filter("feature is not null").distinct()
    return names.withColumn("label", sc.readable_feature(F.col("feature")))


def step_audit(spark, sf_dir):
    return cl.step_audit(cohort.clinical_records(spark, sf_dir), cohort.SITES, cohort.SPARSE)


def features_without_time(spark, sf_dir):
    """Features of records of which some, with and without event, have no time; these go."""
    records = cohort.partly_followed_records(spark, sf_dir)
    table = cl.survival_features(records, cohort.IDS, cohort.SITES, cohort.SPARSE, ("age_group",))
    return rounded(table, TIME, AGE)


def audit_without_time(spark, sf_dir):
    """Rows per cleaning step where some records have no time."""
    return cl.step_audit(cohort.partly_followed_records(spark, sf_dir), cohort.SITES, cohort.SPARSE)


def _consolidated(spark, sf_dir):
    return joining.consolidate(
        cohort.clinical_records(spark, sf_dir), cohort.sample_records(spark, sf_dir), fv.CASE_KEY
    )


def inner_join_fanout(spark, sf_dir):
    return _consolidated(spark, sf_dir).select(
        "row_id",
        sc.quoted("samples.sample_number").cast("int").alias("sample_number"),
        sc.quoted("samples.sample_type").alias("sample_type"),
    )


def feature_table(spark, sf_dir):
    table = cl.survival_features(_consolidated(spark, sf_dir), ["row_id"], cohort.SITES, cohort.SPARSE)
    return rounded(table, TIME, AGE)


def preview_top10(spark, sf_dir):
    shown = cl.preview(cohort.features(spark, sf_dir), ["row_id"])
    return shown.select(
        *[F.round(sc.quoted(c), DIGITS).alias(c) if c in ("Tempo (Anos)", "Idade") else sc.quoted(c)
          for c in shown.columns]
    )


# ---- exploratory aggregates and curves ---------------------------------------------------


def count_by_stage(spark, sf_dir):
    raw = _renamed(spark, sf_dir)
    return eda.counts_by_stage(raw)


def count_by_site(spark, sf_dir):
    return eda.counts_by_site(cohort.features(spark, sf_dir), SITE_LABELS)


def counts_sorted_by_stage(spark, sf_dir):
    return eda.counts_sorted(cohort.features(spark, sf_dir), STAGE)


def distinct_stages(spark, sf_dir):
    return eda.distinct_values(cohort.features(spark, sf_dir), STAGE)


def mortality_by_age_band(spark, sf_dir):
    return rounded(eda.mortality_by_age_band(cohort.features(spark, sf_dir)), "death_rate_pct")


def status_share(spark, sf_dir):
    return rounded(eda.status_share(cohort.features(spark, sf_dir)), "pct")


def histogram_age(spark, sf_dir):
    return rounded(eda.histogram(stored_features(spark, sf_dir), AGE), "bin_lo", "bin_hi")


def histogram_time_by_event(spark, sf_dir):
    return rounded(eda.histogram(stored_features(spark, sf_dir), TIME, by=[EVENT]), "bin_lo", "bin_hi")


def kde_age(spark, sf_dir):
    return rounded(eda.density(stored_features(spark, sf_dir), AGE), "x", "density")


def median_time_by_event(spark, sf_dir):
    return rounded(eda.median_by_class(cohort.features(spark, sf_dir), cuts=[]), "median")


_CURVE = ("t", "survival")
_BAND = ("ci_lower", "ci_upper")


def km_global(spark, sf_dir):
    return rounded(km.kaplan_meier(cohort.features(spark, sf_dir), cuts=None), *_CURVE, *_BAND)


def km_by_stage(spark, sf_dir):
    df = cohort.features(spark, sf_dir)
    return rounded(km.kaplan_meier(df, [STAGE], min_rows=10, cuts=None), *_CURVE, *_BAND)


def km_by_risk_group(spark, sf_dir):
    grouped = risk.risk_groups(scored(spark, sf_dir))
    return rounded(km.kaplan_meier(grouped, ["risk_group"], cuts=None), *_CURVE, *_BAND)


def km_median(spark, sf_dir):
    curves = km.kaplan_meier(cohort.features(spark, sf_dir), [STAGE], band=False, cuts=None)
    return rounded(km.median_survival(curves, [STAGE]), "median_time")


def km_event_gap(spark, sf_dir):
    gaps = cohort.event_gaps(spark, sf_dir)
    return rounded(km.kaplan_meier(gaps, band=False, cuts="auto"), *_CURVE)


def nelson_aalen(spark, sf_dir):
    return rounded(km.nelson_aalen(cohort.features(spark, sf_dir), cuts=None), "t", "cumulative_hazard")


def risk_terciles(spark, sf_dir):
    return risk.risk_groups(scored(spark, sf_dir)).select("row_id", "risk_group")


# ---- feature matrix, splits, concordance -------------------------------------------------


def _encoded(spark, sf_dir, keep=("row_id", EVENT, TIME, "split")):
    split = sampling.stratified_holdout(stored_features(spark, sf_dir).drop("age_group"))
    encoder = encoding.fit_encoder(split.filter("split = 'train'"), encoding.feature_roles(split))
    return encoder, encoder.transform(split, keep)


def onehot_encode(spark, sf_dir):
    encoder, table = _encoded(spark, sf_dir, ("row_id", "split"))
    return rounded(table, AGE)


ALIGNED = [AGE, f"{STAGE}_Stage IV", f"{STAGE}_Stage V", f"{SITE}_NATION_2"]


def align_columns(spark, sf_dir):
    _, table = _encoded(spark, sf_dir)
    return rounded(joining.align_columns(table, ALIGNED, keep=["row_id"]), AGE)


def signed_label(spark, sf_dir):
    df = encoding.add_signed_label(cohort.features(spark, sf_dir))
    return rounded(df.select("row_id", "signed_time"), "signed_time")


def stratified_holdout(spark, sf_dir):
    return sampling.stratified_holdout(stored_features(spark, sf_dir)).select("row_id", "split")


def kfold_assign(spark, sf_dir):
    return sampling.assign_folds(cohort.features(spark, sf_dir)).select("row_id", "fold")


def subset_fraction(spark, sf_dir):
    return sampling.subset(stored_features(spark, sf_dir), 0.3).select("row_id")


def permute_labels(spark, sf_dir):
    df = stored_features(spark, sf_dir).select("row_id", EVENT, TIME)
    return rounded(sampling.permute(df, [EVENT, TIME], 0), TIME)


def cindex_fixed_score(spark, sf_dir):
    return rounded(cc.concordance(scored(spark, sf_dir)), "c_index")


def cindex_by_fold(spark, sf_dir):
    folds = sampling.assign_folds(scored(spark, sf_dir))
    return rounded(cc.concordance(folds, ["fold"]), "c_index")


def fold_score_summary(spark, sf_dir):
    folds = sampling.assign_folds(scored(spark, sf_dir))
    scores = cc.concordance(folds, ["fold"]).withColumn("model_name", F.lit("fixed"))
    return rounded(eda.fold_summary(scores, ["model_name"]), "mean_c_index", "std_c_index")

# ---- models ------------------------------------------------------------------------------

#: Rounds of the boosted models in partial dependence, model round trips and diagnostics; forests and depths are as published.
QUICK = {fv.BOOSTED: {"rounds": 10}}


def _train_rows(spark, sf_dir):
    encoder, table = _encoded(spark, sf_dir)
    table = materialize(table, "encoded")
    return encoder, table, table.filter("split = 'train'")


def cox_score_at_zero(spark, sf_dir):
    """Gradient of the Efron partial likelihood at coefficients 0, per feature."""
    encoder, table = _encoded(spark, sf_dir)
    return rounded(cox.score_at_zero(table, encoder.columns), "gradient")


def cox_coefficients(spark, sf_dir):
    encoder, _, train = _train_rows(spark, sf_dir)
    return cox.fit_cox(train, encoder.columns).table(spark)


def cox_risk(spark, sf_dir):
    encoder, table, train = _train_rows(spark, sf_dir)
    model = cox.fit_cox(train, encoder.columns)
    return table.select("row_id", "split", model.risk().alias("risk"))


def hazard_ratios(spark, sf_dir):
    encoder, _, train = _train_rows(spark, sf_dir)
    return cox.hazard_ratios(cox.fit_cox(train, encoder.columns).table(spark))


def boosted_grad_round1(spark, sf_dir):
    start = stored_features(spark, sf_dir).withColumn("margin", F.lit(0.0))
    return rounded(
        boosted.gradients(start).select("row_id", "gradient", "curvature"), "gradient", "curvature"
    )


def boosted_root_gain(spark, sf_dir):
    """Gain of the first tree's root split on each 0/1 feature, all rows, L2 0.1."""
    encoder, table = _encoded(spark, sf_dir)
    dummies = [c for c in encoder.columns if c != AGE]
    start = boosted.gradients(table.withColumn("margin", F.lit(0.0)))
    return rounded(trees.split_gains(start, dummies, reg_lambda=0.1), "gain")


def boosted_scores(spark, sf_dir):
    encoder, table, train = _train_rows(spark, sf_dir)
    model = boosted.fit_boosted(train, encoder.columns)
    return model.score(table).select("row_id", "split", "risk")


def importance_split_count(spark, sf_dir):
    encoder, _, train = _train_rows(spark, sf_dir)
    return boosted.fit_boosted(train, encoder.columns).importance(spark, "weight")


def importance_gain(spark, sf_dir):
    encoder, _, train = _train_rows(spark, sf_dir)
    return boosted.fit_boosted(train, encoder.columns).importance(spark, "gain")


def logrank_score(spark, sf_dir):
    df = stored_features(spark, sf_dir)
    hazard = km.nelson_aalen(df, cuts=None).select(F.col("t").alias(TIME), "cumulative_hazard")
    scores = df.join(hazard, TIME).select("row_id", (F.col(EVENT) - F.col("cumulative_hazard")).alias("score"))
    return rounded(scores, "score")


def _forest(spark, sf_dir):
    encoder, table, train = _train_rows(spark, sf_dir)
    return table, forest.fit_forest(train, encoder.columns)


def forest_risk(spark, sf_dir):
    table, model = _forest(spark, sf_dir)
    return model.score(table).select("row_id", "split", "risk")


def forest_curves(spark, sf_dir):
    table, model = _forest(spark, sf_dir)
    return model.curves(table)[1]


def pdp_forest(spark, sf_dir):
    """Partial dependence of the forest on the three features that matter most to it."""
    table, model = _forest(spark, sf_dir)
    scorer, best = _forest_view(model, table)
    return explain.partial_dependence(table.filter("split = 'train'"), scorer, model.binner.features, best)


def ice_forest(spark, sf_dir):
    table, model = _forest(spark, sf_dir)
    scorer, best = _forest_view(model, table)
    return explain.individual_curves(table.filter("split = 'train'"), scorer, model.binner.features, best)


def _forest_view(model, table):
    scorer = lambda d, replace: model.score(d, replace=replace)
    shuffled = explain.permutation_importance(table.filter("split = 'test'"), scorer, model.binner.features)
    return scorer, explain.top_features(materialize(shuffled, "importance"))


def top_features(spark, sf_dir):
    """The three features with the largest mean gain of the boosted model, in order."""
    encoder, _, train = _train_rows(spark, sf_dir)
    gains = boosted.fit_boosted(train, encoder.columns).importance(spark, "gain")
    best = explain.top_features(gains)
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(best)], "position int, feature string")


def predicted_median(spark, sf_dir):
    table, model = _forest(spark, sf_dir)
    return model.median_time(table).select("row_id", "predicted_survival_time")


# ---- explanation, comparison, diagnostics ------------------------------------------------

_SCORED_FEATURES = [AGE, STAGE]


def _fixed_scorer(df: DataFrame, replace: dict) -> DataFrame:
    shown = df
    for f, source in replace.items():
        shown = shown.drop(f).withColumnRenamed(source, f)
    return shown.withColumn("risk", fixed_score())


def pdp_linear(spark, sf_dir):
    df = stored_features(spark, sf_dir)
    table = explain.partial_dependence(df, _fixed_scorer, _SCORED_FEATURES, [AGE])
    return rounded(table, "value", "mean_prediction")


def ice_linear(spark, sf_dir):
    df = stored_features(spark, sf_dir)
    table = explain.individual_curves(df, _fixed_scorer, _SCORED_FEATURES, [AGE])
    return rounded(table, "value", "prediction")


def permutation_importance_linear(spark, sf_dir):
    df = stored_features(spark, sf_dir)
    table = explain.permutation_importance(df, _fixed_scorer, _SCORED_FEATURES)
    return rounded(table, "importance_mean", "importance_std")


def permutation_importance_forest(spark, sf_dir):
    table, model = _forest(spark, sf_dir)
    test = table.filter("split = 'test'")
    return explain.permutation_importance(
        test, lambda d, replace: model.score(d, replace=replace), model.binner.features
    )


def _boosted(spark, sf_dir):
    encoder, _, train = _train_rows(spark, sf_dir)
    model = boosted.fit_boosted(train, encoder.columns, **QUICK[fv.BOOSTED])
    best = explain.top_features(model.importance(spark, "gain"))
    return train, encoder.columns, lambda d, replace: model.margin(d, "risk", replace=replace), best


def pdp_boosted(spark, sf_dir):
    train, columns, scorer, best = _boosted(spark, sf_dir)
    return explain.partial_dependence(train, scorer, columns, best)


def ice_boosted(spark, sf_dir):
    train, columns, scorer, best = _boosted(spark, sf_dir)
    return explain.individual_curves(train, scorer, columns, best)


# ---- models on few features, which have SQL twins -----------------------------------------


def _age_split(spark, sf_dir):
    split = sampling.stratified_holdout(stored_features(spark, sf_dir).select("row_id", EVENT, TIME, AGE))
    return materialize(split, "age")


def _cox_age(spark, sf_dir):
    split = _age_split(spark, sf_dir)
    return split, cox.fit_cox(split.filter("split = 'train'"), [AGE])


def cox_age_table(spark, sf_dir):
    table = _cox_age(spark, sf_dir)[1].table(spark).drop("position", "p")
    return rounded(table, *[c for c in table.columns if c not in ("feature", "z")]).withColumn("z", F.round("z", 4))


def cox_age_risk(spark, sf_dir):
    split, model = _cox_age(spark, sf_dir)
    return rounded(split.select("row_id", "split", model.risk().alias("risk")), "risk")


def cox_age_effect(spark, sf_dir):
    effects = cox.hazard_ratios(_cox_age(spark, sf_dir)[1].table(spark)).drop("se", "z", "p")
    return rounded(effects, "coef", "hazard_ratio", "hr_lower", "hr_upper")


def diag_gap_age(spark, sf_dir):
    table = diagnostics.train_test_gap(_age_split(spark, sf_dir), [fv.COX])
    return rounded(table, "c_index_train", "c_index_test", "gap")


def comparison_age(spark, sf_dir):
    report = compare.compare_models(_age_split(spark, sf_dir), models=[fv.COX]).report
    return rounded(report, "cv_mean_c_index", "cv_std_c_index", "test_c_index")


def diag_learning_age(spark, sf_dir):
    table = diagnostics.learning_curves(_age_split(spark, sf_dir), models=[fv.COX])
    return rounded(table, "c_index_train", "c_index_test")


def diag_permutation_age(spark, sf_dir):
    table = diagnostics.permutation_test(_age_split(spark, sf_dir), models=[fv.COX])
    return rounded(table, "c_index_real", "c_index_random_mean", "difference")


def _dummies(spark, sf_dir):
    """All rows with the 0/1 features, times and events."""
    encoder, table = _encoded(spark, sf_dir)
    names = [c for c in encoder.columns if c != AGE]
    return names, materialize(table.select("row_id", EVENT, TIME, *[F.col(f"`{c}`") for c in names]), "dummies")


def _boosted_stump(spark, sf_dir):
    names, table = _dummies(spark, sf_dir)
    return table, boosted.fit_boosted(table, names, rounds=1, max_depth=1, subsample=1.0, gamma=0.0, min_child_weight=0.0)


def boosted_stump_risk(spark, sf_dir):
    table, model = _boosted_stump(spark, sf_dir)
    return rounded(model.score(table).select("row_id", "risk"), "risk")


def boosted_stump_importance(spark, sf_dir):
    model = _boosted_stump(spark, sf_dir)[1]
    weight = model.importance(spark, "weight").withColumnRenamed("importance", "weight")
    gain = model.importance(spark, "gain").withColumnRenamed("importance", "gain")
    return rounded(weight.join(gain, "feature"), "gain")


def _forest_stump(spark, sf_dir):
    names, table = _dummies(spark, sf_dir)
    model = forest.fit_forest(table, names, trees=1, max_depth=1, mtry=len(names), bootstrap=False)
    return table, model


def forest_stump_risk(spark, sf_dir):
    table, model = _forest_stump(spark, sf_dir)
    return rounded(model.score(table).select("row_id", "risk"), "risk")


def forest_stump_median(spark, sf_dir):
    table, model = _forest_stump(spark, sf_dir)
    return rounded(model.median_time(table).select("row_id", "predicted_survival_time"), "predicted_survival_time")


def forest_stump_curves(spark, sf_dir):
    table, model = _forest_stump(spark, sf_dir)
    return rounded(model.curves(table)[1], "t", "survival")


#: One tree of depth 1 over all rows and features.
STUMP = {
    fv.FOREST: {"trees": 1, "max_depth": 1, "mtry": 1000, "bootstrap": False},
    fv.BOOSTED: {"rounds": 1, "subsample": 1.0, "gamma": 0.0, "min_child_weight": 0.0},
}


def _stump_split(spark, sf_dir):
    """Training and test rows with the two categorical features."""
    split = sampling.stratified_holdout(stored_features(spark, sf_dir).select("row_id", EVENT, TIME, STAGE, SITE))
    return materialize(split, "stump")


def comparison_stump(spark, sf_dir):
    report = compare.compare_models(_stump_split(spark, sf_dir), models=[fv.FOREST], settings=STUMP).report
    return rounded(report, "cv_mean_c_index", "cv_std_c_index", "test_c_index")


def diag_redundancy_stump(spark, sf_dir):
    """Concordance of a log-rank stump with and without the stage."""
    table = diagnostics.feature_redundancy(_stump_split(spark, sf_dir), [STAGE], [fv.FOREST], STUMP)
    return rounded(table, "c_index_train", "c_index_test", "gap")


def diag_complexity_stump(spark, sf_dir):
    table = diagnostics.complexity(_stump_split(spark, sf_dir), [1], STUMP)
    return rounded(table, "c_index_train", "c_index_test", "gap")


def diag_learning_stump(spark, sf_dir):
    table = diagnostics.learning_curves(_stump_split(spark, sf_dir), models=[fv.FOREST], settings=STUMP)
    return rounded(table, "c_index_train", "c_index_test")


def diag_permutation_stump(spark, sf_dir):
    table = diagnostics.permutation_test(_stump_split(spark, sf_dir), models=[fv.FOREST], settings=STUMP)
    return rounded(table, "c_index_real", "c_index_random_mean", "difference")


def diag_report_stump(spark, sf_dir):
    """The five reports of log-rank and boosted stumps as their CSV files hold them, two indices a row."""
    folder = scratch_path(spark, "diagnostics")
    only = [fv.FOREST]
    tables = pipeline.diagnose(_stump_split(spark, sf_dir), folder, STUMP, only, only, [STAGE], [1])
    shown = {
        "gap": ("model_name", "c_index_train", "c_index_test"), "redundancy": ("configuration", "c_index_train", "c_index_test"),
        "complexity": ("max_depth", "c_index_train", "c_index_test"), "learning_curves": ("n_rows", "c_index_train", "c_index_test"),
        "permutation": ("model_name", "c_index_real", "c_index_random_mean"),
    }
    parts = []
    for name, (key, first, second) in shown.items():
        back = spark.read.csv(f"{folder}/reports/diagnostics/{name}.csv", header=True, schema=tables[name].schema)
        parts.append(back.select(F.lit(name).alias("report"), F.col(key).cast("string").alias("entry"), F.col(first).alias("first"), F.col(second).alias("second")))
    return rounded(reduce(DataFrame.unionByName, parts), "first", "second")


def report_roundtrip_age(spark, sf_dir):
    """The comparison report of the age model as it comes back from its CSV file."""
    report = compare.compare_models(_age_split(spark, sf_dir), models=[fv.COX]).report
    path = files.write_table(report, f"{scratch_path(spark, 'report')}/model_comparison_results.csv")
    back = spark.read.csv(path, header=True, schema=report.schema)
    return rounded(back, "cv_mean_c_index", "cv_std_c_index", "test_c_index")


def top_features_root(spark, sf_dir):
    """The three 0/1 features with the largest gain at the first tree's root, in order."""
    gains = boosted_root_gain(spark, sf_dir).withColumnRenamed("gain", "importance")
    best = explain.top_features(materialize(gains, "gains"))
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(best)], "position int, feature string")


def km_by_best_model_age(spark, sf_dir):
    """Curves of the risk terciles under the best model on age."""
    result = compare.compare_models(_age_split(spark, sf_dir), models=[fv.COX])
    scored_rows = compare.score_model(result.models[result.best], result.train.unionByName(result.test))
    grouped = risk.risk_groups(materialize(scored_rows, "scored"))
    return rounded(km.kaplan_meier(grouped, ["risk_group"], cuts=None), *_CURVE, *_BAND)


def prediction_roundtrip_stump(spark, sf_dir):
    """Median times of a log-rank stump with their features, as they come back from the CSV file."""
    folder = scratch_path(spark, "predictions")
    split = _stump_split(spark, sf_dir)
    encoder = encoding.fit_encoder(split, encoding.feature_roles(split))
    encoded = materialize(encoder.transform(split, ["row_id", EVENT, TIME]), "encoded")
    pipeline.save_model(spark, fv.FOREST, forest.fit_forest(encoded, encoder.columns, **STUMP[fv.FOREST]), folder)
    files.save_model_tables({"encoder": encoder.table(spark)}, f"{folder}/models")
    features = files.write_table(split.drop("split"), f"{folder}/features.parquet")
    schema = f"row_id long, {STAGE} string, {SITE} string, OS boolean, OS_time double, predicted_survival_time double"
    back = spark.read.csv(pipeline.predict_times(spark, features, folder), header=True, schema=schema)
    return rounded(back, "OS_time", "predicted_survival_time")


def _split(spark, sf_dir, *drop):
    split = sampling.stratified_holdout(stored_features(spark, sf_dir).drop("case_id", *drop))
    return materialize(split, "split")


def model_comparison(spark, sf_dir):
    return compare.compare_models(_split(spark, sf_dir, "age_group")).report


def km_by_best_model(spark, sf_dir):
    """Curves of the risk terciles under the model that scores best on the hold-out."""
    result = compare.compare_models(_split(spark, sf_dir, "age_group"))
    scored_rows = compare.score_model(result.models[result.best], result.train.unionByName(result.test))
    grouped = risk.risk_groups(materialize(scored_rows, "scored"))
    return rounded(km.kaplan_meier(grouped, ["risk_group"], cuts=None), *_CURVE, *_BAND)


def split_snapshot(spark, sf_dir):
    """Encoded training and test rows, written by split and read back."""
    _, table = _encoded(spark, sf_dir)
    path = files.write_table(table, f"{scratch_path(spark, 'snapshot')}.parquet", partition_by=["split"])
    return rounded(files.read_table(spark, path).select(*table.columns), AGE, TIME)


def model_roundtrip(spark, sf_dir):
    """Largest difference between the risks of a saved and loaded model and the original, per model."""
    encoder, table, train = _train_rows(spark, sf_dir)
    folder = scratch_path(spark, "models")
    parts = []
    for name in compare.MODELS:
        model = compare.fit_model(name, train, encoder.columns, None, QUICK)
        pipeline.save_model(spark, name, model, folder)
        loaded = pipeline.load_model(spark, name, folder)
        both = compare.score_model(model, table).select("row_id", F.col("risk").alias("before")).join(
            compare.score_model(loaded, table).select("row_id", "risk"), "row_id"
        )
        parts.append(both.agg(F.round(F.max(F.abs(F.col("before") - F.col("risk"))), DIGITS).alias("difference"), F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(name).alias("model_name"), "difference", "n_rows"))
    return reduce(DataFrame.unionByName, parts)


def report_roundtrip(spark, sf_dir):
    """The comparison report as it comes back from its CSV file."""
    report = compare.compare_models(_split(spark, sf_dir, "age_group")).report
    path = files.write_table(report, f"{scratch_path(spark, 'report')}/model_comparison_results.csv")
    return spark.read.csv(path, header=True, schema=report.schema)


def prediction_roundtrip(spark, sf_dir):
    """Predicted median times with their features, as they come back from the CSV file."""
    folder = scratch_path(spark, "predictions")
    encoder, _, train = _train_rows(spark, sf_dir)
    model = forest.fit_forest(train, encoder.columns)
    pipeline.save_model(spark, fv.FOREST, model, folder)
    files.save_model_tables({"encoder": encoder.table(spark)}, f"{folder}/models")
    features = files.write_table(stored_features(spark, sf_dir), f"{folder}/features.parquet")
    return spark.read.csv(pipeline.predict_times(spark, features, folder), header=True, inferSchema=True)


def diag_gap(spark, sf_dir):
    return diagnostics.train_test_gap(_split(spark, sf_dir, "age_group"), settings=QUICK)


def diag_redundancy(spark, sf_dir):
    return diagnostics.feature_redundancy(_split(spark, sf_dir), settings=QUICK)


def diag_complexity(spark, sf_dir):
    return diagnostics.complexity(_split(spark, sf_dir, "age_group"), settings=QUICK)


def diag_learning_curve(spark, sf_dir):
    return diagnostics.learning_curves(_split(spark, sf_dir, "age_group"), settings=QUICK)


def diag_permutation(spark, sf_dir):
    return diagnostics.permutation_test(_split(spark, sf_dir, "age_group"), settings=QUICK)


QUERIES = {
    f.__name__: f
    for f in (
        ingest_tsv_roundtrip, csv_roundtrip, select_rename, site_filter, sparse_site_filter,
        numeric_coerce, event_flag, observed_time, age_bands, stage_group, display_columns,
        recode_labels, value_replace, clean_feature_names, step_audit, features_without_time,
        audit_without_time, inner_join_fanout,
        feature_table, preview_top10,
        count_by_stage, count_by_site, counts_sorted_by_stage, distinct_stages,
        mortality_by_age_band, status_share, histogram_age, histogram_time_by_event, kde_age,
        median_time_by_event, km_global, km_by_stage, km_by_risk_group, km_median, km_event_gap,
        nelson_aalen, risk_terciles,
        onehot_encode, align_columns, signed_label, stratified_holdout, kfold_assign,
        subset_fraction, permute_labels, cindex_fixed_score, cindex_by_fold, fold_score_summary,
        cox_score_at_zero, cox_coefficients, cox_risk, hazard_ratios,
        boosted_grad_round1, boosted_root_gain, boosted_scores, importance_split_count, importance_gain,
        logrank_score, forest_risk, forest_curves, predicted_median,
        pdp_linear, ice_linear, permutation_importance_linear, permutation_importance_forest,
        pdp_boosted, ice_boosted, pdp_forest, ice_forest, top_features, model_comparison,
        km_by_best_model, split_snapshot, model_roundtrip, report_roundtrip, prediction_roundtrip,
        diag_gap, diag_redundancy, diag_complexity, diag_learning_curve, diag_permutation,
        cox_age_table, cox_age_risk, cox_age_effect, diag_gap_age, comparison_age, diag_learning_age,
        diag_permutation_age, boosted_stump_risk, boosted_stump_importance, forest_stump_risk,
        forest_stump_median, forest_stump_curves, comparison_stump, diag_redundancy_stump, diag_complexity_stump,
        diag_learning_stump, diag_permutation_stump, report_roundtrip_age, top_features_root, km_by_best_model_age,
        prediction_roundtrip_stump, diag_report_stump,
    )
}
