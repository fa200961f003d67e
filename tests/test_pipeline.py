"""The batch entry points end to end on small raw files."""

import os

import pytest

from hazardlake.functions import fixed_values as fv
from hazardlake.plans import cohort, compare, pipeline

SETTINGS = {fv.FOREST: {"trees": 3, "max_depth": 2}, fv.BOOSTED: {"rounds": 2, "max_depth": 2}}


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    sf = "/root/testdata/sf0.001"
    raw = cohort.clinical_records(spark, sf).drop("row_id", "case_id")
    raw.write.csv(f"{folder}/clinical.tsv", sep="\t", header=True)
    cohort.sample_records(spark, sf).write.csv(f"{folder}/sample.tsv", sep="\t", header=True)
    features = pipeline.prepare(
        spark, f"{folder}/clinical.tsv", f"{folder}/sample.tsv", folder, cohort.SITES, cohort.SPARSE
    )
    return folder, features


def test_prepare(spark, prepared):
    folder, features = prepared
    table = spark.read.parquet(features)
    assert set(fv.FINAL_FEATURES) <= set(table.columns)
    assert table.select("row_id").distinct().count() == table.count() > 500
    audit = spark.read.csv(f"{folder}/reports/step_audit.csv", header=True, inferSchema=True)
    assert audit.orderBy("step_order").collect()[-1].rows_out == table.count()
    tables = pipeline.explore(table, folder, {s: s for s in cohort.SITES})
    assert all(os.path.exists(f"{folder}/reports/eda/{name}.csv/_SUCCESS") for name in tables)


def test_train_score_interpret(spark, prepared):
    folder, features = prepared
    result = pipeline.train(spark, features, folder, SETTINGS, folds=2)
    report = {r.model_name: r for r in result.report.collect()}
    assert set(report) == set(compare.MODELS) and result.best in report
    assert all(0 < r.test_c_index < 1 and 0 < r.cv_mean_c_index < 1 for r in report.values())
    assert report[result.best].test_c_index == max(r.test_c_index for r in report.values())

    name, _, encoder = pipeline.load_best(spark, folder)
    assert name == result.best and encoder.columns == result.encoder.columns

    path = pipeline.predict_times(spark, features, folder)
    predicted = spark.read.csv(path, header=True, inferSchema=True)
    assert predicted.count() == spark.read.parquet(features).count()
    assert {"OS", "OS_time", "predicted_survival_time"} <= set(predicted.columns)
    assert predicted.filter("predicted_survival_time is null").count() == 0

    # terciles need a score with many values, so take the Cox model as the best one
    spark.createDataFrame([(fv.COX,)], "model_name string").write.mode("overwrite").parquet(f"{folder}/models/best")
    curves = pipeline.curves_by_risk(spark, features, folder)
    assert {r[0] for r in curves.select("risk_group").distinct().collect()} == set(fv.RISK_LABELS)

    tables = pipeline.interpret(spark, result, folder, repeats=2)
    assert tables["hazard_ratios"].count() == len(encoder.columns)


def test_failed_fits_score_zero_and_are_left_out(spark, prepared):
    _, features = prepared
    table = spark.read.parquet(features).drop("case_id")
    holed = table.selectExpr(
        "row_id", "event_occurred", "observed_time", "if(row_id % 2 = 0, age_at_index, null) as age_at_index"
    )
    scores = compare.cross_validate(holed, folds=2, models=[fv.COX]).collect()
    assert [(r.model_name, r.c_index) for r in scores] == [(fv.COX, 0.0)] * 2


def test_row_ids_of_equal_rows(spark):
    """A third of the rows are equal: ids are unique and the same values give the same set of ids in any order."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, -1, id) as a", "if(id % 3 = 0, null, 'x') as `b.c`")
    one = sorted(tuple(r) for r in pipeline.with_row_id(rows).select("a", pipeline.ROW_ID).collect())
    other = sorted(tuple(r) for r in pipeline.with_row_id(rows.orderBy(rows.a.desc()).repartition(7)).select("a", pipeline.ROW_ID).collect())
    assert one == other and len({i for _, i in one}) == 3000 and all(i >= 0 for _, i in one)
