"""The five diagnostics on simulated data with a known signal."""

import pytest
from pyspark.sql import functions as F

from hazardlake.functions import fixed_values as fv
from hazardlake.functions.scalars import hash_uniform, overfit_label
from hazardlake.operators import sampling
from hazardlake.plans import catalog, compare, diagnostics, pipeline
from hazardlake.session import materialize

QUICK = {fv.FOREST: {"trees": 3, "max_depth": 2}, fv.BOOSTED: {"rounds": 2, "max_depth": 2, "subsample": 1.0}}


@pytest.fixture(scope="module")
def split(spark):
    u = lambda k: hash_uniform(k, F.col("row_id"))
    stage = F.when(u("s") < 0.5, "Stage I").otherwise("Stage IV")
    rows = spark.range(600).withColumnRenamed("id", "row_id").select(
        "row_id", (u("a") * 60 + 30).alias("age_at_index"), stage.alias("ajcc_pathologic_stage"),
        F.when(u("a") < 0.5, "Jovens").otherwise("Idosos").alias("age_group"),
    )
    hazard = F.exp(0.03 * (F.col("age_at_index") - 60) + F.when(F.col("ajcc_pathologic_stage") == "Stage IV", 2.0).otherwise(0.0))
    timed = rows.withColumns({
        "observed_time": F.round(-F.log(u("t")) / hazard * 3, 2) + 0.01, "event_occurred": (u("c") < 0.7).cast("int"),
    })
    return materialize(sampling.stratified_holdout(timed), "split")


def rows(table, *keys):
    return {tuple(r[k] for k in keys): r for r in table.collect()}


def test_gap(split):
    got = rows(diagnostics.train_test_gap(split, settings=QUICK), "model_name")
    assert set(got) == {(m,) for m in compare.MODELS}
    for r in got.values():
        assert 0.6 < r.c_index_train <= 1 and r.gap == pytest.approx(r.c_index_train - r.c_index_test)


def test_overfit_label(spark):
    frame = spark.createDataFrame([(-0.1,), (0.0,), (0.5,)], "gap double")
    labels = [r[0] for r in frame.select(overfit_label(F.col("gap"))).collect()]
    assert labels[0] == labels[1] != labels[2]


def test_redundancy(split):
    got = rows(diagnostics.feature_redundancy(split, models=[fv.COX], settings=QUICK), "configuration", "model_name")
    assert len(got) == 2 and len({k[0].split()[0] for k in got}) == 2
    # the age group adds nothing to the age itself
    a, b = (r.c_index_test for r in got.values())
    assert abs(a - b) < 0.05


def test_complexity(split):
    got = rows(diagnostics.complexity(split, depths=[1, 2], settings={fv.BOOSTED: {"rounds": 2}}), "max_depth")
    assert set(got) == {(1,), (2,)} and all(0.5 < r.c_index_test <= 1 for r in got.values())


def test_learning_curves(split):
    n = split.filter("split = 'train'").count()
    got = rows(diagnostics.learning_curves(split, [0.05, 0.5, 1.0], [fv.BOOSTED], QUICK), "fraction")
    assert set(got) == {(0.5,), (1.0,)} and got[0.5,].n_rows == int(n * 0.5) and got[1.0,].n_rows == n
    # the whole training set gives what a single fit gives
    features, table = diagnostics._encode(split)
    train = table.filter("split = 'train'")
    alone = diagnostics._train_test(
        diagnostics._tagged(compare.score_model(compare.fit_model(fv.BOOSTED, train, features, None, QUICK), table), model_name="m"), ["model_name"]
    ).first()
    assert got[1.0,].c_index_test == pytest.approx(alone.c_index_test) and got[1.0,].c_index_train == pytest.approx(alone.c_index_train)


def test_permutation_and_failures(split, monkeypatch):
    got = diagnostics.permutation_test(split, 2, [fv.BOOSTED], QUICK).first()
    assert got.c_index_real > 0.65 and got.difference == pytest.approx(got.c_index_real - got.c_index_random_mean)
    fit = diagnostics.fit_model
    scores = {}

    def failing(name, df, features, fit_col=None, settings=None):
        keys = {r[0] for r in df.select(fit_col).distinct().collect()}
        if 2 in keys:
            raise ArithmeticError("no convergence")
        scores[tuple(sorted(keys))] = True
        return fit(name, df, features, fit_col, settings)

    monkeypatch.setattr(diagnostics, "fit_model", failing)
    hurt = diagnostics.permutation_test(split, 2, [fv.BOOSTED], QUICK).first()
    assert scores == {(0,): True, (1,): True}
    # repeat 1 keeps its score, repeat 2 counts 0.5
    one = 2 * hurt.c_index_random_mean - 0.5
    assert hurt.c_index_real == pytest.approx(got.c_index_real) and 0.3 < one < 0.8

    def lost(*args, **more):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(diagnostics, "fit_model", lost)
    with pytest.raises(RuntimeError):
        diagnostics.permutation_test(split, 1, [fv.BOOSTED], QUICK)


def test_report_files(split, tmp_path):
    settings = {fv.FOREST: {"trees": 1, "max_depth": 1}, fv.BOOSTED: {"rounds": 1, "max_depth": 1}}
    tables = pipeline.diagnose(split, str(tmp_path), settings)
    assert set(tables) == {"gap", "redundancy", "complexity", "learning_curves", "permutation"}
    for name, table in tables.items():
        back = split.sparkSession.read.csv(f"{tmp_path}/reports/diagnostics/{name}.csv", header=True)
        assert back.columns == table.columns and back.count() > 0


def test_registered_complexity_has_every_depth(spark):
    table = catalog.diag_complexity(spark, "/root/testdata/sf0.001")
    assert sorted(r.max_depth for r in table.collect()) == [3, 5, 7, 10]


def test_depths_grow_together_as_alone(spark):
    """Every depth of the joint fit equals a fit of its own."""
    split = catalog._split(spark, "/root/testdata/sf0.001", "age_group")
    options = {fv.BOOSTED: {"rounds": 2, "max_bins": 16}}
    joint = {r.max_depth: r.c_index_train for r in diagnostics.complexity(split, (1, 4), options).collect()}
    for depth in (1, 4):
        alone = diagnostics.complexity(split, (depth,), options).first()
        assert alone.max_depth == depth and abs(alone.c_index_train - joint[depth]) < 1e-12
