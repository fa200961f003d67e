"""Boosted rounds in one task against rounds in jobs, and the settings that registered queries fit with."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlake.functions import fixed_values as fv
from hazardlake.functions.scalars import hash_uniform
from hazardlake.operators import boosted, trees
from hazardlake.plans import catalog, compare
from hazardlake.session import materialize


class Seen(Exception):
    pass


def rounds_of(monkeypatch, query) -> list[int]:
    """Rounds of the boosted fit that a query asks for first."""
    found = []

    def fit(df, features, *args, rounds=fv.BOOSTED_SETTINGS["rounds"], **more):
        found.append(rounds)
        raise Seen

    def compared(split, *args, settings=None, **more):
        found.append((settings or {}).get(fv.BOOSTED, {}).get("rounds", fv.BOOSTED_SETTINGS["rounds"]))
        raise Seen

    class Encoder:
        columns = ["x"]

    monkeypatch.setattr(boosted, "fit_boosted", fit)
    monkeypatch.setattr(compare, "compare_models", compared)
    monkeypatch.setattr(catalog, "_train_rows", lambda *a: (Encoder, None, None))
    monkeypatch.setattr(catalog, "_split", lambda *a: None)
    with pytest.raises(Seen):
        query(None, "")
    return found


@pytest.mark.parametrize("name", ["importance_gain", "importance_split_count", "top_features", "model_comparison", "km_by_best_model", "report_roundtrip"])
def test_queries_fit_all_rounds(monkeypatch, name):
    assert rounds_of(monkeypatch, catalog.QUERIES[name]) == [200]


@pytest.mark.parametrize("seed", [42, -3, 1 << 40])
def test_draws_equal_sql(spark, seed):
    """Draws in a task are those of the SQL expression, for small and large counts and lists of codes of any length."""
    rng = np.random.default_rng(1)
    rows = [
        (sorted(set(rng.integers(0, 300, rng.integers(0, 5)).tolist())), t / 7 - 1, int(rng.integers(0, 2)), int(m))
        for t in range(60) for m in (1, 2, 3, 63, 64, 65, 128, 1000)
    ]
    sql = boosted.binomial_draw("m", 0.8, seed, 3, "codes", "t", "e")
    want = [r[0] for r in spark.createDataFrame(rows, "codes array<int>, t double, e int, m long").select(F.expr(sql)).collect()]
    codes, t, e, m = zip(*rows)
    times, at = np.unique(t, return_inverse=True)
    flat = np.array([c for own in codes for c in own], dtype=np.int64)
    held = trees.Codes(flat, np.repeat(np.arange(len(rows)), [len(c) for c in codes]), len(rows))
    counts = boosted.Counts(held, np.arange(len(rows)), times, at, np.array(e, dtype=np.int32), np.array(m))
    got = boosted.Draws(counts, 0.8, seed)
    assert [*got.of(slice(0, 100), 3), *got.of(slice(100, 500), 3)] == want


def test_rounds_in_a_task_equal_rounds_in_jobs(spark, monkeypatch):
    """Same trees both ways, for fits of different depth with missing values; chunks part the counts of a cell."""
    u = lambda k: hash_uniform(k, F.col("row_id"))
    rows = spark.range(1500).select(F.col("id").alias("row_id")).select(
        "row_id", F.when(u("n") > 0.1, F.round(u("x") * 9)).alias("x"), (u("y") < 0.4).cast("double").alias("y"),
        (u("e") < 0.7).cast("int").alias("event_occurred"), F.ceil(u("t") * 40 * (1 + u("x"))).cast("double").alias("observed_time"),
    ).withColumn("fit", F.explode(F.lit([3, 5]))).filter("fit = 3 or row_id % 3 = 0")
    rows = materialize(rows, "rows")
    options = {"rounds": 12, "max_depth": {3: 2, 5: 4}, "learning_rate": 0.3}
    monkeypatch.setattr(boosted, "CHUNK", 37)
    task = boosted.fit_boosted(rows, ["x", "y"], "fit", **options)
    monkeypatch.setattr(boosted, "HELD_COUNTS", 400)  # the larger fit in jobs, the smaller one in a task
    mixed = boosted.fit_boosted(rows, ["x", "y"], "fit", **options)
    monkeypatch.setattr(boosted, "HELD_COUNTS", 0)
    jobs = boosted.fit_boosted(rows, ["x", "y"], "fit", **options)
    key = lambda n: (n.fit, n.tree, n.node)
    assert {n.tree for n in task.nodes} == set(range(12)) and {n.fit for n in task.nodes} == {3, 5}
    for one, model in ((a, m) for m in (mixed, jobs) for a in [sorted(task.nodes, key=key)]):
        for a, b in zip(one, sorted(model.nodes, key=key), strict=True):
            assert (key(a), a.feature, a.split_bin, a.missing_right) == (key(b), b.feature, b.split_bin, b.missing_right)
            assert a.value == pytest.approx(b.value, rel=1e-9, abs=1e-12) and a.gain == pytest.approx(b.gain, rel=1e-6)


def test_odd_rows_go_to_jobs(spark):
    """Rows without time or event are worked on as before."""
    rows = [(float(i % 4), i % 2, float(i % 9 + 1)) for i in range(200)] + [(1.0, 1, None), (2.0, None, 3.0)]
    table = spark.createDataFrame(rows, "x double, event_occurred int, observed_time double")
    model = boosted.fit_boosted(table, ["x"], rounds=2, max_depth=2, subsample=1.0)
    assert {n.tree for n in model.nodes} == {0, 1} and all(np.isfinite(n.value) for n in model.nodes)
