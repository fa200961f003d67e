import random

import dense
import numpy as np
import pytest

from hazardlake.operators import concordance as module
from hazardlake.operators.concordance import concordance, dominance, pair_counts

SCHEMA = "g int, observed_time double, event_occurred int, risk double"


def rows(seed, n, times, risks):
    rnd = random.Random(seed)
    return [
        (rnd.randint(0, 1), float(rnd.randint(1, times)), rnd.randint(0, 1), float(rnd.randint(1, risks)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed,times,risks,cuts", [
    (1, 5, 4, []), (2, 300, 200, [20.0, 21.0, 150.0]), (3, 40, 1, None), (4, 1, 30, [2.0]), (5, 70, 500, [1.5])
])
def test_equals_pairwise_count(spark, seed, times, risks, cuts):
    data = rows(seed, 160, times, risks)
    got = {r.g: (r.comparable, r.concordant, r.tied_risk) for r in pair_counts(
        spark.createDataFrame(data, SCHEMA), ["g"], risk_cuts=cuts, time_cuts=[3.0, 30.0]).collect()}
    for g in (0, 1):
        part = [r for r in data if r[0] == g]
        want = dense.concordance([r[2] for r in part], [r[1] for r in part], [r[3] for r in part])
        assert got[g] == want


def test_reversed_risk_complements(spark):
    df = spark.createDataFrame(rows(9, 120, 30, 25), SCHEMA)
    a = concordance(df).first().c_index
    b = concordance(df.selectExpr("observed_time", "event_occurred", "-risk as risk")).first().c_index
    c = concordance(df.selectExpr("observed_time", "event_occurred", "exp(risk / 10) as risk")).first().c_index
    assert abs(a + b - 1) < 1e-12 and abs(a - c) < 1e-12


def test_no_comparable_pair_is_null(spark):
    df = spark.createDataFrame([(0, 1.0, 0, 1.0), (0, 2.0, 0, 2.0)], SCHEMA)
    assert concordance(df).first().c_index is None
    both = spark.createDataFrame([(0, 1.0, 1, 1.0), (0, 1.0, 1, 2.0)], SCHEMA)
    assert concordance(both).first().c_index is None


def test_missing_risk_is_an_error(spark):
    df = spark.createDataFrame([(0, 1.0, 1, None), (0, 2.0, 0, 2.0)], SCHEMA)
    with pytest.raises(Exception, match="risk score is missing"):
        concordance(df).collect()


@pytest.mark.parametrize("seed,times,risks,part", [(1, 60, 50, 20), (2, 3, 80, 7), (3, 90, 2, 7), (4, 40, 40, 1)])
def test_pairs_of_all_ranges_and_blocks(spark, monkeypatch, seed, times, risks, part):
    monkeypatch.setattr(module, "ROWS_PER_PART", part)
    data = rows(seed, 160, times, risks) + [(None, float(k % 9), k % 2, float(k % 5)) for k in range(30)]
    got = {r.g: (r.comparable, r.concordant, r.tied_risk) for r in pair_counts(spark.createDataFrame(data, SCHEMA), ["g"]).collect()}
    assert set(got) == {0, 1, None}
    for g in got:
        part = [r for r in data if r[0] == g]
        assert got[g] == dense.concordance([r[2] for r in part], [r[1] for r in part], [r[3] for r in part])


def test_a_pair_is_no_row(spark):
    """Rows are counted where they lie, not once per digit of their time."""
    assert dominance(np.array([0, 3, 1]), np.array([2.0, 1.0, 2.0]), np.array([2, 0, 1]), np.array([2, 5, 1])) == (17.0, 15.0, 2.0)
    df = spark.createDataFrame(rows(7, 100, 50, 30), SCHEMA)
    assert "level" not in pair_counts(df, ["g"])._jdf.queryExecution().optimizedPlan().toString()
