import math
import random

import pytest
from pyspark.sql import functions as F

from hazardlake.operators import eda, km, prefix, risk
from hazardlake.plans import cohort


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, observed_time double, event_occurred int")


def test_edge_curves(spark):
    rows = [("censored", float(t), 0) for t in (1, 2, 3)]
    rows += [("dies", 1.0, 1), ("dies", 2.0, 1), ("dies", 2.0, 1)]
    rows += [("single", 4.0, 1)]
    curve = km.kaplan_meier(frame(spark, rows), ["g"]).collect()
    by = {}
    for r in curve:
        by.setdefault(r.g, []).append(r)
    assert all(r.survival == 1 and r.ci_lower == 1 for r in by["censored"]) and len(by["censored"]) == 4
    last = max(by["dies"], key=lambda r: r.t)
    assert last.survival == 0 and last.ci_lower is None
    assert [(r.t, r.survival) for r in sorted(by["single"], key=lambda r: r.t)] == [(0.0, 1.0), (4.0, 0.0)]
    medians = {r.g: r.median_time for r in km.median_survival(
        km.kaplan_meier(frame(spark, rows), ["g"]), ["g"]).collect()}
    assert medians == {"censored": 3.0, "dies": 2.0, "single": 4.0}


def test_half_exactly_is_the_median(spark):
    rows = [("x", 1.0, 1), ("x", 2.0, 0)]
    assert km.median_survival(km.kaplan_meier(frame(spark, rows))).first().median_time == 1.0


def test_small_strata_are_left_out(spark):
    rows = [("ten", float(i), 1) for i in range(1, 11)] + [("eleven", float(i), 1) for i in range(1, 12)]
    curve = km.kaplan_meier(frame(spark, rows), ["g"], min_rows=10)
    assert {r.g for r in curve.select("g").distinct().collect()} == {"eleven"}


def test_buckets_change_nothing(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), round(rnd.random() * 30, 1), rnd.randint(0, 1)) for _ in range(500)]
    df = frame(spark, rows)
    plain = sorted(map(tuple, km.kaplan_meier(df, ["g"], cuts=None).collect()))
    cut = sorted(map(tuple, km.kaplan_meier(df, ["g"], cuts=[3.0, 7.0, 7.1, 22.0]).collect()))
    assert len(plain) == len(cut)
    for a, b in zip(plain, cut):
        assert a[:2] == b[:2]
        assert all((x is None and y is None) or math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a[2:], b[2:]))
    survival = [r[5] for r in plain if r[0] == "a"]
    assert all(0 <= y <= x <= 1 for x, y in zip(survival, survival[1:]))


def test_cut_points_bound_the_buckets(spark):
    df = spark.range(10_000).select((F.col("id") / 7).alias("x"))
    cuts = prefix.cut_points(df, "x", rows_per_bucket=1000)
    sizes = [r["count"] for r in prefix.with_bucket(df, "x", cuts).groupBy("__bucket").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 2000


def test_next_value_with_buckets(spark):
    rows = [(u, float(v)) for u, v in {(random.Random(i).choice("pq"), (i * 37) % 501) for i in range(300)}]
    df = spark.createDataFrame(rows, "u string, v double")
    a = sorted(map(str, prefix.next_value(df, ["u"], "v", "n").collect()))
    b = sorted(map(str, prefix.next_value(df, ["u"], "v", "n", [50.0, 51.0, 300.0]).collect()))
    assert a == b


def test_exact_quantiles_with_buckets(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.choice("ab"), rnd.gauss(0, 1)) for _ in range(301)], "g string, x double")
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.3)).alias("q")).collect()}
    got = {r.g: r.q for r in prefix.exact_quantiles(df, "x", {"q": 0.3}, ["g"], [-1.0, 0.0, 0.1]).collect()}
    assert all(math.isclose(want[g], got[g], rel_tol=1e-12) for g in want)


def test_terciles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 8)], "risk double")
    got = [r.risk_group for r in risk.risk_groups(df).orderBy("risk").collect()]
    assert got == ["baixo"] * 3 + ["médio"] * 2 + ["alto"] * 2  # 3.0 and 5.0 lie on an edge
    with pytest.raises(ValueError):
        risk.risk_groups(spark.createDataFrame([(1.0,)] * 5, "risk double"))


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    rows = eda.histogram(df, "x", bins=4).orderBy("bin").collect()
    assert [r.n for r in rows] == [0, 0, 2, 0] and rows[0].bin_lo == 1.5 and rows[-1].bin_hi == 2.5


def test_status_share_lists_both_classes(spark):
    df = spark.createDataFrame([(1,), (1,)], "event_occurred int")
    assert [(r.n, r.pct) for r in eda.status_share(df).orderBy("event_occurred").collect()] == [(0, 0.0), (2, 100.0)]


def test_cohort_medians(spark):
    df = cohort.features(spark, "/root/testdata/sf0.001")
    curves = km.kaplan_meier(df, ["ajcc_pathologic_stage"], band=False, cuts=None)
    got = {r[0]: round(r.median_time * 365.25) for r in km.median_survival(curves, ["ajcc_pathologic_stage"]).collect()}
    assert got == {"Stage I": 184, "Stage II": 170, "Stage III": 223, "Stage IV": 282}
