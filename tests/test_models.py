"""Models against dense NumPy oracles and on simulated data with a known signal."""

import dense
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardlake.functions.scalars import hash_uniform
from hazardlake.operators import boosted, cox, encoding, explain, forest, trees
from hazardlake.operators.concordance import concordance
from hazardlake.operators.sampling import permute
from hazardlake.session import materialize

EFFECT = {"Stage I": 0.0, "Stage II": 0.5, "Stage III": 1.0, "Stage IV": 1.8}
QUICK_FOREST = {"trees": 10, "max_depth": 5, "max_bins": 32}
QUICK_BOOST = {"rounds": 8, "max_depth": 3, "learning_rate": 0.3, "max_bins": 32}


@pytest.fixture(scope="module")
def simulated(spark):
    """Weibull times, log-hazard 0.03 (age - 60) + stage effect, about 30 % censored."""
    u = lambda k: hash_uniform(k, F.col("id"))
    stage = F.element_at(F.array(*map(F.lit, EFFECT)), (F.floor(u("stage") * 4) + 1).cast("int"))
    df = spark.range(3000).select(
        F.col("id").alias("row_id"), (40 + 40 * u("age")).alias("age_at_index"),
        stage.alias("ajcc_pathologic_stage"), u("time").alias("ut"), u("cens").alias("uc"),
    )
    effect = F.element_at(F.create_map(*[F.lit(x) for kv in EFFECT.items() for x in kv]), F.col("ajcc_pathologic_stage"))
    t = F.pow(-F.ln("ut") / F.exp(0.03 * (F.col("age_at_index") - 60) + effect), F.lit(1 / 1.2)) * 3
    c = F.col("uc") * 9
    timed = df.withColumn("true", t).withColumn("c", c)
    return materialize(timed.select(
        "row_id", "age_at_index", "ajcc_pathologic_stage",
        (F.col("true") <= F.col("c")).cast("int").alias("event_occurred"),
        (F.ceil(F.least("true", "c") * 50) / 50.0).cast("double").alias("observed_time"),
    ), "simulated")


@pytest.fixture(scope="module")
def encoded(simulated):
    encoder = encoding.fit_encoder(simulated, encoding.feature_roles(simulated))
    return encoder.columns, materialize(encoder.transform(simulated, ["row_id", "event_occurred", "observed_time"]), "enc")


@pytest.fixture(scope="module")
def cox_model(encoded):
    return cox.fit_cox(encoded[1], encoded[0])


@pytest.fixture(scope="module")
def forest_model(encoded):
    return forest.fit_forest(encoded[1], encoded[0], **QUICK_FOREST)


@pytest.fixture(scope="module")
def boosted_model(encoded):
    return boosted.fit_boosted(encoded[1], encoded[0], **QUICK_BOOST)


def c_index(df):
    return concordance(df).first().c_index


def test_cox_equals_dense_fit(encoded, cox_model):
    columns, table = encoded
    pdf = table.toPandas()
    beta, se = dense.cox(pdf[columns].values, pdf.observed_time.values, pdf.event_occurred.values)
    assert np.allclose(cox_model.coef[None], beta, atol=1e-8) and np.allclose(cox_model.se[None], se, atol=1e-7)
    assert all(b > 0 for b in beta) and list(beta[1:]) == sorted(beta[1:])
    assert c_index(table.withColumn("risk", cox_model.risk())) > 0.65


def test_cox_with_many_ties(spark, encoded):
    columns, table = encoded
    coarse = table.withColumn("observed_time", F.ceil("observed_time").cast("double"))
    model = cox.fit_cox(coarse, columns)
    pdf = coarse.toPandas()
    beta, se = dense.cox(pdf[columns].values, pdf.observed_time.values, pdf.event_occurred.values)
    assert pdf[pdf.event_occurred == 1].groupby("observed_time").size().max() > 100
    assert np.allclose(model.coef[None], beta, atol=1e-8) and np.allclose(model.se[None], se, atol=1e-7)


def test_tie_sums(spark):
    cases = [(1.0, 1), (5.0, 5), (16.0, 16), (17.5, 17), (40.0, 40), (1e6, 300), (5000.0, 5000)]
    df = spark.createDataFrame([(z, float(d)) for z, d in cases], "z double, d double")
    got = df.selectExpr("z", "d", *[f"{e} as s{i}" for i, e in enumerate(cox.tie_sums("z", "d"))]).collect()
    for r in got:
        x = r.z - np.arange(int(r.d))
        for value, want in ((r.s0, (1 / x).sum()), (r.s1, (1 / x**2).sum()), (r.s2, np.log(x).sum())):
            assert abs(value - want) <= 1e-11 * max(1.0, abs(want))


@pytest.mark.parametrize("cells, chunk, slab, fan", [(1 << 22, 32, 1 << 17, 64), (700, 2, 5, 2)])
def test_blocked_cox_equals_dense_fit(monkeypatch, encoded, cells, chunk, slab, fan):
    """Blocks of time and matrix products give the fit of the sums per column, also with a time in several parts."""
    for name, value in (("WIDE", 0), ("BLOCK_CELLS", cells), ("CHUNK", chunk), ("SLAB_CELLS", slab), ("FAN_IN", fan)):
        monkeypatch.setattr(cox, name, value)
    columns, table = encoded
    tied = table.withColumn("observed_time", F.when(F.col("row_id") % 4 == 0, 2.0).otherwise(F.ceil(F.col("observed_time") * 4) / 4))
    model = cox.fit_cox(tied, columns)
    pdf = tied.toPandas()
    beta, se = dense.cox(pdf[columns].values, pdf.observed_time.values, pdf.event_occurred.values)
    assert np.allclose(model.coef[None], beta, atol=1e-8) and np.allclose(model.se[None], se, atol=1e-7)
    monkeypatch.setattr(cox, "WIDE", 50)
    plain = cox.fit_cox(tied, columns)
    assert model.log_likelihood[None] == pytest.approx(plain.log_likelihood[None], rel=1e-9)
    scored = tied.select("row_id", model.risk().alias("a"), plain.risk().alias("b"))
    assert scored.filter("abs(a - b) > 1e-6").count() == 0


def test_cox_with_many_columns(spark):
    """A thousand columns, two of them with an effect."""
    x = [(hash_uniform(f"x{j}", F.col("id")) - 0.5).alias(f"x{j}") for j in range(1000)]
    rows = materialize(spark.range(2000).select("id", *x), "wide")
    time = -F.ln(hash_uniform("t", F.col("id"))) / F.exp(3 * F.col("x7") - 2 * F.col("x500"))
    table = rows.withColumn("observed_time", time).withColumn("event_occurred", (hash_uniform("e", F.col("id")) < 0.8).cast("int"))
    names = [f"x{j}" for j in range(1000)]
    model = cox.fit_cox(table, names)
    order = np.argsort(-np.abs(model.coef[None]))
    assert set(order[:2].tolist()) == {7, 500} and model.coef[None][7] > 0 > model.coef[None][500]
    assert np.isfinite(model.se[None]).all()
    assert c_index(table.withColumn("risk", model.risk()).select("observed_time", "event_occurred", "risk")) > 0.7


@pytest.mark.parametrize("wide", [0, 50])
def test_cox_survives_large_predictors(spark, monkeypatch, wide):
    """Predictors far outside the range of exp: a column with an outlier, which a Newton step overshoots."""
    monkeypatch.setattr(cox, "WIDE", wide)
    problem = (cox._WideProblem if wide == 0 else cox._Problem)(spark.createDataFrame(
        [(float(i + 1), i % 2, float(i), float(i * i % 7)) for i in range(40)], "observed_time double, event_occurred int, a double, b double"
    ), ["a", "b"], None)
    for size in (1.0, 2000.0):
        beta = {0: np.array([size, -size / 3])}
        sets = problem.risk_sets(beta).persist()
        logs, expected, outer = problem.first_order(sets)[0]
        assert np.isfinite(logs) and np.isfinite(expected).all() and np.isfinite(outer).all()


def test_cox_rejects_missing_values(spark, encoded):
    columns, table = encoded
    holed = table.withColumn("age_at_index", F.when(F.col("row_id") > 5, F.col("age_at_index")))
    with pytest.raises(ValueError, match="age_at_index"):
        cox.fit_cox(holed, columns)


def test_keyed_cox_equals_single_fits(spark, encoded):
    columns, table = encoded
    copies = table.withColumn("fit", F.explode(F.lit([0, 1]))).filter("fit = 0 or row_id % 3 > 0")
    both = cox.fit_cox(copies, columns, "fit")
    alone = cox.fit_cox(table.filter("row_id % 3 > 0"), columns)
    assert np.allclose(both.coef[1], alone.coef[None], atol=1e-9)
    scored = both.score(copies.filter("fit = 1"), "fit").select("row_id", F.col("risk").alias("a"))
    again = table.select("row_id", alone.risk().alias("b"))
    assert scored.join(again, "row_id").filter("abs(a - b) > 1e-8").count() == 0


def test_boosted_gradients_match_finite_differences(spark):
    rng = np.random.default_rng(4)
    t, e, f = rng.integers(1, 6, 12).astype(float), rng.integers(0, 2, 12), rng.normal(size=12)

    def loss(m):
        return -sum(m[i] - np.log(np.exp(m[t >= t[i]]).sum()) for i in range(12) if e[i])

    df = spark.createDataFrame([(i, float(t[i]), int(e[i]), float(f[i])) for i in range(12)],
                               "row_id int, observed_time double, event_occurred int, margin double")
    rows = boosted.gradients(df).orderBy("row_id").collect()
    for i, r in enumerate(rows):
        step = np.zeros(12)
        step[i] = 1e-4
        assert abs(r.gradient - (loss(f + step) - loss(f - step)) / 2e-4) < 1e-6
        assert abs(r.curvature - (loss(f + step) - 2 * loss(f) + loss(f - step)) / 1e-8) < 1e-4


def codes_of(binner, bins):
    """Codes of a row of bins; -1 is a missing value."""
    return [int(base + max(b, 0)) for base, b in zip(binner.bases, bins) if b]


@pytest.mark.parametrize("entries", [10**9, 150])
def test_tree_takes_the_best_split(spark, monkeypatch, entries):
    rng = np.random.default_rng(1)
    bins = np.column_stack([rng.integers(-1, 6, 400), rng.integers(0, 2, 400)])
    g, h = rng.normal(size=400) + (bins[:, 0] >= 3), rng.random(400) + 0.1
    binner = trees.Binner(["a", "b"], [[1.0] * 5, [1.0]])
    rows = [(0, codes_of(binner, b), float(a), float(c)) for b, a, c in zip(bins, g, h)]
    df = spark.createDataFrame(rows, "fit int, codes array<int>, g double, h double")
    monkeypatch.setattr(trees, "ENTRIES", entries)
    nodes = trees.grow(df, binner, {0: sum(len(r[1]) + 1 for r in rows)}, 2, 0.1, 0.0, 1.0)

    def best(mask):
        out = (-1, None)
        for j in range(2):
            x, miss = bins[mask, j], bins[mask, j] == -1
            for cut in range(0, 7):
                for miss_right in (False, True):
                    right = np.where(miss, miss_right, x >= cut) if cut else miss
                    hr, gr = h[mask][right].sum(), g[mask][right].sum()
                    hl, gl = h[mask].sum() - hr, g[mask].sum() - gr
                    if hr < 1 or hl < 1:
                        continue
                    gain = gr**2 / (hr + 0.1) + gl**2 / (hl + 0.1) - (gr + gl) ** 2 / (hr + hl + 0.1)
                    if gain > out[0] + 1e-12:
                        out = (gain, right)
        return out

    by = {n.node: n for n in nodes}
    every = np.ones(400, bool)
    gain, right = best(every)
    assert abs(by[0].gain - gain) < 1e-9
    sub = every.copy()
    sub[every] = right
    assert abs(by[2].gain - best(sub)[0]) < 1e-9
    low = every.copy()
    low[every] = ~right
    assert abs(by[1].gain - best(low)[0]) < 1e-9
    # the ensemble sends every row to the leaf whose sums it is part of
    bases, used, packed = trees.Ensemble(nodes, binner).fits[0]
    flat = [r[1] for r in rows]
    codes = trees.Codes(np.concatenate(flat), np.repeat(np.arange(400), [len(c) for c in flat]), 400)
    at = packed[0][6][trees.leaf_of(packed[0], trees.dense(codes, bases, used))]
    for n in nodes:
        if n.feature < 0:
            assert abs(g[at == n.node].sum() - n.g) < 1e-9 and abs(h[at == n.node].sum() - n.h) < 1e-9


def test_models_find_the_signal(encoded, forest_model, boosted_model):
    _, table = encoded
    assert c_index(forest_model.score(table)) > 0.65
    assert c_index(boosted_model.score(table)) > 0.65


def test_shuffled_labels_carry_no_signal(encoded):
    columns, table = encoded
    model = cox.fit_cox(permute(table, ["event_occurred", "observed_time"], 1), columns)
    assert abs(c_index(table.withColumn("risk", model.risk())) - 0.5) < 0.1


def test_forest_curves_and_medians(encoded, forest_model):
    _, table = encoded
    rows, curves = forest_model.curves(table)
    curve = curves.orderBy("curve_id", "t").toPandas()
    for _, c in curve.groupby("curve_id"):
        assert (c.survival.diff().dropna() <= 1e-12).all() and c.survival.between(0, 1).all()
    last = max(forest_model.last_time.values())
    want = {k: (c.t[c.survival <= forest.HALF].min() if (c.survival <= forest.HALF).any() else last)
            for k, c in curve.groupby("curve_id")}
    ids = {r.row_id: r.curve_id for r in rows.select("row_id", "curve_id").collect()}
    got = forest_model.median_time(table).select("row_id", "predicted_survival_time").collect()
    assert len(got) == 3000 and all(abs(r[1] - want[ids[r[0]]]) < 1e-12 for r in got)


def test_forest_leaf_risk_is_summed_hazard(encoded, forest_model):
    drops = forest_model.drops.toPandas()
    columns, table = encoded
    times = np.sort(table.filter("event_occurred = 1").select("observed_time").distinct().toPandas().observed_time)
    leaf = [n for n in forest_model.nodes if n.feature < 0][0]
    own = drops[(drops.tree == leaf.tree) & (drops.node == leaf.node)]
    want = sum(own.hazard_step[own.t <= t].sum() for t in times)
    assert abs(leaf.value - want) < 1e-9 * max(1, want)


def test_poisson_draws_have_the_right_moments():
    key = np.arange(20_000) * 7919
    for m in (1, 7, 16, 17, 80, 5000):
        w = forest.poisson_draws(key, np.full(len(key), m), 3, 42)
        assert abs(w.mean() - m) < 5 * (m / len(key)) ** 0.5 and abs(w.var() - m) < 0.08 * m
    mixed = forest.poisson_draws(key, np.where(key % 2, 1, 40), 3, 42)
    assert (mixed[key % 2 == 1] == forest.poisson_draws(key, np.full(len(key), 1), 3, 42)[key % 2 == 1]).all()
    one, other = (forest.poisson_draws(key, np.full(len(key), 1), t, 42) for t in (0, 1))
    assert abs(np.corrcoef(one, other)[0, 1]) < 0.03


def test_saved_models_score_the_same(spark, encoded, forest_model, boosted_model, cox_model, tmp_path):
    from hazardlake.sources import files

    _, table = encoded
    for model, kind in ((forest_model, forest.ForestModel), (boosted_model, boosted.BoostedModel)):
        folder = str(tmp_path / kind.__name__)
        files.save_model_tables(model.tables(spark), folder)
        back = kind.from_tables(files.load_model_tables(spark, folder, list(model.tables(spark))))
        a = {r.row_id: r.risk for r in model.score(table).collect()}
        b = {r.row_id: r.risk for r in back.score(table).collect()}
        assert a == b
    again = cox.CoxModel.from_table(cox_model.table(spark))
    assert np.allclose(again.coef[None], cox_model.coef[None])


def test_importance_and_dependence(spark, encoded, boosted_model):
    columns, table = encoded
    gain = boosted_model.importance(spark, "gain")
    assert explain.top_features(gain, 1)[0] in ("ajcc_pathologic_stage_Stage IV", "age_at_index")
    scorer = lambda d, replace: boosted_model.margin(d, "risk", replace=replace)
    pdp = explain.partial_dependence(table, scorer, columns, ["ajcc_pathologic_stage_Stage IV"]).orderBy("value").collect()
    assert [r.value for r in pdp] == [0.0, 1.0] and pdp[1].mean_prediction > pdp[0].mean_prediction
    ice = explain.individual_curves(table, scorer, columns, ["ajcc_pathologic_stage_Stage IV"], rows=7)
    assert ice.count() == 14
    lost = explain.permutation_importance(table, scorer, columns, repeats=2).collect()
    assert lost[0].importance_mean > 0.02 and {r.feature for r in lost} == set(columns)


def test_bucketed_windows_change_no_model(monkeypatch, encoded, cox_model, forest_model, boosted_model):
    """Force the path for unbounded times and cells: cut points everywhere, no broadcasts."""
    from hazardlake.operators import concordance as cc
    from hazardlake.operators import km, prefix

    def small(df, order, rows_per_bucket=None):
        return prefix.cut_points(df, order, 40)

    for module in (cox, boosted, forest, km, cc):
        monkeypatch.setattr(module, "cut_points", small)
    for module in (boosted, forest):
        monkeypatch.setattr(module, "BROADCAST_CELLS", 10)
    monkeypatch.setattr(cox, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(cc, "BROADCAST_TIMES", 10)
    columns, table = encoded
    again = cox.fit_cox(table, columns)
    assert np.allclose(again.coef[None], cox_model.coef[None], atol=1e-9)
    grown = boosted.fit_boosted(table, columns, **(QUICK_BOOST | {"rounds": 2}))
    first = [n for n in boosted_model.nodes if n.tree < 2]
    key = lambda n: (n.tree, n.node)
    for a, b in zip(sorted(grown.nodes, key=key), sorted(first, key=key), strict=True):
        assert (a.feature, a.split_bin) == (b.feature, b.split_bin) and abs(a.value - b.value) < 1e-9
    trees_again = forest.fit_forest(table, columns, **QUICK_FOREST)
    for a, b in zip(sorted(trees_again.nodes, key=key), sorted(forest_model.nodes, key=key), strict=True):
        assert (a.feature, a.split_bin) == (b.feature, b.split_bin) and abs(a.value - b.value) < 1e-8
    assert abs(c_index(trees_again.score(table)) - c_index(forest_model.score(table))) < 1e-9


def _biased(table):
    """Two training sets whose ages lie far apart, so that shared cut points would show."""
    copies = table.withColumn("fit", F.explode(F.lit([0, 1]))).filter("fit = 0 or age_at_index > 60")
    return copies, table.filter("age_at_index > 60")


def test_joint_boosted_equals_single_fit(spark, encoded):
    columns, table = encoded
    copies, alone = _biased(table)
    options = {"rounds": 2, "max_depth": 2, "max_bins": 16, "subsample": 0.7}
    joint = boosted.fit_boosted(copies, columns, "fit", **options)
    single = boosted.fit_boosted(alone, columns, **options)
    a = joint.score(alone.withColumn("fit", F.lit(1)), "a", "fit").select("row_id", "a")
    b = single.score(alone, "b").select("row_id", "b")
    assert a.join(b, "row_id").filter("abs(a - b) > 1e-8").count() == 0


def test_joint_forest_equals_single_fit(spark, encoded):
    columns, table = encoded
    copies, alone = _biased(table)
    options = {"trees": 3, "max_depth": 2, "max_bins": 16}
    joint = forest.fit_forest(copies, columns, "fit", **options)
    single = forest.fit_forest(alone, columns, **options)
    a = joint.score(alone.withColumn("fit", F.lit(1)), "a", "fit").select("row_id", "a")
    b = single.score(alone, "b").select("row_id", "b")
    assert a.join(b, "row_id").filter("abs(a - b) > 1e-6").count() == 0


def test_binomial_draws(spark):
    """Draws have the share's mean and variance, for single rows and large counts alike."""
    for m, share in ((1, 0.02), (1, 0.99), (60, 0.3), (5000, 0.25)):
        draw = boosted.binomial_draw("m", share, 3, 1, "id")
        got = spark.range(20000).selectExpr("id", f"{m} as m").selectExpr(f"{draw} as k").agg(F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
        spread = m * share * (1 - share)
        assert abs(got[0] - m * share) < 5 * (spread / 20000) ** 0.5 + 1e-9
        assert abs(got[1] / spread - 1) < 0.12 and got[2] >= 0 and got[3] <= m


def test_logrank_split_of_a_node(monkeypatch):
    """The best split agrees with the log-rank test worked out over all cuts, time by time."""
    rng = np.random.default_rng(3)
    n = 300
    bins = np.column_stack([rng.integers(-1, 5, n), rng.integers(0, 2, n)])
    t, e = rng.integers(1, 12, n) + 3 * (bins[:, 0] >= 3), rng.integers(0, 2, n)
    w = rng.integers(1, 4, n)

    def logrank(right):
        u = v = 0.0
        for at in np.unique(t[e == 1]):
            risk, dead = t >= at, (t == at) & (e == 1)
            a, r, d = w[risk].sum(), w[risk & right].sum(), w[dead].sum()
            if a > 1:
                u += w[dead & right].sum() - d * r / a
                v += d * (r / a) * (1 - r / a) * (a - d) / (a - 1)
        return u * u / v if v > 0 else -1

    best = (-1, None)
    for j in range(2):
        miss = bins[:, j] == -1
        for cut in range(1, 6):
            for missing_right in (False, True):
                right = np.where(miss, missing_right, bins[:, j] >= cut)
                if min(w[right].sum(), w[~right].sum()) >= 5:
                    best = max(best, (logrank(right), (j, cut, missing_right)), key=lambda x: x[0])
    binner = trees.Binner(["a", "b"], [[1.0] * 4, [1.0]])
    order = np.argsort(t, kind="stable")
    flat = [codes_of(binner, bins[i]) for i in order]
    codes = trees.Codes(np.concatenate(flat).astype(int), np.repeat(np.arange(n), [len(c) for c in flat]), n)
    for cells in (1 << 20, 8):
        monkeypatch.setattr(forest, "CELLS", cells)
        got = forest.logrank_split(codes, t[order], e[order], w[order], binner.bases, 5.0, 2, 1, 0, 0)
        assert got.gain == pytest.approx(best[0]) and tuple(got[:3]) == best[1]


def test_large_nodes_split_like_small_ones(monkeypatch, encoded):
    """Trees grown from blocks of time, to different depths, equal those that one task grows."""
    columns, table = encoded
    missing = table.withColumn("age_at_index", F.when(F.col("row_id") % 9 > 0, F.col("age_at_index")))
    # a third of all rows shares one time
    table = missing.withColumn("observed_time", F.when(F.col("row_id") % 3 == 0, 2.0).otherwise(F.col("observed_time")))
    options = {"trees": 3, "max_depth": 3, "max_bins": 24}
    small = forest.fit_forest(table, columns, **options)
    key = lambda n: (n.tree, n.node)
    wanted = {r[:4]: r[4:] for r in map(tuple, small.drops.collect())}
    for entries, block in ((2500, 400), (0, 150)):
        monkeypatch.setattr(trees, "ENTRIES", entries)
        monkeypatch.setattr(forest, "BLOCK_ROWS", block)
        wide = forest.fit_forest(table, columns, **options)
        for a, b in zip(sorted(wide.nodes, key=key), sorted(small.nodes, key=key), strict=True):
            assert (a.feature, a.split_bin, a.missing_right, a.h) == (b.feature, b.split_bin, b.missing_right, b.h)
            assert a.gain == pytest.approx(b.gain, rel=1e-6) and a.value == pytest.approx(b.value, rel=1e-9)
        found = {r[:4]: r[4:] for r in map(tuple, wide.drops.collect())}
        assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_large_boosted_nodes_split_like_small_ones(monkeypatch, encoded):
    columns, table = encoded
    copies = table.withColumn("fit", F.explode(F.lit([0, 1]))).filter("fit = 0 or row_id % 3 = 0")
    options = {"rounds": 2, "max_depth": 5, "max_bins": 32, "learning_rate": 0.3}
    small = boosted.fit_boosted(copies, columns, "fit", **options)
    monkeypatch.setattr(trees, "ENTRIES", 700)
    wide = boosted.fit_boosted(copies, columns, "fit", **options)
    key = lambda n: (n.fit, n.tree, n.node)
    for a, b in zip(sorted(wide.nodes, key=key), sorted(small.nodes, key=key), strict=True):
        assert (a.feature, a.split_bin, a.missing_right) == (b.feature, b.split_bin, b.missing_right)
        assert a.value == pytest.approx(b.value, rel=1e-9) and a.gain == pytest.approx(b.gain, rel=1e-6)


def test_many_categories(spark):
    """Tens of thousands of categories encode, fit and score, and equal the dense columns where both can be had."""
    rows = spark.range(20_000).select(
        F.col("id").alias("row_id"), (F.col("id") % 40).cast("double").alias("x"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(100_000)))).alias("city"),
        F.concat(F.lit("g"), F.pmod(F.hash("id"), F.lit(5))).alias("grade"),
    )
    risk = F.exp(F.when(F.col("grade") == "g3", 1.5).otherwise(0.0) + F.col("x") / 40)
    table = materialize(rows.select(
        "*", F.ceil(-F.ln(hash_uniform("t", F.col("row_id"))) / risk * 200).cast("double").alias("observed_time"),
        (hash_uniform("e", F.col("row_id")) < 0.7).cast("int").alias("event_occurred"),
    ), "many")
    roles = encoding.Roles(["x"], ["city", "grade"])
    encoder = encoding.fit_sparse_encoder(table, roles)
    assert encoder.width > 15_000 and encoder.vocabulary.columns == ["source", "category", "place"]
    coded = materialize(encoder.transform(table, ["row_id", "event_occurred", "observed_time"]), "coded")
    assert coded.columns == ["row_id", "event_occurred", "observed_time", "x", "flags"]
    binner = trees.fit_binner(coded, ["x"], flags=encoder.width)
    model = boosted.fit_boosted(coded, ["x"], binner=binner, rounds=3, max_depth=3, learning_rate=0.5)
    assert c_index(model.score(coded)) > 0.6
    named = trees.importance(model.node_table(spark), ["x"], "gain", flags=encoder.names()).collect()
    assert {r.feature for r in named[:2]} == {"grade_g3", "x"}
    grown = forest.fit_forest(coded, ["x"], binner=binner, trees=3, max_depth=3)
    assert grown.score(coded).filter("risk is null").count() == 0
    few = encoding.Roles(["x"], ["grade"])
    wide, narrow = encoding.fit_encoder(table, few), encoding.fit_sparse_encoder(table, few)
    dense_rows = wide.transform(table, ["row_id", "event_occurred", "observed_time"])
    sparse_rows = narrow.transform(table, ["row_id", "event_occurred", "observed_time"])
    options = {"rounds": 2, "max_depth": 3}
    a = boosted.fit_boosted(dense_rows, wide.columns, **options).score(dense_rows)
    b = boosted.fit_boosted(sparse_rows, ["x"], binner=trees.fit_binner(sparse_rows, ["x"], flags=narrow.width), **options).score(sparse_rows)
    both = a.select("row_id", F.col("risk").alias("a")).join(b.select("row_id", F.col("risk").alias("b")), "row_id")
    assert both.count() == 20_000 and both.filter("abs(a - b) > 1e-9").count() == 0


def test_sparse_encoding_of_odd_values(spark):
    train = spark.createDataFrame([(1, "b", None), (2, "a", None), (3, "c", None), (4, None, None)], "id int, k string, none string")
    encoder = encoding.fit_sparse_encoder(train, encoding.Roles([], ["k", "none"]))
    other = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "zz"), (5, None)], "id int, k string")
    got = {r.id: list(r.flags) for r in encoder.transform(other, ["id"]).collect()}
    assert got == {1: [], 2: [0], 3: [1], 4: [], 5: []} and encoder.width == 2
    assert {r.place: r.feature for r in encoder.names().collect()} == {0: "k_b", 1: "k_c"}


def test_levels_of_a_tree_split_like_single_nodes():
    """All nodes of a level at once give the tree that node by node gives; missing values are among the codes."""
    rng = np.random.default_rng(3)
    bases = np.array([0, 9, 12, 14])
    flat, row = [], []
    for i in range(600):
        for f in range(3):
            b = int(rng.integers(-1, bases[f + 1] - bases[f]))
            if b:
                flat.append(bases[f] + max(b, 0))
                row.append(i)
    codes = trees.Codes(np.array(flat), np.array(row), 600)
    g, h = rng.normal(size=600), rng.uniform(0.1, 1, 600)
    find = trees.gradient_split(0.1, 0.05, 1.0)
    want = {}
    for node, split, (a, b) in trees.subtree(codes, (g, h), 0, 5, bases, lambda n, c, x, y: find(*c.sums(x, y), bases, x.sum(), y.sum())[0]):
        want[node] = (*(split[:3] if split else (-1, 0, False)), round(split.gain if split else 0.0, 9), round(a.sum(), 9), round(b.sum(), 9))
    levels = trees.gradient_levels(codes, g, h, 0, 5, bases, 0.1, 0.05, 1.0)
    assert {n: (f, c, m, round(x, 9), round(a, 9), round(b, 9)) for n, f, c, m, x, a, b in levels} == want
    assert len(want) > 20


def test_totals_walk_equal_rows_once(monkeypatch, encoded, boosted_model):
    fit = next(iter(boosted_model.ensemble.fits.values()))
    rng = np.random.default_rng(1)
    flat, row = np.sort(rng.integers(0, int(fit[0][-1]), 50)), np.arange(50)
    codes = trees.Codes(np.tile(flat, 4), np.concatenate([row, row + 50, row + 100, row + 150]), 200)
    totals, walked = trees.Totals(*fit), []
    want = totals.walk(trees.dense(codes, fit[0], fit[1]))
    walk = totals.walk
    monkeypatch.setattr(totals, "walk", lambda x: walked.append(len(x)) or walk(x))
    assert (totals.of(codes) == want).all() and (totals.of(codes) == want).all()
    assert sum(walked) <= 50
    monkeypatch.setattr(trees, "REMEMBERED", 3)
    assert (totals.of(codes) == want).all() and (totals.of(codes) == want).all()
    monkeypatch.setattr(trees, "row_keys", lambda *a: None)
    assert (totals.of(codes) == want).all()


@pytest.mark.parametrize("top,most", [(300, 5), (100_000, 1 << 40)])
def test_bundles_keep_rows(top, most):
    """A bundle is some 20 bytes a row, not a row of its own."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 4, 100)
    codes = trees.Codes(rng.integers(0, top, sizes.sum()), np.repeat(np.arange(100), sizes), 100)
    t, e, m, key = rng.integers(1, 9, 100) / 2, rng.integers(0, 2, 100), rng.integers(1, most, 100), rng.integers(-(1 << 62), 1 << 62, 100)
    first = np.arange(100) < 40
    parts = [forest.bundle(codes.take(k), t[k], e[k], m[k], key[k], top) for k in (first, ~first)]
    back = forest.unbundled(pa.table({c: [p[i] for p in parts] for i, c in enumerate(forest._COLUMNS)}))
    order = np.argsort(t, kind="stable")
    assert all((a == b[order]).all() for a, b in zip(back[1:], (t, e, m, key)))
    listed = lambda c: [c.flat[c.row == i].tolist() for i in range(c.n)]
    assert listed(back[0]) == [listed(codes)[i] for i in order]


def test_medians_work_out_crossed_blocks_only(monkeypatch, encoded, forest_model):
    table, falls, asked = encoded[1].orderBy("row_id").limit(60), forest.ForestModel._falls, []
    monkeypatch.setattr(forest, "DROPS_PER_BLOCK", 2000)
    rows, points = forest_model.curves(table)
    ids, curves = {r.row_id: r.curve_id for r in rows.collect()}, {}
    for r in points.orderBy("curve_id", "t").collect():
        curves.setdefault(r.curve_id, []).append((r.t, r.survival))
    monkeypatch.setattr(forest.ForestModel, "_falls", lambda self, cells, steps: asked.append(cells) or falls(self, cells, steps))
    got = forest_model.median_time(table).collect()
    assert len(got) == 60 and sum(c.count() for c in asked) <= len(curves)
    for r in got:
        assert r.predicted_survival_time == next((t for t, s in curves[ids[r.row_id]] if s <= forest.HALF), forest_model.last_time[0])


def test_rows_by_their_cells(monkeypatch):
    """Rows of equal codes are one cell, also where all hashes agree, and a bundle lists a cell and a time once."""
    rng = np.random.default_rng(4)
    kinds = [[], [3], [4], [1, 3], [1, 4, 9]]
    lists = [kinds[i] for i in rng.integers(0, 5, 5000)]
    codes = trees.Codes(np.array(sum(lists, [])), np.repeat(np.arange(5000), [len(x) for x in lists]), 5000)
    t, e, m, key = rng.integers(1, 60, 5000) / 2, rng.integers(0, 2, 5000), rng.integers(1, 9, 5000), rng.integers(-(1 << 62), 1 << 62, 5000)
    assert sum(map(len, forest.bundle(codes, t, e, m, key, 300))) < 15 * 5000
    values, picked = (rng.random(5000), rng.random(5000)), rng.random(5000) < 0.5
    for hashed in (forest._mix, np.zeros_like):
        monkeypatch.setattr(forest, "_mix", hashed)
        cells = forest.cells_of(codes)
        assert cells.codes.n == (5 if hashed is not np.zeros_like else 5000)
        for a, b in ((cells, codes), (cells.take(picked), codes.take(picked))):
            assert (a.flat == b.flat).all() and (a.row == b.row).all() and a.n == b.n
        for a, b in zip(cells.sums(*values), codes.sums(*values), strict=True):
            assert a == pytest.approx(b)
        split = trees.Split(1, 2, True, 0.0)
        assert (cells.right(split, np.array([0, 3, 6, 12])) == codes.right(split, np.array([0, 3, 6, 12]))).all()


def test_shares_of_trees_and_blocks_of_a_fit(spark, monkeypatch, encoded):
    """Blocks are counted for one fit, however many run together, and are dealt into shares of the trees."""
    from hazardlake.operators import prefix

    columns, table = encoded
    copies = table.withColumn("fit", F.explode(F.lit([0, 1, 2])))
    one = table.count()
    keyed = copies.withColumn("key", F.col("row_id"))
    assert prefix.time_blocks(keyed, "observed_time", one // 4, one).select("block").distinct().count() <= 5
    options = {"trees": 3, "max_depth": 2, "max_bins": 8}
    small = forest.fit_forest(copies, columns, "fit", **options)
    shares, wide = [], forest._Wide
    monkeypatch.setattr(trees, "ENTRIES", 500)
    monkeypatch.setattr(forest, "_Wide", lambda *a: shares.append(a[-1]) or wide(*a[:-1], 2))
    large = forest.fit_forest(copies, columns, "fit", **options)
    key = lambda n: (n.fit, n.tree, n.node)
    for a, b in zip(sorted(large.nodes, key=key), sorted(small.nodes, key=key), strict=True):
        assert (a.feature, a.split_bin, a.h) == (b.feature, b.split_bin, b.h) and a.value == pytest.approx(b.value, rel=1e-9)
    assert len(shares) == 1
