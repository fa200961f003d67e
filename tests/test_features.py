from pyspark.sql import functions as F

from hazardlake.operators import encoding, sampling


def ids(spark, n=1000):
    return spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("event_occurred"),
        (F.col("id") * 1.0).alias("observed_time"),
    )


def test_holdout_sizes_and_partition_invariance(spark):
    a = sampling.stratified_holdout(ids(spark))
    counts = {(r.event_occurred, r.split): r["count"] for r in a.groupBy("event_occurred", "split").count().collect()}
    assert counts == {(0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20}
    b = sampling.stratified_holdout(ids(spark).repartition(7, "observed_time"))
    pick = lambda d: {r.row_id for r in d.filter("split = 'test'").collect()}
    assert pick(a) == pick(b)


def test_group_holdout_keeps_cases_together(spark):
    df = ids(spark).withColumn("case_id", F.floor(F.col("row_id") / 4))
    split = sampling.stratified_holdout(df, group_col="case_id")
    assert split.groupBy("case_id").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    folds = sampling.assign_folds(df, group_col="case_id")
    assert folds.groupBy("case_id").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0


def test_subsets_are_exact_and_nested(spark):
    small = {r.row_id for r in sampling.subset(ids(spark), 0.1).collect()}
    large = {r.row_id for r in sampling.subset(ids(spark), 0.357).collect()}
    assert len(small) == 100 and len(large) == 357 and small < large
    assert sampling.subset(ids(spark), 1.0).count() == 1000


def test_permutation(spark):
    df = ids(spark, 200)
    out = sampling.permute(df, ["event_occurred", "observed_time"], 5).collect()
    assert sorted(r.observed_time for r in out) == [float(i) for i in range(200)]
    assert all(r.event_occurred == (int(r.observed_time) % 10 == 0) for r in out)  # labels move together
    assert sum(r.row_id == int(r.observed_time) for r in out) < 20


def test_one_hot(spark):
    train = spark.createDataFrame([(1, 1.0, "A"), (2, 2.0, "B"), (3, 3.0, "C"), (4, 4.0, None)], "row_id int, x double, s string")
    roles = encoding.feature_roles(train)
    encoder = encoding.fit_encoder(train, roles)
    assert encoder.columns == ["x", "s_B", "s_C"]
    test = spark.createDataFrame([(1, 1.0, "B"), (2, 1.0, "C"), (3, 1.0, "Z"), (4, 1.0, None)], train.schema)
    rows = [tuple(r)[1:] for r in encoder.transform(test, ["row_id"]).select("row_id", "s_B", "s_C").orderBy("row_id").collect()]
    assert rows == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
    without = test.drop("s")
    assert encoder.transform(without).columns == encoder.columns
    again = encoding.Encoder.from_table(encoder.table(spark))
    assert again == encoder
