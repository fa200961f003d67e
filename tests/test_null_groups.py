"""NULL groups and NULL order values count like any other, with and without buckets."""

import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from hazardlake.operators import concordance, eda, prefix, sampling

GROUPS = ["a", None, "b"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, GROUPS[i % 3], None if i % 10 == 9 else float((i * 7) % 50)) for i in range(100)]
    return spark.createDataFrame(data, "row_id long, g string, x double")


def as_set(df):
    return sorted(map(str, df.collect()))


def test_next_value_keeps_null_groups(rows):
    unique = rows.select("g", "x").distinct()
    plain = prefix.next_value(unique, ["g"], "x", "after")
    for cuts in ([10.0], [5.0, 20.0, 40.0], [-1.0, 100.0]):
        assert as_set(prefix.next_value(unique, ["g"], "x", "after", cuts)) == as_set(plain)


def test_running_keeps_null_order(rows):
    unique = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    plain = prefix.running(unique, ["g"], "x", sums={"upto": "n"}, totals={"all": "n"})
    assert plain.count() == unique.count()
    for cuts in ([10.0], [5.0, 20.0, 40.0]):
        assert as_set(prefix.running(unique, ["g"], "x", sums={"upto": "n"}, totals={"all": "n"}, cuts=cuts)) == as_set(plain)


@pytest.mark.parametrize("rows_per_range", [100_000, 4])
def test_sampling_keeps_null_strata(rows, monkeypatch, rows_per_range):
    monkeypatch.setattr(sampling, "ROWS_PER_RANGE", rows_per_range)
    split = sampling.stratified_holdout(rows, "g")
    assert split.count() == 100
    counts = {(r.g, r.split): r["count"] for r in split.groupBy("g", "split").count().collect()}
    for g in GROUPS:
        n = sum(1 for i in range(100) if GROUPS[i % 3] == g)
        assert counts[g, "test"] == math.floor(n * 0.2 + 0.5)
    assert sampling.subset(rows, 0.37).count() == 37
    ranked = sampling.hash_rank(rows, "row_id", 1, by=["g"])
    assert sorted((str(r.g), r["rank"]) for r in ranked.collect()) == sorted(
        (str(g), k + 1) for g in GROUPS for k in range(sum(1 for i in range(100) if GROUPS[i % 3] == g))
    )
    shuffled = sampling.permute(rows, ["x"], 3, by=["g"])
    assert as_set(shuffled.select("g", "x")) == as_set(rows.select("g", "x"))


def test_ranges_do_not_change_the_choice(rows, monkeypatch):
    whole = as_set(sampling.subset(rows, 0.4))
    monkeypatch.setattr(sampling, "ROWS_PER_RANGE", 3)
    assert as_set(sampling.subset(rows, 0.4)) == whole


def test_histogram_keeps_null_groups(rows):
    counts = eda.histogram(rows, "x", bins=5, by=["g"]).groupBy("g").agg(F.sum("n").alias("n")).collect()
    known = rows.filter("x is not null").groupBy("g").count().collect()
    assert {r.g: r.n for r in counts} == {r.g: r["count"] for r in known}


def test_density_against_the_exact_kernel(spark):
    """Bin means stay within 0.1 % of the exact kernel's peak."""
    values = [math.sin(i) * 10 + (i % 17) for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    n, mean = len(values), sum(values) / len(values)
    width = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n**-0.2
    got = {r.x: r.density for r in eda.density(df, "x", grid=20).collect()}
    exact = {x: sum(math.exp(-(((x - v) / width) ** 2) / 2) for v in values) / (n * width * math.sqrt(2 * math.pi)) for x in got}
    assert max(abs(got[x] - exact[x]) for x in got) < 1e-3 * max(exact.values())


def test_concordance_by_time_buckets(spark):
    data = [(i % 2, float(i * 37 % 101) + i / 1000, i % 3 > 0, float(i * 11 % 23)) for i in range(200)]
    df = spark.createDataFrame(data, "g int, observed_time double, event_occurred boolean, risk double")
    df = df.withColumn("event_occurred", F.col("event_occurred").cast("int"))
    plain = concordance.concordance(df, ["g"], time_cuts=())
    assert as_set(concordance.concordance(df, ["g"], time_cuts=(20.0, 50.0, 80.0))) == as_set(plain)


def test_scoring_from_another_folder(tmp_path):
    """Workers score trees without the package on their path."""
    code = """
import sys
sys.path.insert(0, {repo!r})
from hazardlake.session import local_session
from hazardlake.operators import trees
spark = local_session("elsewhere", 2)
nodes = [trees.Node(0, 0, 0, feature=0, split_bin=1), trees.Node(0, 0, 1, value=-1.0), trees.Node(0, 0, 2, value=2.0)]
df = spark.createDataFrame([([],), ([1],)], "codes array<int>")
model = trees.Ensemble(nodes, trees.Binner(["a"], [[0.5]]))
print("sum", sum(r.risk for r in trees.add_total(df, model, "risk").collect()))
"""
    import os

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "sum 1.0" in done.stdout, done.stderr[-2000:]


def test_replaced_tables_are_deleted(spark):
    from hazardlake.session import discard, materialize

    table = materialize(spark.range(5), "gone")
    files = table.inputFiles()
    discard(spark.range(3))  # not a scratch table: nothing happens
    discard(table)
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
