import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hazardlake.functions import scalars as sc
from hazardlake.operators import cleaning, joining
from hazardlake.sources import files


def test_number_text(spark):
    texts = ["'--", "", " 5 ", "1e3", "nan", "1.0d", "-2.5", "+7", ".5", "abc", None, "1_0", "0x1A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(sc.number_or_null(F.col("t")).alias("v")).collect()]
    assert got == [None, None, 5.0, 1000.0, None, None, -2.5, 7.0, 0.5, None, None, None, None]


def test_event_and_time_rules(spark):
    rows = [
        (1, "Dead", None, 9.0),     # event without its own time: dropped
        (2, None, -3.0, 4.0),       # unknown status counts as censored; clamped to one day
        (3, "Dead", 0.0, 9.0),
        (4, "Dead", 1.0, None),
        (5, "alive", 1.0, 730.5),
    ]
    df = spark.createDataFrame(
        rows, "id int, vital_status string, days_to_death double, days_to_last_follow_up double"
    )
    got = {r.id: (r.event_occurred, r.observed_time) for r in cleaning.add_event_and_time(df).collect()}
    assert set(got) == {2, 3, 4, 5}
    assert got[2] == (0, 4.0 / 365.25) and got[3] == (1, 1 / 365.25) and got[5] == (0, 2.0)


def test_bands_and_groups(spark):
    ages = [-1.0, 0.0, 39.9, 40.0, 99.9, 100.0, None]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    assert [r.b for r in df.select(sc.band(F.col("a")).alias("b")).collect()] == [
        None, "age_0_40", "age_0_40", "age_40_50", "age_80_100", None, None
    ]
    stages = ["Stage IIIC", "Stage I", "Stage IVB", "Stage X", None]
    df = spark.createDataFrame([(s,) for s in stages], "ajcc_pathologic_stage string")
    assert [r[0] for r in cleaning.group_stages(df).collect()] == ["Stage III", "Stage I", "Stage IV"]


def test_site_filters_and_nulls(spark):
    df = spark.createDataFrame(
        [("Cecum",), ("Splenic flexure of colon",), ("Lung",), (None,)], "tissue_or_organ_of_origin string"
    )
    assert [r[0] for r in cleaning.keep_sites(df).collect()] == ["Cecum", "Splenic flexure of colon"]
    assert [r[0] for r in cleaning.drop_sites(df).collect()] == ["Cecum", "Lung", None]


def test_feature_names(spark):
    names = ["ajcc_pathologic_stage_Stage IV", "tissue_or_organ_of_origin_Colon, NOS", "age_at_index", "race_race_x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(sc.readable_feature(F.col("n"))).collect()] == [
        "Estágio IV", "Colon, NOS", "age at index", "x"
    ]


def test_consolidate(spark):
    a = spark.createDataFrame([("k", 1, 5), (None, 2, 6), ("z", 3, 7)], "`c.id` string, a int, v int")
    b = spark.createDataFrame([("k", 10), ("k", 11), (None, 12)], "`c.id` string, v int")
    out = joining.consolidate(a, b, "c.id")
    assert out.columns == ["c.id", "a", "v_x", "v_y"]
    assert sorted((r.a, r.v_x, r.v_y) for r in out.collect()) == [(1, 5, 10), (1, 5, 11), (2, 6, 12)]
    assert joining.consolidate(a, b, "c.id", null_keys_match=False).count() == 2
    with pytest.raises(ValueError):
        joining.consolidate(a, b, "missing")


def test_align(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "row_id int, extra double, x double")
    out = joining.align_columns(df, ["y", "x"], keep=["row_id"])
    assert out.columns == ["row_id", "y", "x"] and tuple(out.first()) == (1, 0.0, 3.0)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None)], "i int, `s.t` string, x double")
    for suffix in ("csv", "parquet"):
        path = files.write_table(df, str(tmp_path / f"t.{suffix}"))
        back = files.read_table(spark, path, df.schema)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "raw.tsv").write_text("a.b\tc\n'--\tNA\n x\t\"q\"\n")
    raw = files.read_table(spark, str(tmp_path / "raw.tsv"))
    assert raw.columns == ["a.b", "c"] and [tuple(r) for r in raw.collect()] == [("'--", None), (" x", "q")]
    with pytest.raises(ValueError):
        files.read_table(spark, "t.xlsx")
    with pytest.raises(ValueError):
        files.write_table(df, str(tmp_path / "t.tsv"))
    with pytest.raises(AnalysisException):
        files.read_table(spark, str(tmp_path / "absent.parquet"))
