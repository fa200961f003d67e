"""Every registered query against its SQL twin on the same tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t),
    )


_KIND = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    res = duck.execute(contract.oracle_sql()[name])
    sql_types = {d[0]: _KIND.get(str(d[1]), str(d[1])) for d in res.description}
    rows = res.fetchall()
    assert dict(df.dtypes) == sql_types
    got = _sorted(df.columns, df.collect())
    want = _sorted([d[0] for d in res.description], rows)
    assert len(got) == len(want) and want
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    close = all(
        len(g) == len(w) and all(
            a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1.5e-6)
            for a, b in zip(g, w)
        ) for g, w in bad
    )
    assert close, bad[:3]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
