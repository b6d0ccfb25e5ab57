"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from foliant.plans import store_queries, text_queries
from foliant.plans.inputs import TABLES

QUERIES, ORACLES = text_queries.QUERIES | store_queries.QUERIES, text_queries.ORACLES | store_queries.ORACLES


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    if name not in ORACLES:
        assert df.count() > 0
        return
    for t in TABLES:
        duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = duck.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert sorted(df.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == rows


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
