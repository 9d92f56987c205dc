"""Every registered query with SQL gives the rows that DuckDB gives; those without give rows."""

import os

import duckdb
import pytest

from tessel import query_pack

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(query_pack.queries()))
def test_query(spark, db, name):
    df = query_pack.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name in query_pack.oracle_sql():
        other = db.sql(query_pack.oracle_sql()[name])
        assert sorted(other.columns) == columns
        at = [other.columns.index(c) for c in columns]
        assert mine == sorted(tuple(str(r[i]) for i in at) for r in other.fetchall())
    else:
        assert mine


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
