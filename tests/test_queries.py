"""Every bundle query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from bundlelens.plans import fleet, oracles, queries

SQL, QUERIES = oracles.SQL | fleet.SQL, queries.QUERIES | fleet.QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    r = con.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(plain(row[c]) for c in cols) for row in df.collect()) == want


def test_entry_and_queries_without_sql(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(QUERIES) - set(SQL) == set()
