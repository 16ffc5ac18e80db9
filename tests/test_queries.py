"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from marlstone.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), df.columns
    want = con.sql(ORACLE_SQL[name])
    assert sorted(columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(plain(v) for v in r) for r in rows), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
