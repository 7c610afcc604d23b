"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        assert sorted(rel.columns) == cols
        want = sorted(tuple(map(normal, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
        assert got == want
    else:
        assert got
    spark.catalog.clearCache()
