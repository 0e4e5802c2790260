"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from trustbook.plans import oracles, published_queries, queries, wire_queries

QUERIES = queries.QUERIES | wire_queries.QUERIES | published_queries.QUERIES
ORACLES = oracles.ORACLES | wire_queries.ORACLES | published_queries.ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    rel = duck.sql(ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(repr([r[c] for c in order]) for r in rows) == sorted(repr([r[c] for c in order]) for r in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
