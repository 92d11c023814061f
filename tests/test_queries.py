"""Every registered graph query against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

from graphloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_without_sql(spark, sf, name):
    """Queries that SQL can't express: rows there are, their numbers are finite, and a node has one row."""
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    numbers = got.select_dtypes("float")
    assert np.isfinite(numbers.to_numpy()).all()
    if "node_id" in got.columns:
        assert got["node_id"].is_unique
