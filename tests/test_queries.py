"""Every registered query that has SQL is run on both engines over the same whole tables."""

import math

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry_points

# The tables of the test data.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    result = db.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted([cell(v) for _, v in sorted(zip(names, row), key=lambda p: p[0])] for row in result.fetchall())
    columns = got.columns
    assert sorted([cell(v) for _, v in sorted(zip(columns, row), key=lambda p: p[0])] for row in got.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
