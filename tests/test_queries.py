"""The registered dialect queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone import queries as q
from lodestone import scenarios

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        if f.endswith(".parquet"):
            c.sql(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return c


def norm(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted(([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted({*q.STATEMENTS, "agg_types", *scenarios.queries()}))
def test_statement(spark, duck, name):
    df, want = q.queries()[name](spark, DIR), duck.sql(q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), want.columns)


def test_every_query_has_an_oracle():
    assert set(q.queries()) == set(q.oracle_sql())
