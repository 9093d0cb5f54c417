"""Every query with SQL against DuckDB on the smallest tables: same rows, same values."""

import math

import duckdb
import pytest

from sapwood.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) and not math.isnan(v) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()
    assert told(tuple(r) for r in got.select(*order).collect()) == told(rows)
