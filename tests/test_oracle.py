"""Every catalogue query against its SQL on DuckDB, over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from varigrid.plans.catalogue import ORACLE, QUERIES

SF = os.environ.get("VARIGRID_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value + 0.0, 12)
    return value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=str)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=str)
    assert got == want


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, SF).count() > 0
