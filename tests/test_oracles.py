"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from panelforge.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{round(v, 5) + 0.0:.5f}"  # no sign before a zero
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(row[k]) for k in order) for row in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(relation.columns, relation.fetchall())
    assert len(mine) == len(theirs)
    differ = [(a, b) for a, b in zip(mine, theirs) if a != b]
    # a rounded last digit may fall on either side
    assert not [1 for a, b in differ if any(x != y and not _close(x, y) for x, y in zip(a, b))], differ[:3]


def _close(x, y):
    try:
        return abs(float(x) - float(y)) <= 2e-5 * max(1.0, abs(float(x)))
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    """Their values are held against plain versions in test_operators.py and test_without_sql.py."""
    assert registry.queries()[name](spark, SF).count() > 0
