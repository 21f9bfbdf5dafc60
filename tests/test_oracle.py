"""Every query with a SQL twin returns the same rows as DuckDB (sf0.001)."""

import math

import pytest

import __spark_entry__ as E
from agrisentinel.plans import ORACLE as SQL
from agrisentinel.plans import load_all
from conftest import SMALL

load_all()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 100


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    want = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(got, df.columns) == _rows(want, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "exceeding_loq", "count"]
    assert df.count() > 0
