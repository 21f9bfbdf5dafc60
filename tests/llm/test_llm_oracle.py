"""Queries of the training-data operators against their DuckDB twins (sf0.001)."""

import pytest

from agrisentinel.llm import queries as Q
from conftest import SMALL


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = Q.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(Q.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols
    assert got == want


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in Q.QUERIES] == [f"op{i}" for i in range(1, 14)]
