"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from tidemark.llm import queries as llm

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_query(spark, sql, name):
    frame = llm.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
    found = sql.execute(llm.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)


def test_one_query_for_each_operator():
    assert [sum(n.startswith(f"op{k}_") for n in llm.queries()) for k in range(1, 11)] == [1] * 10
