"""Every registered record query against its SQL, on the smallest tables; the entry points."""

import math
import os

import pytest

import __spark_entry__ as entry_points
from tidemark import queries as records

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in ("events", "lineitem", "orders", "nation", "documents", "pages", "conversations", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def shown(value):
    return round(value, 6) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", list(records.oracle_sql()))
def test_query(spark, sql, name):
    frame = records.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(shown(r[c]) for c in columns) for r in frame.collect()), key=str)
    found = sql.execute(records.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted(names) == columns and got == want


@pytest.mark.parametrize("name", ["project_default", "order_mixed_types", "order_mixed_types_desc", "order_multi", "distinct_keep_first"])
def test_whole_query_in_order(spark, sql, name):
    """All rows come, one after the other as in SQL."""
    frame = records.queries()[f"{name}_whole"](spark, DATA)
    found = sql.execute(records.oracle_sql()[f"{name}_whole"])
    names = [c[0] for c in found.description]
    want = [tuple(shown(r[names.index(c)]) for c in frame.columns) for r in found.fetchall()]
    assert [tuple(map(shown, r)) for r in frame.collect()] == want
    every = sql.execute("SELECT count(DISTINCT (event_type, user_id)) FROM events" if name.startswith("distinct") else "SELECT count(*) FROM events").fetchone()[0]
    assert len(want) == every


def test_entry_points(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["_id", "user_id", "value"] and rows.count() >= 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_every_record_query_has_its_sql():
    assert set(records.queries()) == set(records.oracle_sql())
