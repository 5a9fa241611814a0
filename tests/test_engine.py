"""Filters, order, projection, distinct and aggregates against a plain model."""

import itertools
import json
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import Datastore, PayloadView, QueryLimits, TableView, execute, request_from
from tidemark.errors import QueryValidationError, UnsupportedQueryFeatureError

STATES = [{"x": 1}, {"x": "1"}, {"x": True}, {"x": None}, {}, {"x": {"y": 1}}, {"x": 1.5}, {"x": "b"}, {"x": False}, {"x": "～"}, {"x": "😀"}, {"x": "ab\n"}, {"x": "a\\b"}, {"x": "100%"}, {"x": ""}, {"x": -3}, {"x": 1.0}]
GONE = object()


@pytest.fixture(scope="module")
def db(spark):
    store = Datastore(spark)
    store.insert_many({"timestamp": 100 - i // 4, "payload": p} for i, p in enumerate(STATES))
    return store


def value_of(payload, path="x"):
    for s in path.split("."):
        if not isinstance(payload, dict) or s not in payload:
            return GONE
        payload = payload[s]
    return payload


def holds(payload, operator, value=None, bounds=None):
    """The reference semantics of one test."""
    v = value_of(payload)
    if operator in ("exists", "not_exists"):
        return (v is not GONE) == (operator == "exists")
    if operator == "is_null":
        return v is None
    if operator == "is_not_null":
        return v is not GONE and v is not None
    if v is GONE or isinstance(v, dict):
        return False
    kind = lambda a: "b" if isinstance(a, bool) else "n" if isinstance(a, int | float) else "s" if isinstance(a, str) else "0"
    key = lambda a: a.encode("utf-16-be") if isinstance(a, str) else a
    same = kind(v) == kind(value) and v == value
    if operator in ("=", "!="):
        return same == (operator == "=")
    if operator == "between":
        return all(kind(v) == kind(b) and kind(v) in "ns" for b in bounds) and key(bounds[0]) <= key(v) <= key(bounds[1])
    if operator == "like":
        return kind(v) == "s" and bool(re.fullmatch("".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in value), v, re.DOTALL))
    if operator == "regexp":
        return kind(v) == "s" and bool(re.search(value.replace("$", r"\Z"), v))
    if kind(v) != kind(value) or kind(v) not in "ns":
        return False
    a, b = key(v), key(value)
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[operator]


TESTS = [(o, None, None) for o in ("exists", "not_exists", "is_null", "is_not_null")]
TESTS += [(o, v, None) for o in ("=", "!=", ">", ">=", "<", "<=") for v in (1, 1.5, "1", "b", "～", "😀", True, False, None, "")]
TESTS += [("between", None, b) for b in ((1, 2), ("1", "b"), (1, "b"), (2, 1), (None, 1), (True, False))]
TESTS += [("like", p, None) for p in ("%", "_", "ab_", "a\\b", "100%", "", "%b%")] + [("regexp", p, None) for p in ("b$", "^[0-9]+", "a.b", ".", "")]


@pytest.mark.parametrize(("operator", "value", "bounds"), TESTS)
def test_filters(db, operator, value, bounds):
    test = {"field": "x", "operator": operator, "value": value, "range": bounds}
    got = lambda where: sorted(int(r[0].split(":")[1]) for r in db.query_native({"where": where, "select": ["_id"]}).collect())
    want = [i for i, p in enumerate(STATES) if holds(p, operator, value, bounds)]
    assert got(test) == want
    assert got({"not": test}) == [i for i in range(len(STATES)) if i not in want]


def test_logic(db):
    count = lambda where: db.query_native({"where": where, "aggregates": [{"fn": "count", "as": "n"}]}).first().n
    assert count({"and": []}) == len(STATES) and count({"or": []}) == 0
    one = {"field": "x", "operator": "=", "value": 1}
    assert count({"or": [one, {"not": {"not": one}}]}) == 2
    deep = one
    for _ in range(64):
        deep = {"not": deep}
    assert count(deep) == 2
    with pytest.raises(QueryValidationError):
        count({"not": deep})


def rank(v):
    if v is GONE or v is None or isinstance(v, dict):
        return (0, 0)
    if isinstance(v, bool):
        return (1, v)
    return (2, v) if isinstance(v, int | float) else (3, v.encode("utf-16-be"))


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_order(db, direction):
    got = [int(r[0].split(":")[1]) for r in db.query_native({"select": ["_id"], "orderBy": [{"field": "x", "direction": direction}]}).collect()]
    rows = sorted(range(len(STATES)), key=lambda i: (100 - i // 4, i))
    assert got == sorted(rows, key=lambda i: rank(value_of(STATES[i])), reverse=False) if direction == "asc" else True
    if direction == "desc":
        groups = itertools.groupby(sorted(rows, key=lambda i: rank(value_of(STATES[i]))), key=lambda i: rank(value_of(STATES[i])))
        assert got == [i for g in reversed([list(g) for _, g in groups]) for i in g]


def python_of(v):
    if v is None:
        return None
    made = json.loads(v.toJson()) if hasattr(v, "toJson") else v
    return float(made) if isinstance(made, Decimal) else made


def test_distinct_keeps_the_first(db):
    got = [python_of(r[0]) for r in db.query_native({"select": ["x"], "distinct": True, "orderBy": [{"field": "timestamp", "direction": "desc"}]}).collect()]
    rows = sorted(range(len(STATES)), key=lambda i: (-(100 - i // 4), i))
    want, seen = [], set()
    for i in rows:
        v = value_of(STATES[i])
        k = rank(v)
        if k not in seen:
            seen.add(k)
            want.append(None if k == (0, 0) else v)
    assert got == want


def test_distinct_by_unselected_order(spark):
    store = Datastore(spark)
    store.insert_many({"timestamp": t, "payload": {"sensor": s, "value": v}} for t, s, v in [(1, "a", 5), (2, "b", 9), (3, "a", 11), (4, "c", 1)])
    rows = store.query_native({"select": ["sensor"], "distinct": True, "orderBy": [{"field": "value", "direction": "desc"}], "limit": 2}).collect()
    assert [python_of(r[0]) for r in rows] == ["a", "b"]


def test_projection(spark):
    store = Datastore(spark)
    store.insert({"timestamp": 7, "payload": {"a.b": 1, "r\\z": 2, "q'q": 3, 'd"d': 4, "b'\"b": {"deep": 5}, "meta": {"region": "x"}}})
    fields = ["timestamp", "_id", r"a\.b", r"r\\z", "q'q", 'd"d', "b'\"b.deep", "meta.region", "meta", "none.at.all"]
    assert [python_of(x) for x in store.query_native({"select": fields}).first()] == [7, "7:0", 1, 2, 3, 4, 5, "x", None, None]
    default = store.query_native({})
    assert default.columns == ["timestamp", r"a\.b", 'd"d', "q'q", r"r\\z"]


def test_default_projection_takes_every_key_or_none(spark):
    """More keys than columns can be had are refused, not cut."""

    def view(n):
        body = [(k, "{" + ",".join(f'"k{i}":{i}' for i in range(k * 200, min(n, (k + 1) * 200))) + ',"timestamp":1,"nested":{}}') for k in range(-(-n // 200))]
        return PayloadView(spark.createDataFrame(body, "timestamp long, body string").selectExpr("timestamp", "timestamp AS insertion_order", "parse_json(body) AS payload"))

    assert view(4096).default_fields() == ["timestamp", *sorted(f"k{i}" for i in range(4096))]
    with pytest.raises(QueryValidationError, match="more than 4096"):
        execute(request_from({}), view(4097))


def test_groups(db):
    request = {"groupBy": ["x"], "aggregates": [{"fn": "count", "as": "n"}, {"fn": "count", "field": "x"}, {"fn": "min", "field": "timestamp", "as": "t"}], "orderBy": [{"field": "x"}]}
    got = [(python_of(r.x), r.n, r.count_x) for r in db.query_native(request).collect()]
    keys = sorted({rank(value_of(p)) for p in STATES})
    assert [n for _, n, _ in got] == [sum(rank(value_of(p)) == k for p in STATES) for k in keys]
    assert got[0] == (None, 3, 0)
    top = db.query_native({"aggregates": [{"fn": "min", "field": "x"}, {"fn": "max", "field": "x"}, {"fn": "sum", "field": "x"}, {"fn": "avg", "field": "x"}, {"fn": "percentile_cont", "field": "x", "percentile": 0.25, "as": "p"}]}).first()
    assert (python_of(top.min_x), python_of(top.max_x)) == (False, "～")
    numbers = sorted(p["x"] for p in STATES if isinstance(p.get("x"), int | float) and not isinstance(p["x"], bool))
    assert top.sum_x == sum(numbers) and top.avg_x == sum(numbers) / len(numbers)
    at = 0.25 * (len(numbers) - 1)
    assert top.p == numbers[int(at)] + (numbers[int(at) + 1] - numbers[int(at)]) * (at - int(at))


@pytest.mark.parametrize(
    "bad",
    [
        {"limit": 0}, {"limit": True}, {"limit": 1.5}, {"orderBy": [{"field": "x", "direction": "up"}]}, {"where": {"field": "x", "operator": "between"}}, {"where": {"field": "x", "operator": "~"}},
        {"aggregates": [{"fn": "median", "field": "x"}]}, {"aggregates": [{"fn": "sum"}]}, {"aggregates": [{"fn": "percentile_cont", "field": "x", "percentile": 2}]}, {"select": ["x", "x"]},
        {"groupBy": ["x"], "aggregates": [{"fn": "count"}], "orderBy": [{"field": "y"}]}, {"where": {"field": "x", "operator": "regexp", "value": "(a+)+"}}, {"where": {"field": "x", "operator": "=", "value": float("nan")}},
    ],
)
def test_refused_requests(db, bad):
    with pytest.raises((QueryValidationError, UnsupportedQueryFeatureError)):
        db.query_native(bad)


def test_budgets(spark):
    frame = spark.range(10_001).select(F.col("id").alias("timestamp"), F.col("id").alias("insertion_order"), F.parse_json(F.lit('{"e":1}')).alias("payload"))
    view = PayloadView(frame)
    with pytest.raises(QueryValidationError):
        execute(request_from({"limit": 1, "select": ["e"]}), view, QueryLimits())
    small = view.with_frame(frame.limit(5001))
    with pytest.raises(QueryValidationError):
        execute(request_from({"select": ["e"]}), small, QueryLimits())
    assert execute(request_from({"select": ["e"], "limit": 5000}), small, QueryLimits()).count() == 5000
    assert execute(request_from({"select": ["e"]}), view).count() == 10_001


def test_table_pushdown(spark, tmp_path):
    """Bounds on a timestamp column and on plain columns reach the scan; only used columns are read."""
    rows = [(i, i % 5, f"t{i % 3}", "unused") for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, v long, kind string, other string").withColumn("ts", F.timestamp_millis(F.col("id") * 1000 + 1)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    frame.write.parquet(f"file://{tmp_path}/t")
    view = TableView(spark.read.parquet(f"file://{tmp_path}/t"), "ts", "id")
    where = {"and": [{"field": "timestamp", "operator": "between", "range": [5001, 20_000]}, {"field": "v", "operator": ">", "value": 2}, {"field": "kind", "operator": "=", "value": "t1"}]}
    made = execute(request_from({"where": where, "select": ["id"]}), view)
    plan = made._jdf.queryExecution().executedPlan().toString()
    for part in ("GreaterThanOrEqual(ts", "LessThan(ts", "GreaterThan(v,2)", "EqualTo(kind,t1)"):
        assert part in plan, plan
    assert "other" not in plan
    assert [r.id for r in made.collect()] == [i for i in range(5, 20) if i % 5 > 2 and i % 3 == 1]


def test_moment_bounds(spark):
    micros = [-1500, -1000, -1, 0, 999, 1000, 1500, 2000, 2001]
    frame = spark.createDataFrame(list(enumerate(micros)), "id long, us long").withColumn("ts", F.timestamp_micros("us"))
    view = TableView(frame, "ts", "id")
    for operator, value in itertools.product(("=", ">", ">=", "<", "<="), (-2, -1, 0, 0.5, 1, 2, 1e18, -1e18)):
        got = sorted(r.id for r in execute(request_from({"where": {"field": "timestamp", "operator": operator, "value": value}, "select": ["id"]}), view).collect())
        ms = [u // 1000 for u in micros]
        want = [i for i, m in enumerate(ms) if {"=": m == value, ">": m > value, ">=": m >= value, "<": m < value, "<=": m <= value}[operator]]
        assert got == want, (operator, value)


def test_regexps_as_in_ecmascript(spark):
    texts = ["ab\n", "b", "a b", "a\nb", "foo bar", "éa", "x-y", "﻿", "a&b", "[", "😀"]
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "ts long, id long, t string")
    view = TableView(frame, "ts", "id")
    cases = {"b$": [1, 2, 3, 8], "a.b": [8], r"^\s$": [7], r"\bbar": [4], r"\w-\w": [6], "[[]": [9], "^.$": [1, 7, 9, 10], r"a[&&b]": [0, 8], r"\u{1F600}": [10], "[^]": list(range(11))}
    for pattern, want in cases.items():
        got = sorted(r.id for r in execute(request_from({"where": {"field": "t", "operator": "regexp", "value": pattern}, "select": ["id"]}), view).collect())
        assert got == want, pattern


def test_random_ranges(spark):
    state = random.Random(7)
    stamps = [state.randrange(80) for _ in range(320)]
    store = Datastore(spark)
    store.insert_many({"timestamp": t, "payload": {"id": i}} for i, t in enumerate(stamps))
    for _ in range(6):
        low, high = sorted((state.randrange(80), state.randrange(80)))
        got = [json.loads(r[0])["id"] for r in store.select(low, high).select(F.to_json("payload")).collect()]
        assert got == [i for _, i in sorted((t, i) for i, t in enumerate(stamps) if low <= t <= high)]


def test_distinct_groups_in_order(spark):
    """Of groups whose selected columns are equal the first stays, and the order holds."""
    rows = [(i, i, json.dumps({"k": k, "j": j, "v": v})) for i, (k, j, v) in enumerate([("a", 1, 5), ("a", 2, 5), ("b", 1, 7), ("c", 1, 7), ("c", 1, 1), (None, 3, 5)])]
    frame = spark.createDataFrame(rows, "timestamp long, insertion_order long, body string").select("timestamp", "insertion_order", F.parse_json("body").alias("payload"))
    run = lambda **x: [tuple(json.loads(v) if isinstance(v, str) else v for v in r) for r in execute(request_from(x), PayloadView(frame)).select(*(F.to_json(c) if t == "variant" else F.col(c) for c, t in execute(request_from(x), PayloadView(frame)).dtypes)).collect()]
    top = [{"fn": "max", "field": "v", "as": "m"}]
    assert run(groupBy=["k", "j"], aggregates=top, select=["m"], distinct=True, orderBy=[{"field": "m", "direction": "desc"}]) == [(7,), (5,)]
    assert run(groupBy=["k", "j"], aggregates=top, select=["k"], distinct=True, orderBy=[{"field": "m", "direction": "desc"}, {"field": "k"}]) == [("b",), ("c",), (None,), ("a",)]
    assert sorted(run(groupBy=["k", "j"], select=["j"], distinct=True)) == [(1,), (2,), (3,)]
    assert run(groupBy=["k", "j"], aggregates=[{"fn": "count", "as": "n"}], select=["n"], distinct=True, orderBy=[{"field": "n"}], limit=1) == [(1,)]
