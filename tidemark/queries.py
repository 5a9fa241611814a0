"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lifecycle
from .languages import LuceneEngine, SqlEngine
from .operators.retention import retain
from .plans.compiler import execute, select_range
from .plans.request import Projection, QueryRequest, request_from
from .sources.records import PayloadView, RecordView, TableView

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_view(spark: SparkSession, sf_dir: str) -> TableView:
    """Events as records: epoch milliseconds of ts, order event_id, nested field props.k."""
    columns: dict[str, str | Column] = {c: c for c in ("event_id", "user_id", "event_type", "value")}
    columns["props.k"] = F.get_json_object("props", "$.k").cast("double")
    return TableView(_read(spark, sf_dir, "events"), "ts", "event_id", columns)


def sparse_view(spark: SparkSession, sf_dir: str) -> PayloadView:
    """Schemaless events: `value` is missing for errors, null for signups, a string for views, else a number."""
    rows = _read(spark, sf_dir, "events")
    number, kind = F.col("value").cast("decimal(18,2)"), F.col("event_type")
    value = F.when(kind == "signup", F.lit("null")).when(kind == "view", F.concat(F.lit('"'), number.cast("string"), F.lit('"'))).otherwise(number.cast("string"))
    body = F.concat(F.lit('{"event_type":"'), kind, F.lit('"'), F.when(kind == "error", F.lit("")).otherwise(F.concat(F.lit(',"value":'), value)), F.lit(',"meta":{"user":'), F.col("user_id").cast("string"), F.lit("}}"))
    return PayloadView(rows.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("insertion_order"), F.parse_json(body).alias("payload")))


def lineitem_view(spark: SparkSession, sf_dir: str) -> TableView:
    return TableView(_read(spark, sf_dir, "lineitem"), "l_shipdate", "l_orderkey")


def orders_view(spark: SparkSession, sf_dir: str) -> TableView:
    return TableView(_read(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


#: DuckDB: events with `timestamp` (floored, as records are), `id` and `k`; sparse adds `state` and a typed value.
_E = "e AS (SELECT *, epoch_us(ts) // 1000 AS timestamp, (epoch_us(ts) // 1000) || ':' || event_id AS id, (props->>'$.k')::DOUBLE AS k FROM events)"
_S = f"""{_E}, s AS (SELECT *, CASE event_type WHEN 'error' THEN 'missing' WHEN 'signup' THEN 'null' WHEN 'view' THEN 'string' ELSE 'number' END AS state,
    CASE WHEN event_type IN ('click', 'purchase') THEN value END AS num, CASE WHEN event_type = 'view' THEN value::DECIMAL(18, 2)::VARCHAR END AS str FROM e)"""


def _on_events(text: str) -> str:
    return f"WITH {_E} {text}"


def _on_sparse(text: str) -> str:
    return f"WITH {_S} {text}"


LOW, HIGH = 1704153600000, 1704326400000  # 2024-01-02 and 2024-01-04, UTC

View = Callable[[SparkSession, str], RecordView]
#: name -> (view, request, SQL, columns to round)
NATIVE: dict[str, tuple[View, dict[str, Any], str, tuple[str, ...]]] = {}


def _native(name: str, view: View, request: dict[str, Any], sql: str, rounded: tuple[str, ...] = ()) -> None:
    NATIVE[name] = (view, request, sql, rounded)


def _test(field: str, operator: str, value: Any = None, **more: Any) -> dict[str, Any]:
    return {"field": field, "operator": operator, "value": value, **more}


def _define() -> None:
    ids = {"select": ["_id", "value"]}
    for name, operator, sign in (("eq", "=", "="), ("ne", "!=", "<>"), ("gt", ">", ">"), ("gte", ">=", ">="), ("lt", "<", "<"), ("lte", "<=", "<=")):
        _native(f"filter_{name}", events_view, {"where": _test("value", operator, 12.31), **ids}, _on_events(f'SELECT id AS "_id", value FROM e WHERE value {sign} 12.31'))
    _native("filter_between", events_view, {"where": _test("user_id", "between", range=(10, 20)), "select": ["_id", "user_id"]}, _on_events('SELECT id AS "_id", user_id FROM e WHERE user_id BETWEEN 10 AND 20'))
    _native("filter_string_order", events_view, {"where": _test("event_type", ">=", "purchase"), "select": ["_id"]}, _on_events("""SELECT id AS "_id" FROM e WHERE event_type >= 'purchase'"""))
    _native(
        "filter_and_or_not", events_view,
        {"where": {"and": [{"or": [_test("event_type", "=", "click"), _test("event_type", "=", "view")]}, {"not": _test("value", ">", 10)}, _test("props.k", "<", 50)]}, "select": ["_id"]},
        _on_events("""SELECT id AS "_id" FROM e WHERE event_type IN ('click', 'view') AND NOT value > 10 AND k < 50"""),
    )
    for name, where, n in (("and", {"and": []}, "count(*)"), ("or", {"or": []}, "0 * count(*)"), ("not", {"not": {"or": []}}, "count(*)")):
        _native(f"filter_empty_{name}", events_view, {"where": where, "aggregates": [{"fn": "count", "as": "n"}]}, f"SELECT {n} AS n FROM events")
    _native("filter_like", events_view, {"where": _test("event_type", "like", "%r_h%"), "select": ["_id"]}, _on_events("""SELECT id AS "_id" FROM e WHERE event_type LIKE '%r_h%'"""))
    _native("filter_regexp", events_view, {"where": _test("event_type", "regexp", "^(cl|si).*[kp]$"), "select": ["_id"]}, _on_events("""SELECT id AS "_id" FROM e WHERE regexp_matches(event_type, '^(cl|si).*[kp]$')"""))
    _native("filter_id", events_view, {"where": _test("_id", "like", "%:77"), "select": ["_id", "event_id"]}, _on_events("""SELECT id AS "_id", event_id FROM e WHERE id LIKE '%:77'"""))
    _native("filter_timestamp", events_view, {"where": {"and": [_test("timestamp", ">", LOW), _test("timestamp", "<=", HIGH)]}, "select": ["_id"]}, _on_events(f'SELECT id AS "_id" FROM e WHERE timestamp > {LOW} AND timestamp <= {HIGH}'))
    _native("filter_type_mismatch", events_view, {"where": _test("value", "!=", "12.31"), "aggregates": [{"fn": "count", "as": "n"}]}, "SELECT count(*) AS n FROM events")
    for name, test, sql in (
        ("exists", _test("value", "exists"), "state <> 'missing'"),
        ("not_exists", _test("value", "not_exists"), "state = 'missing'"),
        ("is_null", _test("value", "is_null"), "state = 'null'"),
        ("is_not_null", _test("value", "is_not_null"), "state IN ('string', 'number')"),
        ("eq_null", _test("value", "=", None), "state = 'null'"),
        ("ne_number", _test("value", "!=", 12.31), "state <> 'missing' AND coalesce(num <> 12.31, true)"),
        ("not_gt", {"not": _test("value", ">", 20)}, "NOT coalesce(num > 20, false)"),
        ("mixed_string", _test("value", ">", "5"), "str > '5'"),
        ("nested", _test("meta.user", "<=", 3), "user_id <= 3"),
    ):
        _native(f"sparse_{name}", sparse_view, {"where": test, "select": ["_id"]}, _on_sparse(f'SELECT id AS "_id" FROM s WHERE {sql}'))
    mixed = "CASE state WHEN 'number' THEN 2 WHEN 'string' THEN 3 ELSE 0 END"
    _native("order_mixed_types", sparse_view, {"select": ["_id"], "orderBy": [{"field": "value"}], "limit": 6000}, _on_sparse(f'SELECT id AS "_id" FROM s ORDER BY {mixed}, num NULLS FIRST, str NULLS FIRST, timestamp, event_id LIMIT 6000'))
    _native("order_mixed_types_desc", sparse_view, {"select": ["_id"], "orderBy": [{"field": "value", "direction": "desc"}], "limit": 3000}, _on_sparse(f'SELECT id AS "_id" FROM s ORDER BY {mixed} DESC, num DESC NULLS LAST, str DESC NULLS LAST, timestamp, event_id LIMIT 3000'))
    _native("project_default", events_view, {"limit": 500}, _on_events("SELECT timestamp, event_id, user_id, event_type, value FROM e ORDER BY timestamp, event_id LIMIT 500"))
    _native("project_nested_missing", events_view, {"select": ["event_id", "props.k", "props.none", "user_id"]}, _on_events('SELECT event_id, k AS "props.k", NULL::VARCHAR AS "props.none", user_id FROM e'))
    _native("order_desc_limit", events_view, {"select": ["event_id", "value"], "orderBy": [{"field": "value", "direction": "desc"}], "limit": 100}, _on_events("SELECT event_id, value FROM e ORDER BY value DESC, timestamp, event_id LIMIT 100"))
    _native(
        "order_multi", events_view, {"select": ["event_id"], "orderBy": [{"field": "event_type", "direction": "desc"}, {"field": "user_id"}, {"field": "props.k", "direction": "desc"}], "limit": 700},
        _on_events("SELECT event_id FROM e ORDER BY event_type DESC, user_id, k DESC, timestamp, event_id LIMIT 700"),
    )
    _native("distinct_limit", events_view, {"select": ["event_type"], "distinct": True, "limit": 3}, _on_events("SELECT event_type FROM e GROUP BY 1 ORDER BY min((timestamp, event_id)) LIMIT 3"))
    _native(
        "distinct_keep_first", events_view, {"select": ["event_type", "user_id"], "distinct": True, "orderBy": [{"field": "value", "direction": "desc"}], "limit": 40},
        _on_events("""SELECT event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, timestamp, event_id) AS n FROM e)
            WHERE n = 1 ORDER BY value DESC, timestamp, event_id LIMIT 40"""),
    )
    # the same requests over all rows
    for name in ("project_default", "order_mixed_types", "order_mixed_types_desc", "order_multi", "distinct_keep_first"):
        view, request, sql, _ = NATIVE[name]
        _native(f"{name}_whole", view, {k: v for k, v in request.items() if k != "limit"}, sql.rpartition(" LIMIT ")[0])
    every = [{"fn": "count", "as": "n"}, {"fn": "count", "field": "value", "as": "n_value"}, *({"fn": f, "field": "value"} for f in ("min", "max", "sum", "avg")), {"fn": "percentile_cont", "field": "value", "percentile": 0.9, "as": "p90"}]
    totals = "count(*) AS n, count(value) AS n_value, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value, round(sum(value), 2) AS sum_value, round(avg(value), 4) AS avg_value, round(quantile_cont(value, 0.9), 4) AS p90"
    figures = ("min_value", "max_value", "sum_value", "avg_value", "p90")
    _native("agg_global", events_view, {"aggregates": every}, f"SELECT {totals} FROM events", figures)
    _native("group_by_type", events_view, {"groupBy": ["event_type"], "aggregates": every}, f"SELECT event_type, {totals} FROM events GROUP BY event_type", figures)
    _native("group_by_nested", events_view, {"groupBy": ["props.k"], "aggregates": [{"fn": "count", "as": "n"}]}, _on_events('SELECT k AS "props.k", count(*) AS n FROM e GROUP BY k'))
    _native("group_by_timestamp", events_view, {"where": _test("timestamp", "<", HIGH), "groupBy": ["timestamp"], "aggregates": [{"fn": "count", "as": "n"}]}, _on_events(f"SELECT timestamp, count(*) AS n FROM e WHERE timestamp < {HIGH} GROUP BY 1"))
    _native(
        "group_order_alias_limit", events_view, {"groupBy": ["user_id"], "aggregates": [{"fn": "count", "as": "c"}], "orderBy": [{"field": "c", "direction": "desc"}], "limit": 10},
        "SELECT user_id, count(*) AS c FROM events GROUP BY 1 ORDER BY c DESC, user_id LIMIT 10",
    )
    _native("sparse_group", sparse_view, {"aggregates": [{"fn": "count", "field": "value", "as": "n"}, {"fn": "sum", "field": "value", "as": "total"}]}, _on_sparse("SELECT count(*) FILTER (state IN ('number', 'string')) AS n, round(sum(num), 2) AS total FROM s"), ("total",))
    _native(
        "lineitem_pricing", lineitem_view,
        {
            "where": _test("timestamp", "<=", 904694400000), "groupBy": ["l_returnflag", "l_linestatus"],
            "aggregates": [{"fn": "sum", "field": "l_quantity", "as": "sum_qty"}, {"fn": "sum", "field": "l_extendedprice", "as": "sum_price"}, {"fn": "avg", "field": "l_discount", "as": "avg_disc"}, {"fn": "count", "as": "n"}],
        },
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
            FROM lineitem WHERE epoch_us(l_shipdate) // 1000 <= 904694400000 GROUP BY 1, 2""",
        ("sum_qty", "sum_price", "avg_disc"),
    )
    _native(
        "orders_by_priority", orders_view, {"where": _test("o_totalprice", ">", 1000), "groupBy": ["o_orderpriority"], "aggregates": [{"fn": "count", "as": "n"}, {"fn": "max", "field": "timestamp", "as": "latest"}]},
        "SELECT o_orderpriority, count(*) AS n, max(epoch_us(o_orderdate) // 1000) AS latest FROM orders WHERE o_totalprice > 1000 GROUP BY 1",
    )


_define()

#: name -> (engine, text, options, SQL, columns to round)
TEXT: dict[str, tuple[str, str, dict[str, Any] | None, str, tuple[str, ...]]] = {
    "sql_filter": ("sql", "SELECT _id, value FROM records WHERE event_type = 'purchase' AND value > 50 AND NOT user_id BETWEEN 5 AND 30", None, _on_events("""SELECT id AS "_id", value FROM e WHERE event_type = 'purchase' AND value > 50 AND user_id NOT BETWEEN 5 AND 30"""), ()),
    "sql_like_regexp": ("sql", "SELECT event_id FROM records WHERE event_type LIKE 'c%' OR event_type REGEXP 'ew$'", None, "SELECT event_id FROM events WHERE event_type LIKE 'c%' OR regexp_matches(event_type, 'ew$')", ()),
    "sql_alias_arith": ("sql", 'SELECT event_id AS id, value + user_id AS s, value - "props".k AS d FROM records WHERE props.k IS NOT NULL', None, _on_events("SELECT event_id AS id, round(value + user_id, 4) AS s, round(value - k, 4) AS d FROM e"), ("s", "d")),
    "sql_order_limit": ("sql", "SELECT event_id, event_type FROM records WHERE value >= 1.5 ORDER BY event_type DESC, value ASC LIMIT 250", None, _on_events("SELECT event_id, event_type FROM e WHERE value >= 1.5 ORDER BY event_type DESC, value, timestamp, event_id LIMIT 250"), ()),
    "sql_distinct": ("sql", "SELECT DISTINCT user_id FROM records WHERE event_type != 'error'", None, "SELECT DISTINCT user_id FROM events WHERE event_type <> 'error'", ()),
    "sql_group": (
        "sql", "SELECT event_type, COUNT(*) AS c, AVG(value) AS a, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY value) AS med FROM records GROUP BY event_type ORDER BY c DESC LIMIT 4", None,
        "SELECT event_type, count(*) AS c, round(avg(value), 4) AS a, round(quantile_cont(value, 0.5), 4) AS med FROM events GROUP BY 1 ORDER BY c DESC, event_type LIMIT 4", ("a", "med"),
    ),
    "sql_group_distinct": ("sql", "SELECT DISTINCT COUNT(*) AS c FROM records GROUP BY user_id ORDER BY c DESC", None, "SELECT DISTINCT c FROM (SELECT count(*) AS c FROM events GROUP BY user_id)", ()),
    "sql_options": ("sql", "SELECT event_id FROM records WHERE user_id = 7", {"orderBy": [{"field": "value", "direction": "desc"}], "limit": 20}, _on_events("SELECT event_id FROM e WHERE user_id = 7 ORDER BY value DESC, timestamp, event_id LIMIT 20"), ()),
    "lucene_terms": ("lucene", "(event_type:purchase OR event_type:\"click\") AND NOT user_id:7", {"select": ["_id"]}, _on_events("""SELECT id AS "_id" FROM e WHERE event_type IN ('purchase', 'click') AND user_id <> 7"""), ()),
    "lucene_ranges": ("lucene", "value:[10 TO 20] AND user_id:{3 TO 40} AND props.k:[0 TO 60]", {"select": ["event_id"]}, _on_events("SELECT event_id FROM e WHERE value BETWEEN 10 AND 20 AND user_id > 3 AND user_id < 40 AND k BETWEEN 0 AND 60"), ()),
    "lucene_timestamp": ("lucene", "timestamp:[2024-01-02 TO \"2024-01-04T00:00:00Z\"]", {"select": ["event_id"]}, _on_events(f"SELECT event_id FROM e WHERE timestamp BETWEEN {LOW} AND {HIGH}"), ()),
    "lucene_wildcard_regexp": ("lucene", "event_type:?i* OR event_type:/^p.r/", {"select": ["event_id"]}, "SELECT event_id FROM events WHERE event_type LIKE '_i%' OR regexp_matches(event_type, '^p.r')", ()),
    "lucene_exists": ("lucene", "value:* AND NOT nothing:*", {"aggregates": [{"fn": "count", "as": "n"}]}, "SELECT count(*) AS n FROM events", ()),
    "lucene_group": ("lucene", "value:[5 TO 500]", {"groupBy": ["event_type"], "aggregates": [{"fn": "max", "field": "value", "as": "top"}, {"fn": "count", "as": "c"}], "orderBy": [{"field": "c", "direction": "desc"}], "limit": 10}, "SELECT event_type, max(value) AS top, count(*) AS c FROM events WHERE value BETWEEN 5 AND 500 GROUP BY 1", ()),
}
ENGINES = {"sql": SqlEngine(), "lucene": LuceneEngine()}


def rounded(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Sums of doubles depend on their order; so many digits don't."""
    places = {c: 2 if c.startswith(("sum_", "total")) else 4 for c in columns}
    return df.withColumns({c: F.round(F.col(f"`{c}`"), n) for c, n in places.items()}) if columns else df


def _run_native(name: str) -> Query:
    view, request, _, columns = NATIVE[name]
    return lambda spark, sf_dir: rounded(execute(request_from(request), view(spark, sf_dir)), columns)


def _run_text(name: str) -> Query:
    language, text, options, _, columns = TEXT[name]
    return lambda spark, sf_dir: rounded(execute(ENGINES[language].to_native_query(text, options), events_view(spark, sf_dir)), columns)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest purchases."""
    where = {"and": [_test("event_type", "=", "purchase"), _test("value", ">", 50)]}
    request = {"where": where, "select": ["_id", "user_id", "value"], "orderBy": [{"field": "value", "direction": "desc"}], "limit": 10}
    return execute(request_from(request), events_view(spark, sf_dir))


def range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_range(events_view(spark, sf_dir), LOW, HIGH).select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "event_id", "event_type", "value")


def project_alias_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = (Projection(((1, "event_id"),), "id"), Projection(((1, "value"), (1, "user_id"), (-1, 1)), "s"))
    return rounded(execute(QueryRequest(select=items), events_view(spark, sf_dir)), ("s",))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.length("props") + F.length("event_type")).cast("long")
    return _read(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("insertion_order"), size.alias("encoded_bytes"))


CAPACITY = 40_000


def turnover_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turnover bound keeps of events that come in time order."""
    return retain(_sized(spark, sf_dir), CAPACITY, "turnover")


def turnover_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turnover bound keeps of events that come in another order than their times."""
    late = F.col("insertion_order") * 7919 * 86_400 % 86_400_000
    return retain(_sized(spark, sf_dir).withColumn("timestamp", F.col("timestamp") - late), CAPACITY, "turnover")


def strict_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict bound accepts."""
    return retain(_sized(spark, sf_dir), CAPACITY, "strict")


def payload_default_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemaless records without a select: every key that holds a scalar; the mixed one as a number and as a text."""
    found = execute(QueryRequest(), sparse_view(spark, sf_dir))
    text = F.schema_of_variant("value") == "STRING"
    return found.select(
        F.col("timestamp"),
        F.col("event_type").cast("string").alias("event_type"),
        F.when(~text, F.try_variant_get("value", "$", "double")).alias("number"),
        F.when(text, F.try_variant_get("value", "$", "string")).alias("text"),
        F.lit(len(found.columns)).alias("n_columns"),
    )


def queries() -> dict[str, Query]:
    named = {"flagship": flagship, "range_select": range_select, "project_alias_arith": project_alias_arith, "turnover_in_order": turnover_in_order, "turnover_late": turnover_late, "strict_fold": strict_fold}
    named |= {"payload_default_projection": payload_default_projection}
    return named | {n: _run_native(n) for n in NATIVE} | {n: _run_text(n) for n in TEXT} | lifecycle.queries()


def oracle_sql() -> dict[str, str]:
    sized = "SELECT epoch_us(ts) // 1000 AS timestamp, event_id AS insertion_order, length(props) + length(event_type) AS encoded_bytes FROM events"
    return {
        "flagship": _on_events("""SELECT id AS "_id", user_id, value FROM e WHERE event_type = 'purchase' AND value > 50 ORDER BY value DESC, timestamp, event_id LIMIT 10"""),
        "range_select": _on_events(f"SELECT timestamp, event_id, event_type, value FROM e WHERE timestamp BETWEEN {LOW} AND {HIGH}"),
        "project_alias_arith": "SELECT event_id AS id, round(value + user_id - 1, 4) AS s FROM events",
        "payload_default_projection": _on_sparse("SELECT timestamp, event_type, num AS number, str AS text, 3 AS n_columns FROM s"),
        "strict_fold": f"""
            WITH e AS ({sized}), o AS (SELECT list({{'held': encoded_bytes::BIGINT, 'kept': [insertion_order]}} ORDER BY insertion_order) AS rows FROM e),
                 f AS (SELECT unnest(list_reduce(list_prepend({{'held': 0::BIGINT, 'kept': []::BIGINT[]}}, rows),
                    lambda a, x: CASE WHEN a.held + x.held <= {CAPACITY} THEN {{'held': a.held + x.held, 'kept': list_concat(a.kept, x.kept)}} ELSE a END).kept) AS insertion_order FROM o)
            SELECT e.* FROM e JOIN f USING (insertion_order)""",
        "turnover_late": f"""
            WITH RECURSIVE e AS (SELECT timestamp - insertion_order * 7919 * 86400 % 86400000 AS timestamp, insertion_order, encoded_bytes FROM ({sized})),
                 n AS (SELECT *, row_number() OVER (ORDER BY insertion_order) AS nth FROM e WHERE encoded_bytes <= {CAPACITY}),
                 -- the records held, by (time, order); of them the first that must go make room for the next
                 step AS (SELECT 0::BIGINT AS nth, []::STRUCT(t BIGINT, o BIGINT, b BIGINT)[] AS held, 0::BIGINT AS size
                    UNION ALL SELECT nth, list_sort(list_append(held[gone + 1:], {{'t': t, 'o': o, 'b': b}})), size - coalesce(list_sum(list_transform(held[1:gone], lambda x: x.b)), 0)::BIGINT + b
                    FROM (SELECT n.nth, n.timestamp AS t, n.insertion_order AS o, n.encoded_bytes AS b, held, size,
                            CASE WHEN size + n.encoded_bytes <= {CAPACITY} THEN 0 ELSE 1 + len(list_filter(range(1, 60), lambda k: size - list_sum(list_transform(held[1:k], lambda x: x.b)) + n.encoded_bytes > {CAPACITY})) END AS gone
                          FROM step JOIN n ON n.nth = step.nth + 1))
            SELECT e.* FROM e JOIN (SELECT unnest(held).o AS insertion_order FROM (SELECT held FROM step ORDER BY nth DESC LIMIT 1)) USING (insertion_order)""",
        **lifecycle.oracle_sql(),
        "turnover_in_order": f"SELECT timestamp, insertion_order, encoded_bytes FROM (SELECT *, sum(encoded_bytes) OVER (ORDER BY timestamp DESC, insertion_order DESC) AS held FROM ({sized})) WHERE held <= {CAPACITY}",
        **{n: sql for n, (_, _, sql, _) in NATIVE.items()},
        **{n: sql for n, (_, _, _, sql, _) in TEXT.items()},
    }
