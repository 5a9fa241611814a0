import pytest

from tidemark import Aggregate, And, Comparison, LuceneEngine, Not, Or, OrderBy, Projection, QueryRequest, SqlEngine
from tidemark.errors import QueryParseError, QueryValidationError, UnsupportedQueryFeatureError

sql, lucene = SqlEngine().to_native_query, LuceneEngine().to_native_query


def test_sql_statement():
    made = sql("select a, b.c AS d, a + 2 - \"x.y\" from records where a >= -1.5 and (b = 'it''s' or not c is null) group by a" if False else "select a, b.c AS d, a + 2 - \"x.y\" from records where a >= -1.5 and (b = 'it''s' or not c is null) order by a desc, b limit 3;")
    assert made.select == ("a", Projection(((1, "b.c"),), "d"), Projection(((1, "a"), (1, 2), (-1, r"x\.y")), r"a + 2 - x\.y"))
    assert made.where == And((Comparison("a", ">=", -1.5), Or((Comparison("b", "=", "it's"), Not(Comparison("c", "is_null"))))))
    assert made.order_by == (OrderBy("a", "desc"), OrderBy("b")) and made.limit == 3 and not made.distinct


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a = 1", Comparison("a", "=", 1)), ("a <> TRUE", Comparison("a", "!=", True)), ("a != NULL", Comparison("a", "!=", None)), ("a BETWEEN 1 AND 'x'", Comparison("a", "between", range=(1, "x"))),
        ("NOT a BETWEEN 1 AND 2", Not(Comparison("a", "between", range=(1, 2)))), ("a NOT LIKE 'x%'", Not(Comparison("a", "like", "x%"))), ("a IS NOT NULL", Comparison("a", "is_not_null")),
        ("EXISTS(a.b)", Comparison("a.b", "exists")), ("NOT EXISTS(a)", Comparison("a", "not_exists")), ("a REGEXP '^x$'", Comparison("a", "regexp", "^x$")),
        ("a = 1 OR b = 2 AND c = 3", Or((Comparison("a", "=", 1), And((Comparison("b", "=", 2), Comparison("c", "=", 3)))))), ('"service.name" = 1', Comparison(r"service\.name", "=", 1)), ('"from".x < 2', Comparison("from.x", "<", 2)),
        ("a = 1e3", Comparison("a", "=", 1000.0)),
    ],
)
def test_sql_predicates(text, want):
    assert sql(f"SELECT a FROM records WHERE {text}").where == want


def test_sql_aggregates():
    made = sql("SELECT k, COUNT(*) AS c, count(v), PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY v) AS p FROM records GROUP BY k ORDER BY c DESC LIMIT 2")
    assert made.aggregates == (Aggregate("count", None, "c"), Aggregate("count", "v"), Aggregate("percentile_cont", "v", "p", 0.5))
    assert made.group_by == ("k",) and made.select == ("k", "c", "count_v", "p")


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT a", "SELECT a FROM other", "SELECT a FROM records WHERE", "SELECT a FROM records WHERE a", "SELECT a FROM records WHERE a = ", "SELECT a FROM records WHERE (a = 1", "SELECT a FROM records x", "SELECT a, FROM records", "SELECT a FROM records WHERE a = 'x", "SELECT a FROM records LIMIT x", "SELECT SUM(*) FROM records", "SELECT a FROM records WHERE a NOT = 1", "SELECT # FROM records"])
def test_sql_syntax_errors(text):
    with pytest.raises(QueryParseError):
        sql(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a FROM records JOIN b", "SELECT a FROM records, b", "SELECT a FROM (SELECT 1)", "WITH x AS (SELECT 1) SELECT a FROM x", "SELECT a FROM records UNION SELECT b FROM records", "INSERT INTO records", "SELECT SUM(a) OVER (x) FROM records",
        "SELECT PERCENTILE_CONT(0.5) OVER (x) FROM records", "SELECT a FROM records GROUP BY a HAVING a > 1", "SELECT a * 2 FROM records", "SELECT ABS(a) FROM records", "SELECT COUNT(DISTINCT a) FROM records", "SELECT a FROM records WHERE a IN (1)",
        "SELECT a FROM records LIMIT 1 OFFSET 2", "SELECT a FROM records WHERE EXISTS(SELECT a FROM records)", "SELECT a FROM records WHERE a = (SELECT 1)",
    ],
)
def test_sql_unsupported(text):
    with pytest.raises(UnsupportedQueryFeatureError):
        sql(text)


@pytest.mark.parametrize("text", ["SELECT a FROM records LIMIT 0", "SELECT a FROM records LIMIT 1.5", "SELECT PERCENTILE_CONT(2) WITHIN GROUP (ORDER BY a) FROM records", "SELECT a, COUNT(*) FROM records", "SELECT a FROM records WHERE a REGEXP '(x+)+'", "SELECT a FROM records WHERE a LIKE 5"])
def test_sql_invalid(text):
    with pytest.raises(QueryValidationError):
        sql(text)


def test_options():
    assert sql("SELECT a FROM records", {"limit": 5, "distinct": True}) == QueryRequest(select=("a",), limit=5, distinct=True)
    assert sql("SELECT a FROM records LIMIT 5", {"limit": 5}).limit == 5
    for text, options in (("SELECT a FROM records LIMIT 4", {"limit": 5}), ("SELECT a FROM records", {"select": ["b"]}), ("SELECT a FROM records ORDER BY a", {"orderBy": [{"field": "b"}]})):
        with pytest.raises(QueryValidationError):
            sql(text, options)
    made = lucene("a:1", {"groupBy": ["k"], "aggregates": [{"fn": "count", "as": "c"}], "orderBy": [{"field": "c", "direction": "desc"}], "limit": 10})
    assert made == QueryRequest(Comparison("a", "=", 1), (), (Aggregate("count", None, "c"),), ("k",), (OrderBy("c", "desc"),), 10)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a:1", Comparison("a", "=", 1)), ("a:-1.5", Comparison("a", "=", -1.5)), ("a:x", Comparison("a", "=", "x")), ('a:"1"', Comparison("a", "=", "1")), (r'm:"say \"\\hi\""', Comparison("m", "=", 'say "\\hi"')),
        ("a:true", Comparison("a", "=", True)), ("a:null", Comparison("a", "is_null")), ("a:NULL", Comparison("a", "is_null")), ('a:"null"', Comparison("a", "=", "null")), ("a:*", Comparison("a", "exists")), ("NOT a:*", Comparison("a", "not_exists")),
        ("u.p:JP AND b:2 OR NOT c:3", Or((And((Comparison("u.p", "=", "JP"), Comparison("b", "=", 2))), Not(Comparison("c", "=", 3))))), ("(a:1 OR b:2) AND c:3", And((Or((Comparison("a", "=", 1), Comparison("b", "=", 2))), Comparison("c", "=", 3)))),
        ("a:[1 TO 2]", Comparison("a", "between", range=(1, 2))), ('a:["1" TO b]', Comparison("a", "between", range=("1", "b"))), ("a:{1 TO 2}", And((Comparison("a", ">", 1), Comparison("a", "<", 2)))),
        ("timestamp:[2025-01-01 TO \"2025-01-01T00:00:00.001Z\"]", Comparison("timestamp", "between", range=(1735689600000, 1735689600001))), ("timestamp:{2025-01-01 TO 1735689600009}", And((Comparison("timestamp", ">", 1735689600000), Comparison("timestamp", "<", 1735689600009)))),
        ('timestamp:"2025-01-01T09:00:00+09:00"', Comparison("timestamp", "=", 1735689600000)), ("a:x*", Comparison("a", "like", "x%")), ("a:?x", Comparison("a", "like", "_x")), ("a:5%*", Comparison("a", "regexp", "^5%[^]*$")), (r"a:/^x\/y+/", Comparison("a", "regexp", "^x/y+")),
        (r"a\.b:1", Comparison(r"a\.b", "=", 1)), ("", None),
    ],
)
def test_lucene(text, want):
    assert lucene(text).where == want


@pytest.mark.parametrize("text", ["a", "a:", "a:1 b:2", "(a:1", "a:1)", 'a:"x', r'a:"\n"', "a:[1 TO 2}", "a:[1 2]", "a:[ TO 2]", "a:/x", "AND a:1", "a:1 AND", 'a:"x"y', "a:x[1]"])
def test_lucene_syntax_errors(text):
    with pytest.raises(QueryParseError):
        lucene(text)


@pytest.mark.parametrize("text", ["a:x~", "a:x~2", 'a:"x y"~3', "a:x^2", 'a:"x"^2', "a:(x OR y)", "a:[* TO 3]"])
def test_lucene_unsupported(text):
    with pytest.raises(UnsupportedQueryFeatureError):
        lucene(text)


@pytest.mark.parametrize("text", ["timestamp:yesterday", "timestamp:[2025-01-01 TO soon]", "a:/(x+)+/"])
def test_lucene_invalid(text):
    with pytest.raises(QueryValidationError):
        lucene(text)
