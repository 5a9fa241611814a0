"""From a request to a DataFrame: filter, then aggregate or sort, project, distinct, limit.

Nothing runs while a plan is built, but for two cases: budgets (which have to count) and the default
projection of schemaless records (which has to find their keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..operators.aggregation import aggregate
from ..operators.ordering import sort_keys, typed_parts
from ..operators.predicates import compile_filter
from ..sources.records import RecordView
from .request import Comparison, Projection, QueryLimits, QueryRequest, validate


def value_column(view: RecordView, path: str) -> Column:
    value = view.field(path).value
    return F.lit(None).cast("string") if value is None else value


def projection_column(item: Projection, view: RecordView) -> Column:
    if item.field is not None:
        return value_column(view, item.field)
    total = None
    for sign, term in item.terms:
        if isinstance(term, str):
            number = view.field(term).number
            column = F.lit(None).cast("double") if number is None else number
        else:
            column = F.lit(term)
        total = (column if sign == 1 else -column) if total is None else (total + column if sign == 1 else total - column)
    return total


def project(request: QueryRequest, view: RecordView, rows: DataFrame) -> list[Projection]:
    if request.select:
        items = [Projection.of(x) for x in request.select]
    else:
        items = [Projection.of(x) for x in view.with_frame(rows).default_fields()]
    names = [p.alias for p in items]
    if len(set(names)) < len(names):
        raise QueryValidationError("output columns need different names")
    return items


def over_budget(frame: DataFrame, most: int | None, what: str) -> None:
    if most is not None and frame.limit(most + 1).count() > most:
        raise QueryValidationError(f"query {what} more than {most} rows")


def execute(request: QueryRequest, view: RecordView, limits: QueryLimits | None = None) -> DataFrame:
    """The rows that a request asks for."""
    limits = QueryLimits.unbounded() if limits is None else limits
    validate(request, limits)
    over_budget(view.frame, limits.scanned, "scans")
    rows = view.frame if request.where is None else view.frame.filter(compile_filter(request.where, view))
    if request.aggregates or request.group_by:
        result = aggregate(request, view, rows)
    else:
        result = _records(request, view, rows)
    if request.limit is not None:
        result = result.limit(request.limit)
    over_budget(result, limits.output, "returns")
    return result


def _records(request: QueryRequest, view: RecordView, rows: DataFrame) -> DataFrame:
    items = project(request, view, rows)
    keys = sort_keys(request.order_by, view)
    columns = [projection_column(p, view).alias(p.alias) for p in items]
    if not request.distinct:
        return rows.orderBy(*keys).select(*columns)
    # keep the first of equal output rows, in sort order
    parts: list[Column] = []
    for p in items:
        parts += typed_parts(view.field(p.field), view) if p.field is not None else [projection_column(p, view)]
    numbered = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*parts).orderBy(*keys))).filter("__nth = 1")
    return numbered.orderBy(*keys).select(*columns)


def select_range(view: RecordView, start: int, end: int) -> DataFrame:
    """Rows of view with start <= timestamp <= end, in logical order."""
    inside = compile_filter(Comparison("timestamp", "between", range=(start, end)), view)
    return view.frame.filter(inside).orderBy(view.timestamp(), view.order())
