"""Filters as Spark columns.

Logic is two-valued: a test is true or false, never unknown. Where a filter only drops rows an unknown does no harm, so tests
that no NOT stands over stay bare and reach the file scan; tests under NOT are made false where unknown.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..functions.patterns import java_regexp, like_pattern
from ..plans.request import And, Comparison, Filter, Not, Or, Scalar
from ..sources.records import Field, RecordView, moment_literal

TRUE, FALSE = (lambda: F.lit(True)), (lambda: F.lit(False))


def compile_filter(node: Filter, view: RecordView, exact: bool = False) -> Column:
    """The filter as a column; with exact, never null."""
    match node:
        case And(items):
            return reduce(Column.__and__, (compile_filter(x, view, exact) for x in items), TRUE()) if items else TRUE()
        case Or(items):
            return reduce(Column.__or__, (compile_filter(x, view, exact) for x in items)) if items else FALSE()
        case Not(item):
            return ~compile_filter(item, view, exact=True)
        case Comparison():
            found = compile_test(node, view)
            return F.coalesce(found, FALSE()) if exact else found
    raise QueryValidationError(f"not a filter: {node!r}")


def compile_test(test: Comparison, view: RecordView) -> Column:
    field = view.field(test.field)
    match test.operator:
        case "exists":
            return field.exists
        case "not_exists":
            return ~field.exists
        case "is_null":
            return field.null
        case "is_not_null":
            return field.exists & ~field.null
        case "=":
            return equals(field, test.value)
        case "!=":
            return field.scalar & ~F.coalesce(equals(field, test.value), FALSE())
        case "like" if isinstance(test.value, str):
            pattern = like_pattern(test.value)
            return FALSE() if field.string is None else field.string.like(pattern)
        case "regexp" if isinstance(test.value, str):
            pattern = java_regexp(test.value)
            return FALSE() if field.string is None else field.string.rlike(pattern)
        case "like" | "regexp":
            return FALSE()
        case "between":
            low, high = test.range
            if isinstance(low, str) != isinstance(high, str):
                return FALSE()
            return ordered(field, ">=", low, view) & ordered(field, "<=", high, view)
    return ordered(field, test.operator, test.value, view)


def _is_number(value: Scalar) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def equals(field: Field, value: Scalar) -> Column:
    """Strict equality: values of different types differ."""
    if value is None:
        return field.null
    if isinstance(value, bool):
        return FALSE() if field.boolean is None else field.boolean == F.lit(value)
    if isinstance(value, str):
        return FALSE() if field.string is None else field.string == F.lit(value)
    if field.number is None:
        return FALSE()
    if field.moment is not None:
        return moment_test(field, "=", value)
    return field.number == number_literal(value)


def number_literal(value: float) -> Column:
    if isinstance(value, int) and abs(value) >= 1 << 63:
        value = float(value)
    return F.lit(value)


def ordered(field: Field, operator: str, value: Scalar, view: RecordView) -> Column:
    """Order of numbers with numbers and strings with strings; false for anything else."""
    if isinstance(value, str):
        if field.string is None:
            return FALSE()
        left, right = view.string_key(field.string), view.string_literal(value)
    elif _is_number(value):
        if field.number is None:
            return FALSE()
        if field.moment is not None:
            return moment_test(field, operator, value)
        left, right = field.number, number_literal(value)
    else:
        return FALSE()
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[operator]


def moment_test(field: Field, operator: str, value: float) -> Column:
    """A test of epoch milliseconds, on the timestamp column itself so that file statistics apply.

    A moment's milliseconds are its floor: ms >= v is moment >= ceil(v), ms > v is moment >= floor(v) + 1, and so on.
    """
    column, no_zone = field.moment

    def bound(ms: int, at_least: bool) -> Column:
        literal = moment_literal(ms, no_zone)
        if literal is None:
            return column.isNotNull() & F.lit((ms < 0) == at_least)
        return column >= literal if at_least else column < literal

    match operator:
        case "=":
            return bound(int(value), True) & bound(int(value) + 1, False) if value == int(value) else FALSE()
        case ">":
            return bound(math.floor(value) + 1, True)
        case ">=":
            return bound(math.ceil(value), True)
        case "<":
            return bound(math.ceil(value), False)
    return bound(math.floor(value) + 1, False)
