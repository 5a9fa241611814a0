"""Query requests: what a query asks for, independent of language and of the data's form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

from ..errors import QueryValidationError

Scalar = str | int | float | bool | None

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "like", "regexp", "is_null", "is_not_null", "exists", "not_exists", "between")
FUNCTIONS = ("count", "min", "max", "sum", "avg", "percentile_cont")


@dataclass(frozen=True)
class Comparison:
    """A test of one field."""

    field: str
    operator: str
    value: Scalar = None
    range: tuple[Scalar, Scalar] | None = None


@dataclass(frozen=True)
class And:
    items: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Or:
    items: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Not:
    item: Filter


Filter = Comparison | And | Or | Not


@dataclass(frozen=True)
class Projection:
    """A field, or the sum or difference of fields and numbers: (sign, field or number) terms."""

    terms: tuple[tuple[int, str | float], ...]
    alias: str

    @staticmethod
    def of(item: str | Projection) -> Projection:
        return item if isinstance(item, Projection) else Projection(((1, item),), item)

    @property
    def field(self) -> str | None:
        """The field, if that is all."""
        sign, name = self.terms[0]
        return name if len(self.terms) == 1 and sign == 1 and isinstance(name, str) else None


@dataclass(frozen=True)
class OrderBy:
    field: str
    direction: str = "asc"


@dataclass(frozen=True)
class Aggregate:
    fn: str
    field: str | None = None
    alias: str | None = None
    percentile: float | None = None

    @property
    def name(self) -> str:
        return self.alias or (self.fn if self.field is None else f"{self.fn}_{self.field}")


@dataclass(frozen=True)
class QueryLimits:
    """Budgets of a query; None is without bound."""

    scanned: int | None = 10_000
    output: int | None = 5_000
    depth: int | None = 64

    @staticmethod
    def unbounded() -> QueryLimits:
        return QueryLimits(None, None, None)


@dataclass(frozen=True)
class ExecutionOptions:
    """Controls that come beside a query text."""

    select: tuple[str | Projection, ...] | None = None
    aggregates: tuple[Aggregate, ...] | None = None
    group_by: tuple[str, ...] | None = None
    order_by: tuple[OrderBy, ...] | None = None
    limit: int | None = None
    distinct: bool | None = None


@dataclass(frozen=True)
class QueryRequest:
    where: Filter | None = None
    select: tuple[str | Projection, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    limit: int | None = None
    distinct: bool = False
    extra: Mapping[str, Any] = field(default_factory=dict, compare=False, hash=False)

    def with_options(self, options: ExecutionOptions | None) -> QueryRequest:
        """This request with the controls that options give, which must not contradict its own."""
        if options is None:
            return self
        changed: dict[str, Any] = {}
        for f in fields(options):
            new, old = getattr(options, f.name), getattr(self, f.name)
            if new is None:
                continue
            if old not in ((), None, False) and old != new:
                raise QueryValidationError(f"query text and options give different values for {f.name}")
            changed[f.name] = new
        return replace(self, **changed)


def validate(request: QueryRequest, limits: QueryLimits) -> None:
    """Checks the shape of a request; raises QueryValidationError."""
    if request.where is not None:
        _validate_filter(request.where, 0, limits.depth)
    if request.limit is not None and (isinstance(request.limit, bool) or not isinstance(request.limit, int) or request.limit < 1):
        raise QueryValidationError("limit must be a positive integer")
    for order in request.order_by:
        if order.direction not in ("asc", "desc"):
            raise QueryValidationError(f"direction must be asc or desc, not {order.direction!r}")
    for a in request.aggregates:
        if a.fn not in FUNCTIONS:
            raise QueryValidationError(f"no aggregate {a.fn!r}")
        if a.field is None and a.fn != "count":
            raise QueryValidationError(f"{a.fn} needs a field")
        if a.fn == "percentile_cont" and (isinstance(a.percentile, bool) or not isinstance(a.percentile, int | float) or not 0 <= a.percentile <= 1):
            raise QueryValidationError("percentile must be a number from 0 to 1")
    names = [a.name for a in request.aggregates]
    if len(set(names)) < len(names):
        raise QueryValidationError("aggregates need different names")


def _is_scalar(value: object) -> bool:
    return value is None or isinstance(value, str | bool | int | float) and value == value and value not in (float("inf"), float("-inf"))


def _validate_filter(node: Filter, depth: int, most: int | None) -> None:
    if most is not None and depth > most:
        raise QueryValidationError(f"filter nesting is deeper than {most}")
    match node:
        case And(items) | Or(items):
            for item in items:
                _validate_filter(item, depth + 1, most)
        case Not(item):
            _validate_filter(item, depth + 1, most)
        case Comparison(_, operator, value, bounds):
            if operator not in OPERATORS:
                raise QueryValidationError(f"no operator {operator!r}")
            if operator == "between" and (bounds is None or len(bounds) != 2):
                raise QueryValidationError("between needs a range of two values")
            if not all(map(_is_scalar, (value, *(bounds or ())))):
                raise QueryValidationError("values must be strings, finite numbers, booleans or null")
        case _:
            raise QueryValidationError(f"not a filter: {node!r}")


def filter_from(tree: Mapping[str, Any]) -> Filter:
    """A filter from nested mappings: {and: []}, {or: []}, {not: ...} or {field, operator, value, range}."""
    if "and" in tree:
        return And(tuple(map(filter_from, tree["and"])))
    if "or" in tree:
        return Or(tuple(map(filter_from, tree["or"])))
    if "not" in tree:
        return Not(filter_from(tree["not"]))
    bounds = tree.get("range")
    return Comparison(tree["field"], tree["operator"], tree.get("value"), None if bounds is None else tuple(bounds))


def _order(items: Sequence[Any]) -> tuple[OrderBy, ...]:
    return tuple(x if isinstance(x, OrderBy) else OrderBy(x["field"], x.get("direction", "asc")) for x in items)


def _aggregates(items: Sequence[Any]) -> tuple[Aggregate, ...]:
    return tuple(x if isinstance(x, Aggregate) else Aggregate(x["fn"], x.get("field"), x.get("as"), x.get("percentile")) for x in items)


def request_from(tree: Mapping[str, Any]) -> QueryRequest:
    """A request from nested mappings with the keys where, select, aggregates, groupBy, orderBy, limit, distinct."""
    return QueryRequest(
        where=None if tree.get("where") is None else filter_from(tree["where"]),
        select=tuple(tree.get("select") or ()),
        aggregates=_aggregates(tree.get("aggregates") or ()),
        group_by=tuple(tree.get("groupBy") or ()),
        order_by=_order(tree.get("orderBy") or ()),
        limit=tree.get("limit"),
        distinct=bool(tree.get("distinct")),
    )


def options_from(tree: Mapping[str, Any] | ExecutionOptions | None) -> ExecutionOptions | None:
    """Options from a mapping with the keys select, aggregates, groupBy, orderBy, limit, distinct."""
    if tree is None or isinstance(tree, ExecutionOptions):
        return tree
    pick = lambda key, made: None if tree.get(key) is None else made(tree[key])
    return ExecutionOptions(pick("select", tuple), pick("aggregates", _aggregates), pick("groupBy", tuple), pick("orderBy", _order), tree.get("limit"), tree.get("distinct"))
