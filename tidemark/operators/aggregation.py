"""Aggregates and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..plans.request import Aggregate, QueryRequest
from ..sources.records import Field, RecordView
from .ordering import typed_parts


def _variant(parts: dict[str, Column]) -> Column:
    """The scalar of typed parts as a variant."""
    text = F.coalesce(
        F.when(parts["boolean"].isNotNull(), parts["boolean"].cast("string")),
        F.when(parts["number"].isNotNull(), F.to_json(F.struct(parts["number"].alias("v")))),
        F.when(parts["string"].isNotNull(), F.to_json(F.struct(parts["string"].alias("v")))),
    )
    return F.when(parts["boolean"].isNotNull(), F.parse_json(text)).when(text.isNotNull(), F.variant_get(F.parse_json(text), "$.v", "variant"))


def _packed(field: Field, view: RecordView) -> Column:
    """A dynamic field as a struct that orders and groups as values do; null if null or missing."""
    rank, *_ = typed_parts(field, view)
    key = view.string_key(field.string)
    return F.when(rank > 0, F.struct(rank.alias("rank"), field.boolean.alias("boolean"), field.number.alias("number"), key.alias("key"), field.string.alias("string")))


def _unpacked(packed: Column) -> Column:
    return _variant({k: packed[k] for k in ("boolean", "number", "string")})


def aggregate_column(item: Aggregate, view: RecordView) -> Column:
    """The aggregate as a column; the least and greatest of a dynamic field stay packed. Numeric aggregates skip what is no
    number; count and min/max skip null and missing.
    """
    if item.field is None:
        return F.count(F.lit(1))
    field = view.field(item.field)
    number = field.number if field.number is not None else F.lit(None).cast("double")
    match item.fn:
        case "count":
            return F.count(F.when(field.scalar & ~field.null, F.lit(1)))
        case "sum":
            return F.sum(number)
        case "avg":
            return F.avg(number)
        case "percentile_cont":
            return F.percentile(number, F.lit(float(item.percentile)))
    best = F.min if item.fn == "min" else F.max
    if not field.static:
        return best(_packed(field, view))
    if field.string is not None and view.utf16:
        return best(F.struct(view.string_key(field.string).alias("key"), field.string.alias("v")))["v"]
    return best(field.value)


def aggregate(request: QueryRequest, view: RecordView, rows: DataFrame) -> DataFrame:
    """Grouped or global aggregates, ordered by their output columns (ties by the group's keys)."""
    names = [*request.group_by, *(a.name for a in request.aggregates)]
    if len(set(names)) < len(names):
        raise QueryValidationError("group fields and aggregates need different names")
    wanted = [p if isinstance(p, str) else p.alias for p in request.select]
    if extra := [w for w in wanted if w not in names]:
        raise QueryValidationError(f"neither grouped nor aggregated: {', '.join(extra)}")
    fields = [view.field(g) for g in request.group_by]
    packed = [f.value if f.static else _packed(f, view) for f in fields]
    keys = [c.alias(f"__key{i}") for i, c in enumerate(packed)]
    made = [aggregate_column(a, view).alias(a.name) for a in request.aggregates]
    if request.group_by:
        grouped = rows.groupBy(*keys).agg(*made) if made else rows.select(*keys).distinct()
    else:
        grouped = rows.agg(*made)
    outputs = {g: F.col(f"__key{i}") if f.static else _unpacked(F.col(f"__key{i}")) for i, (g, f) in enumerate(zip(request.group_by, fields, strict=True))}
    for a in request.aggregates:
        dynamic = a.fn in ("min", "max") and not view.field(a.field).static
        outputs[a.name] = _unpacked(F.col(f"`{a.name}`")) if dynamic else F.col(f"`{a.name}`")
    if request.distinct and wanted:
        return _distinct_groups(request, grouped, wanted, outputs)
    order = _group_order(request, names)
    if order:
        grouped = grouped.orderBy(*order, *(F.col(f"__key{i}").asc_nulls_first() for i in range(len(keys))))
    return grouped.select(*(outputs[n].alias(n) for n in (wanted or names)))


def _group_order(request: QueryRequest, names: list[str]) -> list[Column]:
    order = []
    for item in request.order_by:
        if item.field not in names:
            raise QueryValidationError(f"cannot order groups by {item.field}")
        column = F.col(f"__key{request.group_by.index(item.field)}") if item.field in request.group_by else F.col(f"`{item.field}`")
        order.append(column.asc_nulls_first() if item.direction == "asc" else column.desc_nulls_last())
    return order


def _distinct_groups(request: QueryRequest, grouped: DataFrame, wanted: list[str], outputs: dict[str, Column]) -> DataFrame:
    """Of groups whose selected columns are equal, the first in order (ties by the group's keys)."""
    keys = [F.col(f"__key{i}") for i in range(len(request.group_by))]
    same = [F.col(f"__key{request.group_by.index(n)}") if n in request.group_by else F.col(f"`{n}`") for n in wanted]
    order = [*_group_order(request, [*request.group_by, *(a.name for a in request.aggregates)]), *(k.asc_nulls_first() for k in keys)]
    first = grouped.withColumn("__nth", F.row_number().over(Window.partitionBy(*same).orderBy(*(order or [F.lit(1)])))).filter("__nth = 1")
    if request.order_by:
        first = first.orderBy(*order)
    return first.select(*(outputs[n].alias(n) for n in wanted))
