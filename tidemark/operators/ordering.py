"""Order across types: null and missing, then booleans, numbers and strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.request import OrderBy
from ..sources.records import Field, RecordView


def typed_parts(field: Field, view: RecordView) -> list[Column]:
    """Columns that together stand for a field's value: rank, boolean, number, string; only the faces it can have."""
    faces = [(f, r) for f, r in ((field.boolean, 1), (field.number, 2), (field.string, 3)) if f is not None]
    if not faces:
        return [F.lit(0)]
    if field.static:
        return [faces[0][0]]
    rank = F.lit(0)
    for face, r in faces:
        rank = F.when(face.isNotNull(), F.lit(r)).otherwise(rank)
    return [rank, *(f for f, _ in faces)]


def sort_keys(order: Sequence[OrderBy], view: RecordView, tie_break: bool = True) -> list[Column]:
    """Sort columns for an order; ties go by timestamp and insertion order, ascending."""
    keys = []
    for item in order:
        field = view.field(item.field)
        parts = typed_parts(field, view)
        if field.string is not None:
            parts[-1] = view.string_key(parts[-1])
        keys += [p.asc_nulls_first() if item.direction == "asc" else p.desc_nulls_last() for p in parts]
    return [*keys, *([view.timestamp().asc(), view.order().asc()] if tie_break else [])]
