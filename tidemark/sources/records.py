"""Record views: one way to read fields, over typed tables and over schemaless payloads.

A field has up to three faces: number, string and boolean. Over a table a column has one of them by its type; over
a VARIANT payload each face is guarded by the value's own type, since nothing may be coerced.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryValidationError
from ..functions.paths import split_path, variant_at

NUMBER_TAGS = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
#: Columns that the default projection of schemaless records can have.
MOST_KEYS = 4096


@dataclass(frozen=True)
class Field:
    """A field as columns. A face that the field cannot have is None."""

    exists: Column
    null: Column
    number: Column | None = None
    string: Column | None = None
    boolean: Column | None = None
    #: The value as one column, null if missing, null or an object.
    value: Column | None = None
    #: Present as null or a scalar.
    scalar: Column | None = None
    static: bool = True
    #: A timestamp column that `number` is computed from: (column, whether it has no zone).
    moment: tuple[Column, bool] | None = None




def missing() -> Field:
    return Field(F.lit(False), F.lit(False), value=F.lit(None).cast("string"), scalar=F.lit(False))


class RecordView:
    """Rows of (timestamp, insertion_order, fields)."""

    frame: DataFrame
    #: Strings compare by UTF-16 units, as in ECMAScript, rather than by code points.
    utf16: bool
    dynamic: bool

    def field(self, path: str) -> Field:
        if path == "timestamp":
            return self.timestamp_field()
        if path == "_id":
            value = F.concat_ws(":", self.timestamp().cast("string"), self.order().cast("string"))
            return Field(F.lit(True), F.lit(False), string=value, value=value, scalar=F.lit(True))
        return self.payload_field(path)

    def timestamp(self) -> Column:
        raise NotImplementedError

    def order(self) -> Column:
        raise NotImplementedError

    def timestamp_field(self) -> Field:
        return Field(F.lit(True), F.lit(False), number=self.timestamp(), value=self.timestamp(), scalar=F.lit(True))

    def payload_field(self, path: str) -> Field:
        raise NotImplementedError

    def string_key(self, value: Column) -> Column:
        """A key that sorts as strings compare."""
        return F.encode(value, "UTF-16BE") if self.utf16 else value

    def string_literal(self, value: str) -> Column:
        return F.lit(value.encode("utf-16-be", "surrogatepass")) if self.utf16 else F.lit(value)

    def with_frame(self, frame: DataFrame) -> RecordView:
        raise NotImplementedError


class TableView(RecordView):
    """A table as records. A null in a column is an explicit null; a path without a column is missing.

    timestamp: a column of epoch milliseconds or of timestamps; order: a whole-number column that is unique among equal
    timestamps; columns: canonical path -> column (default: every other column, by name).
    """

    dynamic = False

    def __init__(self, frame: DataFrame, timestamp: str, order: str, columns: Mapping[str, str | Column] | None = None, utf16: bool = False) -> None:
        self.frame, self.utf16 = frame, utf16
        self._timestamp, self._order = timestamp, order
        self.columns = dict(columns) if columns is not None else {c: F.col(f"`{c}`") for c in frame.columns if c != timestamp}
        self.columns = {k: F.col(f"`{v}`") if isinstance(v, str) else v for k, v in self.columns.items()}
        self._types = {k: frame.select(v.alias("c")).schema["c"].dataType for k, v in self.columns.items()}
        self._time_type = frame.schema[timestamp].dataType

    def with_frame(self, frame: DataFrame) -> TableView:
        return TableView(frame, self._timestamp, self._order, self.columns, self.utf16)

    def timestamp(self) -> Column:
        raw = F.col(f"`{self._timestamp}`")
        return F.unix_millis(raw.cast("timestamp")) if isinstance(self._time_type, T.TimestampType | T.TimestampNTZType) else raw

    def timestamp_field(self) -> Field:
        raw = F.col(f"`{self._timestamp}`")
        moment = (raw, isinstance(self._time_type, T.TimestampNTZType)) if isinstance(self._time_type, T.TimestampType | T.TimestampNTZType) else None
        return Field(F.lit(True), F.lit(False), number=self.timestamp(), value=self.timestamp(), scalar=F.lit(True), moment=moment)

    def order(self) -> Column:
        return F.col(f"`{self._order}`")

    def default_fields(self) -> list[str]:
        """Fields of the default projection."""
        return ["timestamp", *(p for p in self.columns if len(split_path(p)) == 1 and p != "timestamp" and self.payload_field(p).value is not None)]

    def payload_field(self, path: str) -> Field:
        if path not in self.columns:
            return missing()
        column, kind = self.columns[path], self._types[path]
        face = {"exists": F.lit(True), "null": column.isNull(), "value": column, "scalar": F.lit(True)}
        if isinstance(kind, T.NumericType):
            return Field(number=column, **face)
        if isinstance(kind, T.StringType):
            return Field(string=column, **face)
        if isinstance(kind, T.BooleanType):
            return Field(boolean=column, **face)
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            ms = F.unix_millis(column.cast("timestamp"))
            return Field(number=ms, moment=(column, isinstance(kind, T.TimestampNTZType)), **face | {"value": ms})
        if isinstance(kind, T.DateType):
            text = column.cast("string")
            return Field(string=text, **face | {"value": text})
        # arrays, structs, maps and binaries are not addressable as scalars
        return Field(F.lit(True), F.lit(False), value=None, scalar=F.lit(False))


class PayloadView(RecordView):
    """Records with a VARIANT payload: columns timestamp (epoch ms), insertion_order and payload."""

    dynamic = True

    def __init__(self, frame: DataFrame, utf16: bool = True, objects_exist: bool = True) -> None:
        self.frame, self.utf16, self.objects_exist = frame, utf16, objects_exist

    def with_frame(self, frame: DataFrame) -> PayloadView:
        return PayloadView(frame, self.utf16, self.objects_exist)

    def timestamp(self) -> Column:
        return F.col("timestamp")

    def order(self) -> Column:
        return F.col("insertion_order")

    def payload_field(self, path: str) -> Field:
        found = variant_at(F.col("payload"), split_path(path))
        tag = F.schema_of_variant(found)
        nested = tag.startswith("OBJECT") | tag.startswith("ARRAY")
        exists = tag.isNotNull()
        scalar = F.coalesce(~nested, F.lit(False))
        return Field(
            exists=exists if self.objects_exist else scalar,
            null=F.coalesce(F.is_variant_null(found), F.lit(False)),
            number=F.when(tag.rlike(NUMBER_TAGS), F.try_variant_get(found, "$", "double")),
            string=F.when(tag == "STRING", F.try_variant_get(found, "$", "string")),
            boolean=F.when(tag == "BOOLEAN", F.try_variant_get(found, "$", "boolean")),
            value=F.when(~nested & (tag != "VOID"), found),
            scalar=scalar,
            static=False,
        )

    def default_fields(self) -> list[str]:
        """timestamp and every top-level key that holds a scalar or null somewhere (reads the data); refused beyond MOST_KEYS keys."""
        entries = self.frame.select(F.explode(F.expr("cast(payload as map<string,variant>)")).alias("key", "value"))
        tag = F.schema_of_variant("value")
        scalars = entries.filter(~(tag.startswith("OBJECT") | tag.startswith("ARRAY")) & (F.col("key") != "timestamp"))
        keys = scalars.select("key").distinct().limit(MOST_KEYS + 1).collect()
        if len(keys) > MOST_KEYS:
            raise QueryValidationError(f"records have more than {MOST_KEYS} top-level keys; name the fields to select")
        from ..functions.paths import escape_segment

        return ["timestamp", *sorted(escape_segment(r[0]) for r in keys)]


_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def moment_literal(ms: int, no_zone: bool) -> Column | None:
    """A timestamp literal; None beyond the years 1 to 9999."""
    try:
        at = _EPOCH + timedelta(milliseconds=ms)
    except OverflowError:
        return None
    text = at.strftime("%Y-%m-%d %H:%M:%S.%f") if at.year >= 1000 else f"{at.year:04d}" + at.strftime("-%m-%d %H:%M:%S.%f")
    return F.expr(f"timestamp_ntz'{text}'" if no_zone else f"timestamp_ltz'{text}+00:00'")
