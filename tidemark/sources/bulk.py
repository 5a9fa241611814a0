"""Bulk ingest: validate, number and size many records at once, on the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TidemarkError, ValidationError
from ..functions.validation import clone_payload, encoded_bytes, epoch_ms
from ..shipping import ship
from .checkpoints import checkpointed


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        times, sizes, bodies, errors = [], [], [], []
        for raw, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            try:
                ts = epoch_ms(raw)
                payload = clone_payload(json.loads(body) if body is not None else None)
                found = (ts, encoded_bytes(ts, payload), body, None)
            except (TidemarkError, ValueError, RecursionError) as e:
                found = (None, None, None, f"{type(e).__name__}: {e}")
            for column, value in zip((times, sizes, bodies, errors), found, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(times, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.string()), pa.array(errors, pa.string())],
            ["source_key", "timestamp", "encoded_bytes", "body", "error"],
        )


def check_records(rows: DataFrame, timestamp: str = "timestamp", payload: str = "payload", key: str = "source_key") -> DataFrame:
    """(source_key, timestamp, encoded_bytes, payload, error) of rows with a JSON payload; error tells what breaks a rule."""
    if dict(rows.dtypes)[key] not in ("bigint", "int"):
        raise ValidationError("the source key must be a whole number")
    ship(rows.sparkSession)
    made = rows.select(F.col(key).cast("long").alias("source_key"), timestamp, payload).mapInArrow(_checked, "source_key long, timestamp long, encoded_bytes long, body string, error string")
    return made.select("source_key", "timestamp", "encoded_bytes", F.parse_json("body").alias("payload"), "error")


def number_records(rows: DataFrame, key: str = "source_key", start: int = 0) -> DataFrame:
    """rows with insertion_order start, start + 1, ... in key order, without a single task that sees them all.

    Keys are dealt to ranges of about equal size, whatever their distribution; a row's number is its place in its range and the
    count of the ranges before.
    """
    parts = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id())
    parts = checkpointed(parts)  # places must not change between the two uses
    counts = parts.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    out = parts.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(offsets), "__part")
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("insertion_order", F.lit(start) + F.col("__offset") + place).drop("__part", "__at", "__offset")
