"""Bounded size: which records stay, for records that come in insertion order.

strict accepts a record if it fits beside those accepted before; turnover evicts the oldest by (timestamp, insertion order)
until the new one fits. Records larger than the bound never enter.

Where timestamps never fall in insertion order, turnover keeps the longest suffix that fits, found by sums over slices of time.
Otherwise the outcome depends on every step, and one task folds the stream with a heap of at most `most` bytes
of records (24 bytes of state each); ids and sizes alone go there, never payloads.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..shipping import ship

_UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}
_TIMES = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}
SAFE = 2**53 - 1


def _amount(value: int | str, units: dict[str, int], what: str) -> int:
    if isinstance(value, str):
        m = re.fullmatch(rf"(\d+)({'|'.join(units)})", value, re.ASCII)
        value = int(m[1]) * units[m[2]] if m else 0
    if isinstance(value, bool) or not isinstance(value, int) or not 0 < value <= SAFE:
        raise ConfigurationError(f"{what} must be positive: a whole number or a string like {'1' + list(units)[1]}")
    return value


def parse_size(value: int | str) -> int:
    """Bytes of a size such as 500 or 4KB."""
    return _amount(value, _UNITS, "capacity.max_size")


def parse_policy(value: str | None) -> str:
    if value not in (None, "strict", "turnover"):
        raise ConfigurationError("capacity.policy must be strict or turnover")
    return value or "strict"


def parse_frequency(value: int | str | None) -> int | None:
    """Milliseconds between commits; None: with every insert."""
    return None if value in (None, "immediate") else _amount(value, _TIMES, "auto_commit.frequency")


def strict(sizes: list[int], most: int) -> list[bool]:
    """Which of a stream's records a strict bound accepts."""
    held, out = 0, []
    for n in sizes:
        out.append(held + n <= most)
        held += n if out[-1] else 0
    return out


def _fold(batches: Iterator[pa.RecordBatch], most: int, policy: str) -> Iterator[pa.RecordBatch]:
    held, heap = 0, []
    for batch in batches:
        kept = []
        for ts, order, n in zip(*(batch.column(c).to_pylist() for c in ("timestamp", "insertion_order", "encoded_bytes")), strict=True):
            if n > most or (policy == "strict" and held + n > most):
                continue
            while held + n > most:
                held -= heapq.heappop(heap)[2]
            held += n
            if policy == "strict":
                kept.append(order)
            else:
                heapq.heappush(heap, (ts, order, n))
        if kept:
            yield pa.RecordBatch.from_pydict({"insertion_order": pa.array(kept, pa.int64())})
    if heap:
        yield pa.RecordBatch.from_pydict({"insertion_order": pa.array([x[1] for x in heap], pa.int64())})


def in_order(records: DataFrame) -> bool:
    """Whether timestamps never fall in insertion order: each range of orders must begin after the one before ends."""
    ranges = records.select("insertion_order", "timestamp").repartitionByRange("insertion_order").sortWithinPartitions("insertion_order")
    step = ranges.withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("insertion_order")
    falls = step.withColumn("before", F.lag("timestamp").over(within))
    parts = falls.groupBy("part").agg(F.min("insertion_order").alias("first"), F.min_by("timestamp", "insertion_order").alias("head"), F.max_by("timestamp", "insertion_order").alias("tail"), F.max(F.col("timestamp") < F.col("before")).alias("falls"))
    rows = sorted(parts.collect(), key=lambda r: r["first"])  # one row per partition
    return not any(r["falls"] for r in rows) and all(a["tail"] <= b["head"] for a, b in zip(rows, rows[1:], strict=False))


def retain(records: DataFrame, most: int, policy: str = "strict", assume_in_order: bool | None = None) -> DataFrame:
    """The records (timestamp, insertion_order, encoded_bytes, ...) that a bound of `most` bytes keeps."""
    thin = records.select("timestamp", "insertion_order", "encoded_bytes")
    if policy == "turnover" and (in_order(thin) if assume_in_order is None else assume_in_order):
        return _suffix(records.filter(F.col("encoded_bytes") <= most), most)
    ship(records.sparkSession)
    one = thin.filter(F.col("encoded_bytes") <= most).repartition(1).sortWithinPartitions("insertion_order")
    kept = one.mapInArrow(lambda batches: _fold(batches, most, policy), "insertion_order long")
    return records.join(kept, "insertion_order", "left_semi")


#: Slices that one pass tells apart; so many sums come to the driver.
SLICES = 1 << 14


def _cut(rows: DataFrame, key: str, room: int) -> tuple[int, int] | None:
    """(the greatest key whose rows don't all fit beside those of greater keys, the room that these leave); None if all fit.

    Each pass sums sizes per slice of the keys and goes on in the slice in which the bound falls.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low is not None:
        width = -(-(high - low + 1) // SLICES)
        inside = rows.filter(F.col(key).between(low, high)).groupBy(F.expr(f"({key} - {low}L) div {width}L").alias("slice"))
        for at, size in sorted(inside.agg(F.sum("encoded_bytes")).collect(), reverse=True):
            if size > room:
                break
            room -= size
        else:
            return None
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
        if width == 1:
            return low, room
    return None


def _suffix(records: DataFrame, most: int) -> DataFrame:
    """The longest suffix, by time and insertion order, of at most `most` bytes."""
    thin = records.select("timestamp", "insertion_order", "encoded_bytes")
    found = _cut(thin, "timestamp", most)
    if found is None:
        return records
    last, room = found
    # of the millisecond in which the bound falls, the newest that still fit
    order = _cut(thin.filter(F.col("timestamp") == last), "insertion_order", room)[0]
    return records.filter((F.col("timestamp") > last) | ((F.col("timestamp") == last) & (F.col("insertion_order") > order)))
