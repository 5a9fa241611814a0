"""The datastore: records in, queries out.

Single inserts are kept in a buffer on the driver and join the committed generation (a DataFrame) when read; bulk
appends stay DataFrames. Queries return DataFrames and run when those are used.
"""

from __future__ import annotations

import heapq
import json
import re
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import (
    ClosedDatastoreError,
    ConfigurationError,
    IndexCorruptionError,
    InvalidQueryRangeError,
    QueryEngineNotRegisteredError,
    QuotaExceededError,
    StorageEngineError,
    UnsupportedBackendError,
    ValidationError,
)
from .functions.validation import clone_payload, encoded_bytes, epoch_ms
from .operators.retention import parse_frequency, parse_policy, parse_size
from .plans.compiler import execute, select_range
from .plans.request import ExecutionOptions, QueryLimits, QueryRequest, request_from
from .sources.bulk import check_records, number_records
from .sources.checkpoints import checkpointed
from .sources.records import PayloadView
from .sources.storage import SCHEMA, GenerationStore, resolve_path

MOST_ORDER = 2**63 - 1
#: Most records whose keys and sizes the driver holds to find the oldest.
SLICE = 100_000
#: Appends to a store that is not committed to files before its frame is written anew as one.
MOST_FRAMES = 16
#: Bytes of a page that its header and slot take.
PAGE_OVERHEAD = 36


class QueryEngineModule(Protocol):
    """A query language: turns text into a request."""

    language: str

    def to_native_query(self, text: str, options: Any = None) -> QueryRequest: ...


@dataclass(frozen=True)
class ErrorEvent:
    """A background failure, as listeners get it."""

    error: Exception
    occurred_at: float
    source: str = "autoCommit"


@dataclass
class _Capacity:
    most: int
    policy: str


def run_query_with_engine(db: Datastore, engine: QueryEngineModule, text: str, options: Any = None) -> DataFrame:
    """As Datastore.query, with an engine that need not be registered."""
    return db.query_native(engine.to_native_query(text, options))


class Datastore:
    """location: memory or file; capacity: {max_size, policy}; auto_commit: {frequency, max_pending_bytes}; file_path or target for files.

    page_size bounds single records (default: not bounded); strict_code_parity makes `exists` false for nested objects; files must lie in
    root (default: the working directory).
    """

    def __init__(
        self,
        spark: SparkSession,
        location: str = "memory",
        *,
        file_path: str | None = None,
        target: Mapping[str, Any] | None = None,
        capacity: Mapping[str, Any] | None = None,
        auto_commit: Mapping[str, Any] | None = None,
        limits: QueryLimits | None = None,
        strict_code_parity: bool = False,
        page_size: int | None = None,
        root: str | None = None,
    ) -> None:
        self.spark, self.limits, self._parity = spark, limits or QueryLimits(), strict_code_parity
        self._capacity = None if capacity is None else _Capacity(parse_size(capacity.get("max_size")), parse_policy(capacity.get("policy")))
        if page_size is not None and (isinstance(page_size, bool) or not isinstance(page_size, int) or page_size <= PAGE_OVERHEAD):
            raise ConfigurationError(f"page_size must be a whole number over {PAGE_OVERHEAD}")
        #: With a page size, a record must fit one page, whatever the capacity.
        self._most_record = None if page_size is None else page_size - PAGE_OVERHEAD
        self._lock = threading.RLock()
        self._engines: dict[str, QueryEngineModule] = {}
        self._listeners: list[Callable[[ErrorEvent], None]] = []
        self._closed = False
        #: order -> (timestamp, payload, size) of records that are not in the base.
        self._buffer: dict[int, tuple[int, dict[str, Any], int]] = {}
        self._base: DataFrame | None = None
        self._gone: set[int] = set()  # orders of the base that were evicted, deleted or replaced
        self._heap: list[tuple[int, int, int]] | None = None  # (timestamp, order, size) of the oldest, for turnover
        self._horizon: tuple[int, int] | None = None  # records after this key are not in the heap; None: all are
        self._dead: set[int] = set()  # orders in the heap that are no more
        self._resized: dict[int, int] = {}  # sizes of records in the heap that changed
        self._added: list[DataFrame] | None = []  # what was appended since the last commit; None: other things changed, too
        self._frames = 0
        self._streams: dict[str, int] = {}
        self._next_order = self._size = self._count = 0
        self._store: GenerationStore | None = None
        self._pending = self._dirty = 0
        self._timer: threading.Timer | None = None
        if location == "memory":
            if auto_commit is not None:
                raise ConfigurationError("auto_commit needs location file")
        elif location == "file":
            auto = dict(auto_commit or {})
            self._every = parse_frequency(auto.get("frequency"))
            self._most_pending = auto.get("max_pending_bytes")
            if self._most_pending is not None and (isinstance(self._most_pending, bool) or not isinstance(self._most_pending, int) or self._most_pending <= 0):
                raise ConfigurationError("auto_commit.max_pending_bytes must be a positive whole number")
            within = None if root is None else Path(root)
            self._store = GenerationStore(spark, resolve_path(file_path, None if target is None else dict(target), within), root=within)
            found = self._store.open()
            self._base, self._next_order, self._size, self._count = found.frame, found.next_order, found.size, found.count
            self._streams = dict(found.streams)
            self._schedule()
        else:
            raise UnsupportedBackendError(f"no storage {location!r}")

    @property
    def path(self) -> Path | None:
        return None if self._store is None else self._store.path

    def _ensure_open(self) -> None:
        if self._closed:
            raise ClosedDatastoreError("the datastore is closed")

    # writing

    def insert(self, record: Mapping[str, Any]) -> None:
        """Adds {timestamp, payload}."""
        with self._lock:
            self._ensure_open()
            if "insertionOrder" in record or "insertion_order" in record:
                raise ValidationError("insertion orders are assigned by the datastore")
            ts = epoch_ms(record.get("timestamp"))
            payload = clone_payload(record.get("payload"))
            if self._next_order > MOST_ORDER:
                raise IndexCorruptionError("insertion orders are used up")
            size = encoded_bytes(ts, payload)
            if self._most_record is not None and size > self._most_record:
                raise QuotaExceededError("the record doesn't fit a page")
            self._make_room(size)
            self._add(self._next_order, ts, payload, size)
            self._next_order += 1
            self._appended(size)

    def insert_many(self, records: Any) -> None:
        for r in records:
            self.insert(r)

    def append(self, rows: DataFrame, timestamp: str = "timestamp", payload: str = "payload", key: str = "source_key", batch: tuple[str, int] | None = None) -> None:
        """Adds many records from a DataFrame of (key, timestamp, JSON payload), in key order; all or none.

        With a capacity the bound is applied by `tidemark.operators.retention.retain` to all records at once. batch: a stream's name and
        the number of its batch; a batch that was appended before is left out.
        """
        with self._lock:
            self._ensure_open()
            if batch is not None and batch[1] <= self._streams.get(batch[0], -1):
                return
            checked = check_records(rows, timestamp, payload, key).cache()
            try:
                if bad := checked.filter("error is not null").select("source_key", "error").head(1):
                    raise ValidationError(f"record {bad[0]['source_key']}: {bad[0]['error']}")
                count, size = checked.agg(F.count(F.lit(1)), F.coalesce(F.sum("encoded_bytes"), F.lit(0))).first()
                added = number_records(checked, start=self._next_order).select("timestamp", "insertion_order", "encoded_bytes", "payload")
                if self._capacity is not None:
                    from .operators.retention import retain

                    if self._capacity.policy == "strict" and self._size + size > self._capacity.most:
                        raise QuotaExceededError("the records don't fit")
                    self._replace_base(checkpointed(retain(self._persisted().unionByName(added), self._capacity.most, self._capacity.policy)), self._next_order + count)
                else:
                    self._extend_base(checkpointed(added), int(count), int(size))
                if batch is not None:
                    self._streams[batch[0]] = batch[1]
                self._appended(int(size))
            finally:
                checked.unpersist()

    def _replace_base(self, frame: DataFrame, next_order: int) -> None:
        count, size = frame.agg(F.count(F.lit(1)), F.coalesce(F.sum("encoded_bytes"), F.lit(0))).first()
        self._base, self._buffer, self._gone, self._heap, self._added, self._frames = frame, {}, set(), None, None, 1
        self._next_order, self._size, self._count = next_order, int(size), int(count)

    def _extend_base(self, added: DataFrame, count: int, size: int) -> None:
        self._base = added if self._base is None else self._base.unionByName(added)
        self._frames += 1
        if self._frames > MOST_FRAMES:
            self._base, self._frames = checkpointed(self._base), 1
        if self._added is not None:
            self._added.append(added)
        self._heap = None
        self._next_order += count
        self._size += size
        self._count += count

    def _add(self, order: int, ts: int, payload: dict[str, Any], size: int) -> None:
        self._buffer[order] = (ts, payload, size)
        self._size += size
        self._count += 1
        if self._heap is not None and (self._horizon is None or (ts, order) <= self._horizon):
            heapq.heappush(self._heap, (ts, order, size))

    def _load_oldest(self) -> None:
        """The oldest SLICE records into the heap."""
        rows = self._persisted().select("timestamp", "insertion_order", "encoded_bytes").orderBy("timestamp", "insertion_order").limit(SLICE).collect()
        self._heap, self._dead, self._resized = [tuple(r) for r in rows], set(), {}
        self._horizon = self._heap[-1][:2] if len(rows) == SLICE else None

    def _make_room(self, size: int) -> None:
        if self._capacity is None:
            return
        if size > self._capacity.most:
            raise QuotaExceededError("the record is larger than the capacity")
        if self._size + size <= self._capacity.most:
            return
        if self._capacity.policy == "strict":
            raise QuotaExceededError("the capacity is used up")
        if self._heap is None:
            self._load_oldest()
        while self._size + size > self._capacity.most:
            if not self._heap and self._horizon is not None:
                self._load_oldest()
            if not self._heap:
                raise IndexCorruptionError("the time index is empty but space is used")
            _, order, freed = heapq.heappop(self._heap)
            if order in self._dead:
                self._dead.discard(order)
                continue
            self._drop(order)
            self._size -= self._resized.pop(order, freed)
            self._count -= 1

    def _drop(self, order: int) -> None:
        if self._buffer.pop(order, None) is None:
            self._gone.add(order)
            self._added = None

    # records by id

    def _find(self, record_id: str) -> tuple[int, int, dict[str, Any], int] | None:
        m = re.fullmatch(r"(-?\d+):(\d+)", record_id)
        if not m:
            return None
        ts, order = int(m[1]), int(m[2])
        if order in self._buffer:
            held = self._buffer[order]
            return (ts, order, held[1], held[2]) if held[0] == ts else None
        if self._base is None or order in self._gone:
            return None
        hit = self._base.filter((F.col("timestamp") == ts) & (F.col("insertion_order") == order)).select("encoded_bytes", F.to_json("payload").alias("body")).head(1)
        return (ts, order, json.loads(hit[0]["body"]), hit[0]["encoded_bytes"]) if hit else None

    def get_by_id(self, record_id: str) -> dict[str, Any] | None:
        """{timestamp, payload} or None."""
        with self._lock:
            self._ensure_open()
            found = self._find(record_id)
            return None if found is None else {"timestamp": found[0], "payload": clone_payload(found[2])}

    def update_by_id(self, record_id: str, patch: Mapping[str, Any]) -> bool:
        """Replaces payload fields; keeps timestamp and insertion order. Whether the record exists."""
        with self._lock:
            self._ensure_open()
            found = self._find(record_id)
            if found is None:
                return False
            ts, order, old, size = found
            payload = clone_payload({**old, **patch})
            new = encoded_bytes(ts, payload)
            if self._capacity is not None and self._size - size + new > self._capacity.most:
                raise QuotaExceededError("the changed record doesn't fit")
            self._drop(order)
            self._buffer[order] = (ts, payload, new)
            self._size += new - size
            self._resized[order] = new
            self._appended(new)
            return True

    def delete_by_id(self, record_id: str) -> bool:
        """Whether the record existed."""
        with self._lock:
            self._ensure_open()
            found = self._find(record_id)
            if found is None:
                return False
            self._drop(found[1])
            self._size -= found[3]
            self._count -= 1
            if self._heap is not None and (self._horizon is None or found[:2] <= self._horizon):
                self._dead.add(found[1])
            self._appended(0)
            return True

    # reading

    def _persisted(self) -> DataFrame:
        """All records: timestamp, insertion_order, encoded_bytes, payload."""
        parts = []
        if self._base is not None:
            base = self._base
            if self._gone:
                gone = self.spark.createDataFrame([(x,) for x in self._gone], "insertion_order long")
                base = base.join(gone, "insertion_order", "left_anti").select("timestamp", "insertion_order", "encoded_bytes", "payload")
            parts.append(base)
        if self._buffer or not parts:
            parts.append(self._buffered())
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _buffered(self) -> DataFrame:
        rows = [(ts, order, size, json.dumps(payload, ensure_ascii=False)) for order, (ts, payload, size) in self._buffer.items()]
        made = self.spark.createDataFrame(rows, "timestamp long, insertion_order long, encoded_bytes long, body string")
        return made.select("timestamp", "insertion_order", "encoded_bytes", F.parse_json("body").alias("payload"))

    def view(self) -> PayloadView:
        with self._lock:
            self._ensure_open()
            return PayloadView(self._persisted(), objects_exist=not self._parity)

    def select(self, start: Any, end: Any) -> DataFrame:
        """(timestamp, payload) of records from start to end, both included, in logical order."""
        view = self.view()
        low, high = epoch_ms(start, "start"), epoch_ms(end, "end")
        if low > high:
            raise InvalidQueryRangeError("start must not be after end")
        return select_range(view, low, high).select("timestamp", "payload")

    def query_native(self, request: QueryRequest | Mapping[str, Any]) -> DataFrame:
        return execute(request if isinstance(request, QueryRequest) else request_from(request), self.view(), self.limits)

    def query(self, language: str, text: str, options: ExecutionOptions | Mapping[str, Any] | None = None) -> DataFrame:
        self._ensure_open()
        engine = self._engines.get(language)
        if engine is None:
            raise QueryEngineNotRegisteredError(f"no engine for {language!r}")
        return self.query_native(engine.to_native_query(text, options))

    def register_query_engine(self, engine: QueryEngineModule) -> None:
        self._ensure_open()
        self._engines[engine.language] = engine

    def unregister_query_engine(self, language: str) -> None:
        self._ensure_open()
        self._engines.pop(language, None)

    def check_integrity(self) -> None:
        """Raises IndexCorruptionError unless (insertion_order) is unique and no key is null."""
        rows = self._persisted()
        bad = rows.groupBy("insertion_order").count().filter("count > 1 or insertion_order is null").head(1)
        if bad or rows.filter("timestamp is null").head(1):
            raise IndexCorruptionError("insertion orders repeat, or a key is null")

    def stats(self) -> dict[str, int]:
        return {"records": self._count, "bytes": self._size, "next_insertion_order": self._next_order}

    # committing

    def commit(self) -> None:
        """Makes everything so far durable (memory: nothing to do)."""
        with self._lock:
            self._ensure_open()
            self._commit()

    def _commit(self) -> None:
        if self._store is None:
            return
        added = None
        if self._added is not None and not self._gone:
            added = self._buffered()
            for frame in self._added:
                added = added.unionByName(frame)
        frame = self._store.commit(self._persisted(), self._next_order, self._size, self._count, added=added, streams=self._streams)
        self._base, self._buffer, self._gone, self._added, self._frames = frame, {}, set(), [], 0
        self._pending = self._dirty = 0

    def _appended(self, size: int) -> None:
        if self._store is None:
            return
        self._pending += size
        self._dirty += 1
        if self._every is None or (self._most_pending is not None and self._pending >= self._most_pending):
            self._commit()

    def _schedule(self) -> None:
        if self._store is None or self._every is None or self._closed:
            return
        self._timer = threading.Timer(self._every / 1000, self._tick)
        self._timer.daemon = True
        self._timer.start()

    def _tick(self) -> None:
        """One commit at a time: inserts and other triggers wait for the lock and find nothing left to do."""
        with self._lock:
            if self._closed:
                return
            if self._dirty:
                try:
                    self._commit()
                except Exception as e:
                    self._emit(e)
            self._schedule()

    def _emit(self, error: Exception) -> None:
        if not isinstance(error, StorageEngineError):
            wrapped = StorageEngineError(f"background commit failed: {error}")
            wrapped.__cause__ = error
            error = wrapped
        for listener in list(self._listeners):
            try:
                listener(ErrorEvent(error, time.time()))
            except Exception:  # a listener's failure is its own
                continue

    def on(self, event: str, listener: Callable[[ErrorEvent], None]) -> Callable[[], None]:
        """Listens to "error"; the function that stops it."""
        if event != "error":
            raise ValidationError("only the event error exists")
        if listener not in self._listeners:
            self._listeners.append(listener)
        return lambda: self.off(event, listener)

    def off(self, event: str, listener: Callable[[ErrorEvent], None]) -> None:
        if event != "error":
            raise ValidationError("only the event error exists")
        if listener in self._listeners:
            self._listeners.remove(listener)

    def close(self) -> None:
        """Ends timers and the lock. Records that are scheduled but not committed are given up."""
        with self._lock:
            if self._closed:
                return
            self._closed = True
            if self._timer is not None:
                self._timer.cancel()
            if self._store is not None:
                self._store.release()
            self._engines.clear()
            self._listeners.clear()

    def __enter__(self) -> Datastore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


__all__ = ["SCHEMA", "Datastore", "ErrorEvent", "QueryEngineModule", "run_query_with_engine"]
