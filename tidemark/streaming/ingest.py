"""Streams into a datastore, and turnover retention as a stateful stream operator."""

from __future__ import annotations

import heapq
import os
import tempfile
import zlib
from collections.abc import Iterator
from typing import IO, Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..datastore import Datastore
from ..shipping import ship


def continuous_append(stream: DataFrame, db: Datastore, checkpoint: str, every: str | None = None, **columns: str) -> StreamingQuery:
    """Appends each micro-batch of (source_key, timestamp, JSON payload) to a datastore, once: the datastore commits a batch with
    its number and leaves out one that comes again after a crash. every: a processing-time trigger; None: what is there now.
    """

    def append(batch: DataFrame, number: int) -> None:
        db.append(batch, batch=(checkpoint, number), **columns)
        db.commit()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


EVENTS = "stream string, insertion_order long, evicted boolean"

#: Rows that are sorted in memory, and rows of each sorted run that stand in memory while runs are merged.
RUN, PIECE = 1 << 19, 1 << 12
COLUMNS = ["insertion_order", "timestamp", "encoded_bytes"]
#: Bytes of runs that stay in memory.
SPOOLED = 8 << 20


def _sorted(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return rows[rows[:, 0].argsort(kind="stable")]


def _pieces(file: IO[bytes], places: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    for at, length in places:
        file.seek(at)
        yield np.frombuffer(zlib.decompress(file.read(length)), np.int64).reshape(len(COLUMNS), -1).T


def _by_order(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """COLUMNS of all batches in insertion order, at most PIECE rows at a time. Sorted runs go compressed to a file in Spark's local folder (small ones stay in memory)
    and are merged, so memory holds a run, then a piece of each. Nulls are an error.
    """
    with tempfile.SpooledTemporaryFile(SPOOLED, dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:
        places: list[list[tuple[int, int]]] = []  # of the pieces of each run

        def write(rows: np.ndarray) -> None:
            places.append([])
            for at in range(0, len(rows), PIECE):
                start = file.tell()
                places[-1].append((start, file.write(zlib.compress(rows[at : at + PIECE].T.tobytes(), 1))))

        parts: list[np.ndarray] = []
        n = 0
        for batch in batches:
            parts.append(np.stack([batch[c].astype("int64") for c in COLUMNS], axis=1))
            n += len(batch)
            if n >= RUN:
                write(_sorted(parts))
                parts, n = [], 0
        if n:
            write(_sorted(parts))
            parts = []
        heads = [(next(run), run) for run in (_pieces(file, x) for x in places)]
        while heads:
            last = min(rows[-1, 0] for rows, _ in heads)  # up to here all rows are in memory
            cuts = [int(rows[:, 0].searchsorted(last, "right")) for rows, _ in heads]
            ready = _sorted([rows[:cut] for (rows, _), cut in zip(heads, cuts, strict=True)])
            for at in range(0, len(ready), PIECE):
                yield ready[at : at + PIECE]
            rest = [(rows[cut:] if cut < len(rows) else next(run, None), run) for (rows, run), cut in zip(heads, cuts, strict=True)]
            heads = [(rows, run) for rows, run in rest if rows is not None]


def continuous_turnover(stream: DataFrame, most: int, by: str = "stream") -> DataFrame:
    """Turnover per stream key over (by, timestamp, insertion_order, encoded_bytes): a row for each record that enters, with evicted false, and
    one for each that leaves. A record without timestamp is older than all others; one without order or size is an error. State: the kept records'
    keys and sizes. Memory holds the state and a run of a micro-batch, never all of its rows.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        heapq.heapify(held)
        size = sum(x[2] for x in held)
        for rows in _by_order(batches):
            out: list[tuple[Any, int, bool]] = []
            for order, ts, n in rows.tolist():
                if n > most:
                    continue
                while size + n > most:
                    _, old, freed = heapq.heappop(held)
                    size -= freed
                    out.append((key[0], old, True))
                heapq.heappush(held, (ts, order, n))
                size += n
                out.append((key[0], order, False))
            yield pd.DataFrame(out, columns=["stream", "insertion_order", "evicted"])
        state.update(tuple(map(list, zip(*held, strict=True))) if held else ([], [], []))

    ship(stream.sparkSession)
    rows = stream.select(F.col(by).cast("string").alias("stream"), F.coalesce("timestamp", F.lit(-(2**63))).alias("timestamp"), "insertion_order", "encoded_bytes")
    state = "timestamps array<long>, orders array<long>, sizes array<long>"
    return rows.groupBy("stream").applyInPandasWithState(step, EVENTS, state, "update", GroupStateTimeout.NoTimeout)
