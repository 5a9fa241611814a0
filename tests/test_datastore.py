import heapq
import json
import os
import random
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from tidemark import Datastore, LuceneEngine, QueryRequest, SqlEngine, compare_by_logical_order, run_query_with_engine, to_public_record
from tidemark.errors import (
    BinaryFormatError,
    ClosedDatastoreError,
    ConfigurationError,
    DatabaseLockedError,
    InvalidQueryRangeError,
    PageCorruptionError,
    QueryEngineNotRegisteredError,
    QuotaExceededError,
    StorageEngineError,
    UnsupportedBackendError,
    ValidationError,
)
from tidemark.operators.retention import in_order, parse_frequency, parse_size, retain, strict
from tidemark.sources.bulk import number_records
from tidemark.streaming import continuous_append, continuous_turnover, ingest


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    return tmp_path


def ids(frame):
    return [json.loads(r[0]).get("id") for r in frame.select(F.to_json("payload")).collect()]


def test_range_and_ties(spark):
    db = Datastore(spark)
    db.insert({"timestamp": "2025-01-01T00:00:01Z", "payload": {"id": "b1"}})
    db.insert({"timestamp": 1735689600000, "payload": {"id": "a1"}})
    db.insert({"timestamp": "2025-01-01T00:00:00.000Z", "payload": {"id": "a2"}})
    db.insert({"timestamp": 1735689601000.0, "payload": {"id": "b2"}})
    assert ids(db.select("2025-01-01T00:00:00Z", 1735689601000)) == ["a1", "a2", "b1", "b2"]
    assert ids(db.select(1735689601000, 1735689601000)) == ["b1", "b2"]
    assert db.select(0, 1).count() == 0 and db.select(0, 1).columns == ["timestamp", "payload"]
    with pytest.raises(InvalidQueryRangeError):
        db.select(2, 1)
    with pytest.raises(ValidationError):
        db.insert({"timestamp": 1, "payload": {}, "insertionOrder": 3})
    assert Datastore(spark).query_native({"select": ["x"]}).collect() == []


def test_engines(spark):
    db = Datastore(spark)
    db.insert_many({"timestamp": i, "payload": {"sensor": s, "value": v}} for i, (s, v) in enumerate([("a", 11), ("b", 20), ("a", 5)]))
    with pytest.raises(QueryEngineNotRegisteredError):
        db.query("sql", "SELECT value FROM records")
    db.register_query_engine(SqlEngine())
    db.register_query_engine(LuceneEngine())
    one = db.query("sql", "SELECT sensor, value FROM records WHERE sensor = 'a' ORDER BY value LIMIT 1")
    two = db.query("lucene", "sensor:a", {"select": ["sensor", "value"], "orderBy": [{"field": "value"}], "limit": 1})
    shown = lambda f: [tuple(json.loads(x.toJson()) for x in r) for r in f.collect()]
    assert shown(one) == shown(two) == shown(run_query_with_engine(db, LuceneEngine(), "sensor:a", {"select": ["sensor", "value"], "orderBy": [{"field": "value"}], "limit": 1})) == [("a", 5)]

    class Own:
        language = "sql"

        def to_native_query(self, text, options=None):
            return QueryRequest(select=("value",), limit=1)

    db.register_query_engine(Own())
    assert db.query("sql", "anything").columns == ["value"]
    db.unregister_query_engine("sql")
    db.unregister_query_engine("sql")
    db.close()
    db.close()
    for act in (lambda: db.query("lucene", "a:1"), lambda: db.select(0, 1), lambda: db.insert({}), db.commit, lambda: db.register_query_engine(Own()), lambda: db.unregister_query_engine("sql"), lambda: db.get_by_id("1:1")):
        with pytest.raises(ClosedDatastoreError):
            act()


def test_configuration(spark, folder):
    for bad in ({"auto_commit": {}}, {"capacity": {"max_size": 0}}, {"capacity": {"max_size": "5TB"}}, {"capacity": {"max_size": "1KB", "policy": "lru"}}):
        with pytest.raises(ConfigurationError):
            Datastore(spark, **bad)
    with pytest.raises(UnsupportedBackendError):
        Datastore(spark, "browser")
    os.symlink("/", folder / "out")
    for bad in (
        {"file_path": "../x"}, {"file_path": "/tmp/x"}, {"file_path": "out/tmp/x"}, {"file_path": "a", "target": {"kind": "path", "file_path": "b"}}, {"target": {"kind": "directory", "directory": ".", "file_name": "a/b"}},
        {"target": {"kind": "directory", "directory": ".", "file_prefix": ".."}}, {"target": {"kind": "other"}}, {"auto_commit": {"frequency": "5 s"}}, {"auto_commit": {"frequency": 0}}, {"auto_commit": {"max_pending_bytes": 0}},
    ):
        with pytest.raises(ConfigurationError):
            Datastore(spark, "file", **bad)
    assert parse_size("2KB") == 2048 and parse_size(7) == 7
    assert parse_frequency("5s") == 5000 and parse_frequency(None) is None and parse_frequency("immediate") is None and parse_frequency("2h") == 7_200_000


def test_reopen(spark, folder):
    where = {"target": {"kind": "directory", "directory": "data", "file_prefix": "p-", "file_name": "n"}}
    db = Datastore(spark, "file", **where)
    assert db.path == folder / "data" / "p-n.tmdb"
    with pytest.raises(DatabaseLockedError):
        Datastore(spark, "file", **where)
    for k in "ab":
        db.insert({"timestamp": 5, "payload": {"id": k}})
    db.commit()
    db.close()
    again = Datastore(spark, "file", **where)
    again.insert({"timestamp": 5, "payload": {"id": "c"}})
    assert ids(again.select(0, 9)) == ["a", "b", "c"]
    again.check_integrity()
    assert again.delete_by_id("5:0") and not again.delete_by_id("5:0") and again.get_by_id("5:0") is None
    assert again.update_by_id("5:1", {"id": "B", "more": {"x": None}}) and not again.update_by_id("9:9", {}) and again.get_by_id("nonsense") is None
    again.close()
    last = Datastore(spark, "file", **where)
    assert last.get_by_id("5:1") == {"timestamp": 5, "payload": {"id": "B", "more": {"x": None}}}
    assert ids(last.select(0, 9)) == ["B", "c"] and last.stats()["next_insertion_order"] == 3
    last.close()
    assert len([p for p in (folder / "data").iterdir() if ".g." in p.name]) == 2


def test_scheduled_records_are_lost_on_close(spark, folder):
    db = Datastore(spark, "file", file_path="s.db", auto_commit={"frequency": "1h"})
    db.insert({"timestamp": 1, "payload": {"id": 1}})
    db.close()
    db = Datastore(spark, "file", file_path="s.db", auto_commit={"frequency": "1h", "max_pending_bytes": 30})
    assert db.stats()["records"] == 0
    db.insert({"timestamp": 1, "payload": {"id": 1}})
    db.insert({"timestamp": 1, "payload": {"id": "x" * 40}})  # reaches the bound
    db.insert({"timestamp": 1, "payload": {"id": 3}})
    db.close()
    db = Datastore(spark, "file", file_path="s.db")
    assert db.stats()["records"] == 2
    db.close()


def test_background_errors(spark, folder, monkeypatch):
    db = Datastore(spark, "file", file_path="e.db", auto_commit={"frequency": 100})
    seen, real, failures = [], db._store.commit, [1, 2]

    def flaky(*a, **k):
        if failures:
            failures.pop()
            raise RuntimeError("disk")
        return real(*a, **k)

    monkeypatch.setattr(db._store, "commit", flaky)
    db.on("error", lambda e: 1 / 0)
    stop = db.on("error", seen.append)
    with pytest.raises(ValidationError):
        db.on("other", print)
    db.insert({"timestamp": 1, "payload": {}})
    for _ in range(300):
        if db._dirty == 0:
            break
        time.sleep(0.1)
    assert len(seen) == 2 and all(isinstance(e.error, StorageEngineError) and e.source == "autoCommit" for e in seen)
    stop()
    db.close()
    again = Datastore(spark, "file", file_path="e.db")
    assert again.stats()["records"] == 1
    again.close()


def test_crash_and_corruption(spark, folder):
    db = Datastore(spark, "file", file_path="c.db")
    db.insert({"timestamp": 1, "payload": {"id": 1}})
    db.close()
    (folder / "c.db.tmp").write_text("half")
    (folder / "c.db.g.9.tmp").mkdir()
    db = Datastore(spark, "file", file_path="c.db")
    assert ids(db.select(0, 9)) == [1] and not (folder / "c.db.tmp").exists() and not (folder / "c.db.g.9.tmp").exists()
    db.close()
    pointer = json.loads((folder / "c.db").read_text())
    for change, error in (
        ({"magic": "X"}, BinaryFormatError), ({"version": 9}, BinaryFormatError), ({"active": "../c.db.g.1"}, PageCorruptionError), ({"commit_id": 7, "active": "c.db.g.7"}, PageCorruptionError),
        ({"count": 5}, PageCorruptionError), ({"size": "x"}, PageCorruptionError), (None, BinaryFormatError),
    ):
        (folder / "c.db").write_text("{" if change is None else json.dumps(pointer | change))
        for _ in range(2):  # a failed open leaves no lock
            with pytest.raises(error):
                Datastore(spark, "file", file_path="c.db")


def test_capacity(spark):
    db = Datastore(spark, capacity={"max_size": "500B", "policy": "turnover"})
    for k in "ab":
        db.insert({"timestamp": 1, "payload": {"id": k, "blob": "x" * 300}})
    assert ids(db.select(0, 9)) == ["b"]
    small = Datastore(spark, capacity={"max_size": "1B"})
    with pytest.raises(QuotaExceededError):
        small.insert({"timestamp": 1, "payload": {}})
    assert small.stats() == {"records": 0, "bytes": 0, "next_insertion_order": 0}
    two = Datastore(spark, capacity={"max_size": 2 * len('5|{"id":1}'), "policy": "turnover"})
    for ts in (5, 1, 3, 0):
        two.insert({"timestamp": ts, "payload": {"id": ts}})
    assert sorted(ids(two.select(0, 9))) == [0, 5]


def test_page_size(spark):
    db = Datastore(spark, page_size=60, capacity={"max_size": 40, "policy": "turnover"})
    with pytest.raises(QuotaExceededError, match="page"):
        db.insert({"timestamp": 1, "payload": {"id": "x" * 30}})
    db.insert({"timestamp": 1, "payload": {"id": 1}})
    with pytest.raises(ConfigurationError):
        Datastore(spark, page_size=36)


def test_code_parity(spark):
    for parity, n in ((False, 2), (True, 1)):
        db = Datastore(spark, strict_code_parity=parity)
        db.insert_many({"timestamp": 1, "payload": p} for p in ({"x": {"y": 1}}, {"x": None}, {}))
        where = {"where": {"field": "x", "operator": "exists"}, "aggregates": [{"fn": "count", "as": "n"}]}
        assert db.query_native(where).first().n == n


def test_record_helpers():
    a, b = ({"timestamp": t, "insertion_order": o, "payload": {"x": {"y": t}}, "encoded_bytes": 5} for t, o in ((1, 9), (2, 0)))
    assert compare_by_logical_order(a, b) == -1 and compare_by_logical_order(b, a) == 1 and compare_by_logical_order(a, a) == 0
    public = to_public_record(a)
    assert public == {"timestamp": 1, "payload": {"x": {"y": 1}}} and public["payload"]["x"] is not a["payload"]["x"]


def plain_turnover(rows, most):
    held = []
    for ts, order, n in rows:
        if n > most:
            continue
        while sum(x[2] for x in held) + n > most:
            held.remove(min(held))
        held.append((ts, order, n))
    return sorted(o for _, o, _ in held)


@pytest.mark.parametrize("seed", range(3))
def test_retention(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 60) for _ in range(300)]
    for stamps in (sorted(rng.randrange(10**seed * 20) for _ in sizes), [rng.randrange(100) for _ in sizes]):
        rows = list(zip(stamps, range(300), sizes, strict=True))
        frame = spark.createDataFrame(rows, "timestamp long, insertion_order long, encoded_bytes long").repartition(3)
        assert in_order(frame) == (stamps == sorted(stamps))
        for most in (50, 700, 10**6):
            kept = lambda policy: sorted(r.insertion_order for r in retain(frame, most, policy).collect())  # noqa: B023, E731
            assert kept("turnover") == plain_turnover(rows, most)
            assert kept("strict") == [i for i, ok in enumerate(strict(sizes, most)) if ok]
    assert retain(frame.limit(0), 5, "turnover").collect() == []


def test_append(spark):
    db = Datastore(spark)
    db.insert({"timestamp": 4, "payload": {"id": "first"}})
    rows = [(i * 7 % 101, 1000 + i, json.dumps({"id": i, "n": {"x": 1.5}})) for i in range(101)]
    db.append(spark.createDataFrame(rows, "source_key long, timestamp long, payload string").repartition(5))
    order = [r[1] for r in sorted(rows)]
    got = db.view().frame.orderBy("insertion_order").collect()
    assert [r.insertion_order for r in got] == list(range(102)) and [r.timestamp for r in got[1:]] == order
    assert db.get_by_id(f"{order[0]}:1")["payload"]["n"] == {"x": 1.5}
    for bad in ('{"a":[1]}', "[]", "{", None, '{"":1}'):
        with pytest.raises(ValidationError):
            db.append(spark.createDataFrame([(1, 1, bad)], "source_key long, timestamp long, payload string"))
    assert db.stats()["records"] == 102


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "source_key long, timestamp long, payload string"
    db = Datastore(spark)
    for k in range(2):
        spark.createDataFrame([(i, 10 * k + i, json.dumps({"id": i})) for i in range(3)], schema).write.mode("append").parquet(f"file://{source}")
        continuous_append(spark.readStream.schema(schema).parquet(f"file://{source}"), db, f"file://{tmp_path}/c").awaitTermination(120)
    assert db.stats()["records"] == 6 and db.stats()["next_insertion_order"] == 6


def test_stream_turnover(spark, tmp_path):
    rng = random.Random(5)
    rows = [("s", rng.randrange(50), i, rng.randrange(1, 40)) for i in range(60)]
    source, schema = tmp_path / "in", "stream string, timestamp long, insertion_order long, encoded_bytes long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{source}")
    made = continuous_turnover(spark.readStream.schema(schema).parquet(f"file://{source}"), 100)
    query = made.writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    events = spark.table("kept").collect()
    kept = {r.insertion_order for r in events if not r.evicted} - {r.insertion_order for r in events if r.evicted}
    assert sorted(kept) == plain_turnover([r[1:] for r in rows], 100)


def test_stream_turnover_holds_a_run_at_most(spark, monkeypatch):
    """Rows come in any order; memory doesn't grow with a micro-batch, and results don't come all at once."""
    steps = []
    monkeypatch.setattr(ingest, "RUN", 2000, raising=False)
    monkeypatch.setattr(ingest, "PIECE", 50, raising=False)
    monkeypatch.setattr(ingest, "SPOOLED", 2000, raising=False)
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, f, *_: steps.append(f))
    continuous_turnover(spark.createDataFrame([], "stream string, timestamp long, insertion_order long, encoded_bytes long"), 2000)

    def peak(n, ordered):
        rng = np.random.default_rng(n)
        stamps, sizes = rng.integers(0, 10**6, n), rng.integers(1, 60, n)
        orders = np.arange(n) if ordered else rng.permutation(n)
        state = SimpleNamespace(exists=False, update=lambda x: setattr(state, "kept", x))
        batches = (pd.DataFrame({"timestamp": stamps[x], "insertion_order": x, "encoded_bytes": sizes[x]}) for x in np.array_split(orders, n // 100))
        kept, longest = set(), 0
        tracemalloc.start()
        for frame in steps[0](("s",), batches, state):
            longest = max(longest, len(frame))
            for order, evicted in zip(frame["insertion_order"].tolist(), frame["evicted"].tolist(), strict=True):
                (kept.remove if evicted else kept.add)(order)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        held, size = [], 0
        for row in zip(stamps.tolist(), range(n), sizes.tolist(), strict=True):
            while size + row[2] > 2000:
                size -= heapq.heappop(held)[2]
            heapq.heappush(held, row)
            size += row[2]
        assert kept == {x[1] for x in held} and sorted(state.kept[1]) == sorted(kept)
        assert longest < 2000
        return most

    for ordered in (True, False):
        peak(1000, ordered)
        assert peak(80_000, ordered) < 1.5 * peak(20_000, ordered)


def test_stream_turnover_without_time(spark, tmp_path):
    """Such records are the oldest."""
    rng = random.Random(6)
    rows = [("s", None if i % 4 == 0 else rng.randrange(50), i, rng.randrange(1, 40)) for i in range(60)]
    source, schema = tmp_path / "in", "stream string, timestamp long, insertion_order long, encoded_bytes long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{source}")
    made = continuous_turnover(spark.readStream.schema(schema).parquet(f"file://{source}"), 400)
    made.writeStream.outputMode("update").format("memory").queryName("timeless").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    events = spark.table("timeless").collect()
    kept = {r.insertion_order for r in events if not r.evicted} - {r.insertion_order for r in events if r.evicted}
    assert sorted(kept) == plain_turnover([(-1 if at is None else at, i, n) for _, at, i, n in rows], 400)


def event(i, at=0):
    return (i, at, json.dumps({"id": i}))


def test_a_batch_that_comes_again_is_left_out(spark, folder):
    """Also after a crash: the number is committed with the batch."""
    rows = spark.createDataFrame([event(1), event(2)], "source_key long, timestamp long, payload string")
    with Datastore(spark, "file", file_path="s.tmdb", auto_commit={"frequency": "1h"}) as db:
        db.append(rows, batch=("a", 0))
        db.append(rows, batch=("a", 0))
        db.append(rows, batch=("b", 0))
        assert db.stats()["records"] == 4
        db.commit()
        db.append(rows, batch=("a", 1))  # given up
    with Datastore(spark, "file", file_path="s.tmdb") as db:
        db.append(rows, batch=("a", 0))
        assert db.stats()["records"] == 4
        db.append(rows, batch=("a", 1))
        assert ids(db.select(0, 0)) == [1, 2] * 3


def test_commits_add_what_is_new(spark, folder, monkeypatch):
    """Each commit writes the new records only, up to a number of parts; changes write all."""
    monkeypatch.setattr("tidemark.sources.storage.MOST_PARTS", 3)
    written = lambda: [p.name[-1] for p in sorted(folder.iterdir()) if ".g." in p.name]
    parts = lambda: json.loads((folder / "d.tmdb").read_text())["parts"]
    with Datastore(spark, "file", file_path="d.tmdb") as db:
        for i in range(2):
            db.insert({"timestamp": i, "payload": {"id": i}})
        assert parts() == ["d.tmdb.g.0", "d.tmdb.g.1", "d.tmdb.g.2"]
        assert spark.read.parquet(str(folder / "d.tmdb.g.2")).count() == 1
        db.insert({"timestamp": 2, "payload": {"id": 2}})
        assert parts() == ["d.tmdb.g.3"] and written() == ["2", "3"]
        db.append(spark.createDataFrame([event(9, 9)], "source_key long, timestamp long, payload string"))
        assert parts() == ["d.tmdb.g.3", "d.tmdb.g.4"] and ids(db.select(0, 9)) == [0, 1, 2, 9]
        db.delete_by_id("1:1")
        assert parts() == ["d.tmdb.g.5"]
    with Datastore(spark, "file", file_path="d.tmdb") as db:
        assert ids(db.select(0, 9)) == [0, 2, 9]
    pointer = json.loads((folder / "d.tmdb").read_text())
    for bad in ({"parts": []}, {"parts": ["x.g.5"]}, {"parts": ["d.tmdb.g.1", "d.tmdb.g.5"]}, {"streams": {"a": "b"}}):
        (folder / "d.tmdb").write_text(json.dumps(pointer | bad))
        with pytest.raises(PageCorruptionError):
            Datastore(spark, "file", file_path="d.tmdb")


@pytest.mark.parametrize("seed", range(3))
def test_turnover_finds_the_oldest_slice_by_slice(spark, monkeypatch, seed):
    """The driver holds a few keys at a time; records that are changed, deleted or late are met in their place."""
    monkeypatch.setattr("tidemark.datastore.SLICE", 4)
    rng = random.Random(seed)
    db = Datastore(spark, capacity={"max_size": 300, "policy": "turnover"})
    held = {}
    for i in range(60):
        at, text = rng.randrange(20), "x" * rng.randrange(1, 30)
        db.insert({"timestamp": at, "payload": {"id": text}})
        size = lambda t, x: len(f'{t}|{{"id":"{x}"}}')
        while sum(size(t, x) for (t, _), x in held.items()) + size(at, text) > 300:
            del held[min(held)]
        held[at, i] = text
        if i % 7 == 3:
            at, order = rng.choice(sorted(held))
            assert db.update_by_id(f"{at}:{order}", {"id": "y"})
            held[at, order] = "y"
        if i % 11 == 5:
            at, order = rng.choice(sorted(held))
            assert db.delete_by_id(f"{at}:{order}")
            del held[at, order]
    assert db.stats()["bytes"] == sum(size(t, x) for (t, _), x in held.items())
    assert ids(db.select(0, 99)) == [x for _, x in sorted(held.items())]


def test_numbering_is_even_whatever_the_keys(spark):
    """One key far from the others does not put these into one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _number(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _number(spark):
    rows = spark.createDataFrame([(i,) for i in range(4000)] + [(2**60,)], "source_key long").repartition(4)
    found = number_records(rows, start=7)
    assert [r.insertion_order for r in found.orderBy("source_key").collect()] == list(range(7, 4008))
    largest = max(found.groupBy(F.spark_partition_id()).count().collect(), key=lambda r: r["count"])["count"]
    assert largest < 3000
    assert number_records(rows.limit(0)).collect() == []
