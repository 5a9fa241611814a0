"""Registered queries over the storage life cycle: what a datastore holds after inserts, commits, reopening, changes, streams; what it refuses."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .datastore import Datastore, run_query_with_engine
from .errors import TidemarkError
from .languages import LuceneEngine, SqlEngine
from .plans.request import QueryLimits
from .sources.checkpoints import checkpointed
from .streaming import continuous_append, continuous_turnover

Query = Callable[[SparkSession, str], DataFrame]

CAPACITY = 40_000
LOW, HIGH = 1704153600000, 1704326400000  # 2024-01-02 and 2024-01-04, UTC


def _columns(rows: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct("event_type", "user_id"))
    return rows.select(F.col("event_id").alias("source_key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), payload.alias("payload"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _shown(frame: DataFrame) -> DataFrame:
    """Stored records as plain columns."""
    return frame.select(
        "timestamp", "insertion_order", "encoded_bytes", F.variant_get("payload", "$.event_type", "string").alias("event_type"), F.variant_get("payload", "$.user_id", "long").alias("user_id")
    )


class Folder:
    """A folder that all nodes share, for the files of one query; results are checkpointed before it goes."""

    def __init__(self, spark: SparkSession) -> None:
        at = urlparse(spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir())
        self.path = Path(at.path) / f"tidemark-store-{uuid.uuid4().hex}"

    def __enter__(self) -> Path:
        self.path.mkdir(parents=True)
        return self.path

    def __exit__(self, *_: object) -> None:
        shutil.rmtree(self.path, ignore_errors=True)


def _opened(spark: SparkSession, folder: Path, **options: Any) -> Datastore:
    return Datastore(spark, "file", file_path=str(folder / "events.tmdb"), root=str(folder), limits=QueryLimits.unbounded(), **options)


def store_bulk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events appended to a store in memory: orders and sizes as assigned."""
    with Datastore(spark) as db:
        db.append(_events(spark, sf_dir))
        return _shown(db.view().frame)


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events committed to files, odd ones after reopening, all read after reopening again: orders go on."""
    rows = _events(spark, sf_dir)
    with Folder(spark) as folder:
        for rest in (0, 1):
            with _opened(spark, folder) as db:
                db.append(rows.filter(F.col("source_key") % 2 == rest))
        with _opened(spark, folder) as db:
            db.check_integrity()
            return checkpointed(_shown(db.view().frame))


def store_select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of time, both ends included, from files."""
    with Folder(spark) as folder:
        with _opened(spark, folder) as db:
            db.append(_events(spark, sf_dir))
        with _opened(spark, folder) as db:
            found = db.select(LOW, "2024-01-04T00:00:00Z")
            return checkpointed(found.select("timestamp", F.variant_get("payload", "$.event_type", "string").alias("event_type"), F.variant_get("payload", "$.user_id", "long").alias("user_id")))


#: Insertion orders that are changed and deleted by id.
CHANGED, DELETED = (5, 50, 500), (7, 70, 700)


def store_changes_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read, changed and deleted by their ids, on files, then read after reopening."""
    with Folder(spark) as folder:
        with _opened(spark, folder) as db:
            db.append(_events(spark, sf_dir))
        with _opened(spark, folder, auto_commit={"frequency": "1h"}) as db:
            rows = db.view().frame.filter(F.col("insertion_order").isin(*CHANGED, *DELETED)).select("timestamp", "insertion_order").collect()
            for r in rows:
                name = f"{r['timestamp']}:{r['insertion_order']}"
                if r["insertion_order"] in DELETED:
                    db.delete_by_id(name)
                else:
                    held = db.get_by_id(name)
                    db.update_by_id(name, {"user_id": held["payload"]["user_id"] + 1_000_000})
            db.commit()
        with _opened(spark, folder) as db:
            return checkpointed(_shown(db.view().frame))


def store_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of bounded size keeps of all events."""
    with Datastore(spark, capacity={"max_size": CAPACITY, "policy": "turnover"}) as db:
        db.append(_events(spark, sf_dir))
        return _shown(db.view().frame)


def store_turnover_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by single inserts of every nation, of equal sizes, with room for ten."""
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect()]
    with Datastore(spark, capacity={"max_size": 10 * 26, "policy": "turnover"}) as db:
        for k in names:
            db.insert({"timestamp": 1704067200000, "payload": {"key": f"{k:02d}"}})
        return db.view().frame.select("insertion_order", F.variant_get("payload", "$.key", "string").alias("key"))


def store_commit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation inserted, committed whenever four records are pending; what is read after a close without commit."""
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect()]
    with Folder(spark) as folder:
        with _opened(spark, folder, auto_commit={"frequency": "1h", "max_pending_bytes": 4 * 26}) as db:
            for k in names:
                db.insert({"timestamp": 1704067200000, "payload": {"key": f"{k:02d}"}})
        with _opened(spark, folder) as db:
            return checkpointed(db.view().frame.select("insertion_order", F.variant_get("payload", "$.key", "string").alias("key")))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a store keeps, after a check of its integrity."""
    with Datastore(spark) as db:
        db.append(_events(spark, sf_dir))
        db.check_integrity()
        found = db.stats()
        return spark.createDataFrame([(found["records"], found["bytes"], found["next_insertion_order"])], "records long, bytes long, next_insertion_order long")


def engine_unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query by an engine that is not registered."""
    with Datastore(spark, limits=QueryLimits.unbounded()) as db:
        db.append(_events(spark, sf_dir))
        found = run_query_with_engine(db, SqlEngine(), "SELECT event_type, COUNT(*) AS n FROM records WHERE user_id < 50 GROUP BY event_type")
        return found.select(F.col("event_type").cast("string").alias("event_type"), "n")


def engine_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query by the name of a registered engine, with options."""
    with Datastore(spark, limits=QueryLimits.unbounded()) as db:
        db.register_query_engine(LuceneEngine())
        db.append(_events(spark, sf_dir))
        return db.query("lucene", "event_type:click AND user_id:[10 TO 20]", {"select": ["_id"], "orderBy": [{"field": "user_id"}]})


def _stream(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    """All events as a stream of files, which come from a folder."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = (folder / "in").as_uri()
    rows.write.mode("overwrite").parquet(path)
    return _columns(spark.readStream.schema(rows.schema).parquet(path))


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by a stream into files; a second run of the stream, and a batch that comes again, add nothing."""
    with Folder(spark) as folder, _opened(spark, folder) as db:
        at, rows = (folder / "progress").as_uri(), _stream(spark, sf_dir, folder)
        for _ in range(2):
            continuous_append(rows, db, at).awaitTermination()
        db.append(_events(spark, sf_dir), batch=(at, 0))
        return checkpointed(_shown(db.view().frame))


def stream_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bound per type of event keeps of a stream."""
    with Folder(spark) as folder:
        out = (folder / "out").as_uri()
        rows = _stream(spark, sf_dir, folder).select(
            F.get_json_object("payload", "$.event_type").alias("stream"), "timestamp", F.col("source_key").alias("insertion_order"), F.length("payload").cast("long").alias("encoded_bytes")
        )

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        continuous_turnover(rows, CAPACITY // 10).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", (folder / "progress").as_uri()).trigger(availableNow=True).start().awaitTermination()
        found = spark.read.parquet(out).groupBy("stream", "insertion_order").agg(F.max("evicted").alias("gone")).filter("not gone")
        return checkpointed(found.select("stream", "insertion_order"))


def _cases(spark: SparkSession, sf_dir: str, folder: Path) -> dict[str, Callable[[], Any]]:
    sql, lucene = SqlEngine(), LuceneEngine()
    db = Datastore(spark)
    db.append(_events(spark, sf_dir))
    small = Datastore(spark, capacity={"max_size": "1B", "policy": "strict"})
    closed = Datastore(spark)
    closed.close()
    deep: dict[str, Any] = {"field": "x", "operator": "exists"}
    for _ in range(65):
        deep = {"not": deep}
    record = lambda payload, at=0: {"timestamp": at, "payload": payload}
    nested: dict[str, Any] = {"leaf": "ok"}
    for i in range(65):
        nested = {f"k{i}": nested}
    test = lambda **x: db.query_native({"where": x})
    return {
        "closed": lambda: closed.insert(record({})),
        "capacity_zero": lambda: Datastore(spark, capacity={"max_size": 0}),
        "capacity_policy": lambda: Datastore(spark, capacity={"max_size": 1, "policy": "newest"}),
        "commit_in_memory": lambda: Datastore(spark, auto_commit={"frequency": "1s"}),
        "commit_frequency": lambda: Datastore(spark, "file", auto_commit={"frequency": "often"}),
        "backend": lambda: Datastore(spark, "browser"),
        "outside": lambda: Datastore(spark, "file", file_path="/elsewhere/x.tmdb", root=str(folder)),
        "two_places": lambda: Datastore(spark, "file", file_path="x", target={"kind": "path", "file_path": "x"}),
        "locked": lambda: [_opened(spark, folder), _opened(spark, folder)],
        "strict_full": lambda: small.insert(record({"a": "b"})),
        "order_given": lambda: db.insert(record({}) | {"insertion_order": 1}),
        "zone_missing": lambda: db.insert(record({}, "2025-01-01T00:00:00")),
        "no_date": lambda: db.insert(record({}, "soon")),
        "payload_array": lambda: db.insert(record({"a": [1]})),
        "payload_infinite": lambda: db.insert(record({"a": float("inf")})),
        "payload_unsafe": lambda: db.insert(record({"a": 2**53})),
        "payload_key_empty": lambda: db.insert(record({"": 1})),
        "payload_key_long": lambda: db.insert(record({"k" * 1025: 1})),
        "payload_string_long": lambda: db.insert(record({"a": "x" * 65_536})),
        "payload_deep": lambda: db.insert(record(nested)),
        "payload_wide": lambda: db.insert(record({f"k{i}": 1 for i in range(257)})),
        "range_reversed": lambda: db.select(2, 1),
        "filter_deep": lambda: db.query_native({"where": deep}),
        "like_long": lambda: test(field="x", operator="like", value="x" * 257),
        "regexp_nested": lambda: test(field="x", operator="regexp", value="(a+)+$"),
        "regexp_ahead": lambda: test(field="x", operator="regexp", value="a(?=b)"),
        "regexp_back": lambda: test(field="x", operator="regexp", value="(a)\\1"),
        "order_unknown": lambda: db.query_native({"orderBy": [{"field": "x", "direction": "up"}]}),
        "unregistered": lambda: db.query("sql", "SELECT a FROM records"),
        "event_unknown": lambda: db.on("commit", print),
        "sql_table": lambda: sql.to_native_query("SELECT a FROM other"),
        "sql_join": lambda: sql.to_native_query("SELECT a FROM records JOIN other ON a = b"),
        "sql_having": lambda: sql.to_native_query("SELECT a, COUNT(*) AS n FROM records GROUP BY a HAVING n > 1"),
        "sql_subquery": lambda: sql.to_native_query("SELECT a FROM (SELECT a FROM records)"),
        "sql_insert": lambda: sql.to_native_query("INSERT INTO records VALUES (1)"),
        "sql_conflict": lambda: sql.to_native_query("SELECT a FROM records LIMIT 3", {"limit": 4}),
        "lucene_fuzzy": lambda: lucene.to_native_query("a:word~2"),
        "lucene_boost": lambda: lucene.to_native_query("a:word^2"),
        "lucene_open": lambda: lucene.to_native_query("(a:1 AND b:2"),
    }


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case, error): what a store and the languages refuse, and with which error."""
    found = []
    with Folder(spark) as folder:
        for name, run in _cases(spark, sf_dir, folder).items():
            try:
                run()
                found.append((name, "accepted"))
            except TidemarkError as e:
                found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "case string, error string")


#: What each case must be refused with.
REFUSED = {
    "closed": "ClosedDatastoreError",
    "capacity_zero": "ConfigurationError",
    "capacity_policy": "ConfigurationError",
    "commit_in_memory": "ConfigurationError",
    "commit_frequency": "ConfigurationError",
    "backend": "UnsupportedBackendError",
    "outside": "ConfigurationError",
    "two_places": "ConfigurationError",
    "locked": "DatabaseLockedError",
    "strict_full": "QuotaExceededError",
    "order_given": "ValidationError",
    "zone_missing": "TimestampParseError",
    "no_date": "TimestampParseError",
    "payload_array": "ValidationError",
    "payload_infinite": "ValidationError",
    "payload_unsafe": "ValidationError",
    "payload_key_empty": "ValidationError",
    "payload_key_long": "ValidationError",
    "payload_string_long": "ValidationError",
    "payload_deep": "ValidationError",
    "payload_wide": "ValidationError",
    "range_reversed": "InvalidQueryRangeError",
    "filter_deep": "QueryValidationError",
    "like_long": "QueryValidationError",
    "regexp_nested": "QueryValidationError",
    "regexp_ahead": "QueryValidationError",
    "regexp_back": "QueryValidationError",
    "order_unknown": "QueryValidationError",
    "unregistered": "QueryEngineNotRegisteredError",
    "event_unknown": "ValidationError",
    "sql_table": "QueryParseError",
    "sql_join": "UnsupportedQueryFeatureError",
    "sql_having": "UnsupportedQueryFeatureError",
    "sql_subquery": "UnsupportedQueryFeatureError",
    "sql_insert": "UnsupportedQueryFeatureError",
    "sql_conflict": "QueryValidationError",
    "lucene_fuzzy": "UnsupportedQueryFeatureError",
    "lucene_boost": "UnsupportedQueryFeatureError",
    "lucene_open": "QueryParseError",
}


def queries() -> dict[str, Query]:
    found = (
        store_bulk_append, store_roundtrip, store_select_range, store_changes_by_id, store_turnover, store_turnover_inserts, store_commit_threshold, store_stats,
        engine_unregistered, engine_registered, stream_append, stream_turnover, refusals,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    body = """'{"event_type":"' || event_type || '","user_id":' || user_id || '}'"""
    events = f"""r AS (SELECT epoch_us(ts) // 1000 AS timestamp, event_id, event_type, user_id, {body} AS body FROM events),
        s AS (SELECT *, strlen(timestamp || '|' || body) AS encoded_bytes FROM r)"""
    columns = "timestamp, insertion_order, encoded_bytes, event_type, user_id"
    whole = f"WITH {events}, t AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS insertion_order FROM s)"
    changed, deleted = (", ".join(map(str, x)) for x in (CHANGED, DELETED))
    cases = ", ".join(f"('{a}', '{b}')" for a, b in REFUSED.items())
    return {
        "store_bulk_append": f"{whole} SELECT {columns} FROM t",
        "store_roundtrip": f"WITH {events} SELECT timestamp, row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS insertion_order, encoded_bytes, event_type, user_id FROM s",
        "store_select_range": f"{whole} SELECT timestamp, event_type, user_id FROM t WHERE timestamp BETWEEN {LOW} AND {HIGH}",
        "store_changes_by_id": f"""{whole}, c AS (SELECT * REPLACE (user_id + CASE WHEN insertion_order IN ({changed}) THEN 1000000 ELSE 0 END AS user_id) FROM t WHERE insertion_order NOT IN ({deleted}))
            SELECT * REPLACE (strlen(timestamp || '|' || {body}) AS encoded_bytes) FROM (SELECT {columns} FROM c)""",
        "store_turnover": f"{whole} SELECT {columns} FROM (SELECT *, sum(encoded_bytes) OVER (ORDER BY timestamp DESC, insertion_order DESC) AS held FROM t) WHERE held <= {CAPACITY}",
        "store_turnover_inserts": """SELECT n - 1 AS insertion_order, lpad(n_nationkey::VARCHAR, 2, '0') AS key
            FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS n, count(*) OVER () AS total FROM nation) WHERE n > total - 10""",
        "store_commit_threshold": """SELECT n - 1 AS insertion_order, lpad(n_nationkey::VARCHAR, 2, '0') AS key
            FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS n, count(*) OVER () AS total FROM nation) WHERE n <= total // 4 * 4""",
        "store_stats": f"{whole} SELECT count(*) AS records, sum(encoded_bytes)::BIGINT AS bytes, max(insertion_order) + 1 AS next_insertion_order FROM t",
        "engine_unregistered": "SELECT event_type, count(*) AS n FROM events WHERE user_id < 50 GROUP BY 1",
        "engine_registered": f"""{whole} SELECT timestamp || ':' || insertion_order AS "_id" FROM t WHERE event_type = 'click' AND user_id BETWEEN 10 AND 20""",
        "stream_append": f"{whole} SELECT {columns} FROM t",
        "stream_turnover": f"""WITH {events} SELECT event_type AS stream, event_id AS insertion_order
            FROM (SELECT *, sum(strlen(body)) OVER (PARTITION BY event_type ORDER BY timestamp DESC, event_id DESC) AS held FROM s) WHERE held <= {CAPACITY // 10}""",
        "refusals": f'SELECT * FROM (VALUES {cases}) AS t("case", error)',
    }
