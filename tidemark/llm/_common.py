"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

#: Most rows whose keys may be broadcast (16-byte keys: about 50 MB built).
BROADCAST_ROWS = 400_000


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's own setting. Where none is set, a temporary one if all tasks run in this
    process, else an error: other nodes would not see a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if root is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="tidemark-"))
    return root or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder and cut from its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder (as a URI) in the shared checkpoint folder; deleted when the JVM ends."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/tidemark-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return str(fs.makeQualified(target).toString())


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder under scratch that no frame reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tokenizer_file(name: str, folder: str = "/opt/tokenizers") -> str:
    """Place of a public vocabulary file; every node has them."""
    return f"{folder}/{name}"


def tokenizer_threads(most: int = 2) -> None:
    """Threads of the tokenizers library in this process: by default it takes every core of the node, for each task."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """16 bytes of SHA-256 that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly. A join then shuffles it by the key itself, so that adaptive execution may split a hot key of the other
    side, which it can't where an aggregate by the key feeds the join.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def restrict(df: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """df joined to keys (checkpointed, unique): by broadcast up to BROADCAST_ROWS rows, else by shuffle."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), on, how)


def bounded_sample(rows: DataFrame, group: str, most: int, total: int | None = None) -> DataFrame:
    """At most `most` rows of each group (with `total`: at most that many in all, shared evenly), and one at least: those with the least
    `place` (a hash, a long of 0 or more). Rows of equal group and place count as one. More groups than total are a ValueError.

    One pass with partial aggregates estimates how many places a group has; only rows up to a place that leaves about `most` (and
    some to spare) are shuffled.
    """
    sizes = checkpointed(rows.groupBy(group).agg(F.approx_count_distinct("place").alias("__places"), F.min("place").alias("__least")))
    if total is not None:
        groups = sizes.count()
        if groups > total:
            raise ValueError(f"more than {total} groups of {group}")
        most = min(most, total // max(1, groups))
    spare = most * 1.2 + 4 * most**0.5 + 16
    limit = F.when(F.col("__places") <= spare, F.lit(2**63 - 1)).otherwise(F.greatest("__least", (F.lit(spare) / F.col("__places") * F.lit(2.0**63)).cast("long")))
    some = rows.join(F.broadcast(sizes.select(group, limit.alias("__limit"))), group).filter("place <= __limit").drop("__limit")
    nth = F.row_number().over(Window.partitionBy(group).orderBy("place"))
    return some.dropDuplicates([group, "place"]).withColumn("__nth", nth).filter(F.col("__nth") <= most).drop("__nth")


def place_of(*columns: Column) -> Column:
    """A hash of columns that orders rows for bounded_sample."""
    return F.xxhash64(*columns, F.lit(7)).bitwiseAND(F.lit(2**63 - 1))


def release_memory() -> None:
    """Gives freed memory back to the system: a worker process lives on after its task, beside other stages' workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of an Arrow batch. Spark's own bound is a number of rows, whatever their length.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless it has a bound already."""
    if int(spark.conf.get(_BATCH_CONF, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded bytes that releases memory when a task ends."""
    bound_batches(df.sparkSession)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about `most` bytes each (one row at least)."""
    total, begun = 0, 0
    lengths = column.cast(pa.large_binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_pylist()
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begun, i
            total, begun = 0, i
        total += n
    if begun < len(sizes):
        yield begun, len(sizes)
