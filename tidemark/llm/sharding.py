"""Shuffled sharding by a Feistel permutation of global row numbers, in DataFrame operations only.

Rows get global numbers 0..n-1 in id order (ties by CRC-32, size, then arrival, which only swaps equal
rows): a range partitioning, a local numbering and one offset per partition, so no task sees all
rows. A keyed Feistel network over Z_a x Z_b with a*b >= n, walked until the value is under n,
permutes the numbers; shard = p mod shards and slot = p div shards follow from the number alone, so any
row's place can be computed without a lookup. Law: `rows` (counts at most one apart). Equal texts
are spread like other rows, so a large group of copies cannot fill one shard.

Defined cases: null text has size 1 and the CRC-32 of no bytes; null ids come first; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpointed, text_of

ROUNDS = 6
#: Steps of cycle walking written into the plan. A walk visits only values from n to a*b - 1, fewer than a, so this
#: many suffice for sure up to 64 * 64 rows; beyond, a longer walk has a chance under n / 64**64 and raises an error.
WALK = 64


def domain(n: int) -> tuple[int, int]:
    """a, b with a*b >= n and a*b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-max(n, 1) // a))


def _mix(value: Column, step: Column, seed: int, modulus: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), step.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(modulus)


def feistel(value: Column, n: int, seed: int) -> Column:
    """One application of the network to a value of 0..a*b-1."""
    a, b = domain(n)
    right = value % F.lit(b).cast("long")
    pair = F.struct(F.lit(0).cast("long").alias("l") if a == 1 else ((value - right) / F.lit(b)).cast("long").alias("l"), right.alias("r"))

    def turn(at: Column, step: Column) -> Column:
        left = (at["l"] + _mix(at["r"], step, seed, a)) % F.lit(a).cast("long")
        right = (at["r"] + _mix(at["l"], step, seed, b)) % F.lit(b).cast("long")
        even = step % F.lit(2) == 0
        return F.struct(F.when(even, left).otherwise(at["l"]).alias("l"), F.when(even, at["r"]).otherwise(right).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, turn, lambda at: at["l"] * F.lit(b).cast("long") + at["r"])


def permute(value: Column, n: int, seed: int) -> Column:
    """The place of a row number in 0..n-1: the network, applied until the result is under n."""
    limit = F.lit(n).cast("long")

    def step(at: Column, _: Column) -> Column:
        return F.when(at < limit, at).otherwise(feistel(at, n, seed))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(value, n, seed), step)
    return F.when(walked < limit, walked).otherwise(F.raise_error(F.lit("cycle walk too long; choose another seed")).cast("long"))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with `number`, 0.. in the given order, and their count. No task sees all rows."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = checkpointed(parts.withColumn("at", F.monotonically_increasing_id()))
    counts = parts.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = checkpointed(counts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    total = offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    local = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = parts.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets.drop("n")), "part")
    return out.withColumn("number", F.col("offset") + local).drop("part", "offset", "at"), int(total)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 17) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard, row_number (global, in id order)."""
    text = text_of(text_col)
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    rows, total = numbered(rows, ["id", "crc", "size", "row"])
    place = rows.withColumn("place", permute(F.col("number"), total, seed))
    return place.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        (F.col("place") % F.lit(shards)).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % F.lit(shards)) / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("number").alias("row_number"),
    )
