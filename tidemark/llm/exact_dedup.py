"""Exact dedup by splitting off heavy hitters, in DataFrame operations only.

A Misra-Gries pass (the engine's frequent-items aggregate) names at most 1/support digests that
can hold more than that share of the rows. Their exact counts are taken with a map-side combine; the
verified winners, at most 1/support rows, are broadcast and settle their copies without a
shuffle. No remaining group holds more than that share; the rest goes through an ordinary shuffle by digest: groups
are aggregated with a map-side combine and joined back, so no task holds a group.

Texts are read once: later steps work on the checkpointed ids and digests.

Defined cases: null text counts as empty; of rows that repeat both id and text one stays; a null id
stays only if its whole group has null ids; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, spread, text_of


def heavy_digests(rows: DataFrame, support: float) -> DataFrame:
    """(digest, group_size, best) of digests that hold over `support` of the rows: at most 1/support."""
    total = rows.count()
    likely = rows.select(F.hex("digest").alias("hexed")).stat.freqItems(["hexed"], support)
    likely = likely.select(F.explode("hexed_freqItems").alias("hexed")).select(F.unhex("hexed").alias("digest")).distinct()
    return (
        rows.join(F.broadcast(likely), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("best"))
        .filter(F.col("group_size") > support * total)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 1024) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256. The largest id of a group stays."""
    rows = checkpointed(
        docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    )
    winners = checkpointed(heavy_digests(rows, support))
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("best"))
    rest = rest.join(spread(groups), "digest")
    return heavy.select(*rest.columns).unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
