"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

A filtering stage returns the input's columns, whatever they are called, and rows unchanged, but for texts that
lose benchmark passages. Verdicts are counted per (doc_id, text key): where equal rows repeat, a stage that keeps one of a group keeps one
row. Null, empty and letterless texts go with language_id; null ids are kept like others; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, checkpointed, spread, table, text_key, text_of, tokenizer_file
from .decontaminate import decontaminated
from .exact_dedup import exact_dedup
from .language import recognised
from .near_dedup import jaccard_join
from .sentencepiece_backend import encode_texts

_ID, _KEY = "__tidemark_id", "__tidemark_key"


def _without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """docs without the rows of (id, key) in gone: by broadcast up to BROADCAST_ROWS rows, else by shuffle."""
    gone = checkpointed(gone.distinct())
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone = gone.toDF(_ID, _KEY)
    gone = F.broadcast(gone) if small else gone.hint("merge")
    marked = docs.withColumn(f"{_KEY}s", key)
    same = marked["doc_id"].eqNullSafe(gone[_ID]) & (marked[f"{_KEY}s"] == gone[_KEY])
    return marked.join(gone, same, "left_anti").drop(f"{_KEY}s")


def _one_each(docs: DataFrame, repeated: DataFrame, key: Column) -> DataFrame:
    """docs with one row left of each (id, key) in repeated, whose rows are equal in id and text."""
    if repeated.isEmpty():
        return docs
    repeated = checkpointed(repeated.distinct()).toDF(_ID, _KEY)
    marked = docs.withColumn(f"{_KEY}s", key)
    same = marked["doc_id"].eqNullSafe(repeated[_ID]) & (marked[f"{_KEY}s"] == repeated[_KEY])
    ones = marked.join(repeated, same, "left_semi").dropDuplicates(["doc_id", f"{_KEY}s"])
    return marked.join(repeated, same, "left_anti").unionByName(ones).drop(f"{_KEY}s")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return recognised(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    judged = checkpointed(exact_dedup(docs))
    pair = judged.select("doc_id", F.unhex("text_sha256").alias(_KEY), "kept")
    sure = pair.groupBy("doc_id", _KEY).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    whole = F.unhex(F.sha2(text_of("text"), 256))
    left = _without(docs, sure.filter("not kept").select("doc_id", _KEY), whole)
    return _one_each(left, sure.filter("kept and n > 1").select("doc_id", _KEY), whole)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that with the least doc_id, nulls last."""
    judged = jaccard_join(docs).filter("n_links > 0").select("doc_id", "text_key", "class_key")
    sure = checkpointed(judged.groupBy("doc_id", "text_key", "class_key").agg(F.count(F.lit(1)).alias("n")))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"))
    best = sure.groupBy("class_key").agg(F.min(place).alias("best"))
    marked = checkpointed(sure.withColumn("place", place).join(spread(best), "class_key").withColumn("stays", F.col("place").eqNullSafe(F.col("best"))))
    key = text_key(text_of("text"))
    left = _without(docs, marked.filter("not stays").select("doc_id", "text_key"), key)
    return _one_each(left, marked.filter("stays and n > 1").select("doc_id", "text_key"), key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; of the others with hits, the spans that are hit are cut out."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document and the digest of the text decoded from them."""
    return encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))
