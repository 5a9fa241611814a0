"""The corpus pipeline: five stages over `documents`, each a whole-table pass of one training-data operator.

Each stage gets what the one before kept, as written and read again, and judges all of it. All but the last return the
columns of documents. Rows stay as they are, but for texts that lose benchmark passages in the fourth stage (n_chars follows):

1. language_id drops documents that the classifier rejects (no letters, or far from every language).
2. exact_dedup keeps one document of each group of equal texts, that with the largest doc_id.
3. near_dedup keeps one document of each group linked by similarity of 0.8 or more, that with the least doc_id.
4. decontaminate drops documents of which benchmark passages are 5 % of the words or more, and cuts shorter ones out of the others.
5. sentencepiece encodes and decodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm._common import scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact_dedup_stage),
    ("near_dedup", stages.near_dedup),
    ("decontaminate", stages.decontaminate),
    ("sentencepiece", stages.sentencepiece),
]

#: Hashing classifiers and a piece model are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared checkpoint folder and read again."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
