"""Frames written once to the shared checkpoint folder and cut from their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from ..errors import ConfigurationError


def checkpointed(frame: DataFrame) -> DataFrame:
    """The folder is the session's spark.checkpoint.dir; a temporary one only where all tasks run in this process."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not context.master.startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that all nodes share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="tidemark-"))
    return frame.checkpoint(eager=True)
