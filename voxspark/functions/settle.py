"""Cutting the lineage of tables that loops work on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    One is made only where the session names none and runs on this machine alone, as in tests.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "") or None
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            root = os.path.join(tempfile.gettempdir(), "checkpoints")
            os.makedirs(root, exist_ok=True)
            folder = "file://" + tempfile.mkdtemp(dir=root)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
