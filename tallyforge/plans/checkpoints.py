"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The context's own folder under ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder and a cluster an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        setting = context.getConf().get("spark.checkpoint.dir")
        if not setting and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(setting or tempfile.mkdtemp(prefix="tallyforge-"))
    return context.getCheckpointDir()


#: Rows of a task that runs Python row by row, about, and such tasks at most.
ROWS, TASKS = 20_000, 4096


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to tasks by its rows, for work that Python does row by row: a narrow table's file is one task's else, however many rows it has."""
    return df.repartition(min(TASKS, 1 + df.count() // ROWS))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored under ``spark.checkpoint.dir``, which all executors share."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored as columns under ``spark.checkpoint.dir``, for wide tables of which each reader takes a few columns or rows. Unlike checkpoints they stay until the job's folder goes."""
    path = f"{checkpoint_root(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
