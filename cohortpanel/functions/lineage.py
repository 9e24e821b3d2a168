"""Cutting lineage where later steps use a frame several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, one within one process (tests) gets one of its
    own; on a cluster that is an error, as executors would not share it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cohortpanel-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The frame's rows, computed once and kept in the shared folder of ``spark.checkpoint.dir``, in their partitions.

    Plans of iterative analyses would otherwise grow with every step that refers to them more than once; what is kept
    there survives lost executors.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """The same as a table of its own. Unlike a checkpoint's, its size is known and not derived from what it came from, whose
    estimates multiply with each round of a loop."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
