"""Staging of intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where none is set and all runs on one machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


def stage(frame: DataFrame) -> DataFrame:
    """Compute ``frame`` once and continue from its files.

    For what several branches of a plan read and what is dear to make again
    (decoded frames, transactions). The files are columns, compressed, so that a
    branch reads only those it needs and large ones are read by several tasks.
    """
    path = f"{ensure_folder(frame.sparkSession)}/staged-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
