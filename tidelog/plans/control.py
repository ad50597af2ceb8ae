"""The control plane's decisions as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_WORKERS = 64


def reconcile(desired: DataFrame, running: DataFrame, most: int = MAX_WORKERS) -> DataFrame:
    """(id, action): start, skip (over the limit) or stop.

    ``desired`` has id and name, ``running`` id. Both are lists of tenants, of
    the control plane's size and not of the data's.
    """
    new = desired.join(running, "id", "left_anti")
    stays = running.join(desired, "id", "left_semi").agg(F.count(F.lit(1)).alias("kept"), F.lit(1).alias("one"))
    placed = new.withColumns({"place": F.row_number().over(Window.orderBy("name", "id")), "one": F.lit(1)}).join(F.broadcast(stays), "one")  # one row
    start = placed.select("id", F.when(F.col("place") + F.col("kept") <= most, "start").otherwise("skip").alias("action"))
    stop = running.join(desired, "id", "left_anti").select("id", F.lit("stop").alias("action"))
    return start.unionByName(stop)


def changed_configs(before: DataFrame, now: DataFrame, columns: list[str]) -> DataFrame:
    """Tenants whose settings differ from those they run with."""
    mark = lambda df: df.select("id", F.xxhash64(*columns).alias("mark"))
    return mark(now).join(mark(before).withColumnRenamed("mark", "old"), "id").filter(F.col("mark") != F.col("old")).select("id")


def restartable(workers: DataFrame) -> DataFrame:
    """Workers that have ended and are started again at the next poll."""
    return workers.filter(F.col("state").isin("STOPPED", "FAILED")).select("id")
